"""DuckDB SQL for the registered queries, written apart from the Spark expressions."""

from __future__ import annotations

from prosegrid.functions import constants as C
from prosegrid.functions import phrases as P
from prosegrid.plans import sql_values as V


def _q(pattern: str) -> str:
    """A pattern as an SQL string; RE2 writes the end of the text as ``$``."""
    return "'" + pattern.replace(r"\z", "$").replace("'", "''") + "'"


def _words(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
SENTENCES = f"""
    sent AS (
      SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, {_q(C.SENTENCE)}),
        lambda x: {TRIM.format('x')}), lambda x: x <> '') AS s
      FROM documents)"""
WINDOWS = f"""{SENTENCES},
    ranges AS (
      SELECT doc_id, s, len(s) AS n, unnest(CASE WHEN len(s) <= 7 THEN [0]
        ELSE list_distinct(list_concat(range(0, len(s) - 6, 3), [len(s) - 7])) END) AS start
      FROM sent WHERE len(s) > 0),
    win AS (
      SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(least(start + 7, n) AS BIGINT) AS stop,
        array_to_string(s[start + 1 : least(start + 7, n)], ' ') AS t
      FROM ranges)"""


def _features() -> str:
    word, stop = _q(C.WORD), _words(V.STOPWORDS)
    many = lambda test, of="lw": f"len(list_filter({of}, lambda x: {test}))"
    stock = " + ".join(f"len(regexp_extract_all(t, {_q('(?i)' + p)}))" for p in V.STOCK)
    count = lambda p: f"len(regexp_extract_all(t, {_q(p)}))"
    ratio = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b})::DOUBLE END"
    values = {
        "mean_sentence_words": ratio("list_sum(lens)", "n"),
        "sentence_length_cv": ratio("sqrt(list_sum(list_transform(lens, lambda x: (x - mean) * (x - mean))) / n)", "mean"),
        "short_sentence_ratio": ratio(many("x <= 8", "lens"), "n"),
        "long_sentence_ratio": ratio(many("x >= 28", "lens"), "n"),
        "mean_word_length": ratio("list_sum(list_transform(lw, lambda x: length(regexp_replace(x, '[''’]', '', 'g'))))", "m"),
        "repeated_word_ratio": "CASE WHEN m = 0 THEN 0 ELSE 1 - kinds / m::DOUBLE END",
        "hapax_ratio": ratio("len(map_keys(hist)) - len(list_filter(map_values(hist), lambda x: x > 1))", "kinds"),
        "stopword_ratio": ratio(many(f"x IN {stop}"), "m"),
        "first_person_ratio": ratio(many(f"x IN {_words(V.FIRST_PERSON)}"), "m"),
        "contraction_ratio": ratio(many("regexp_matches(x, '[''’]')", "w"), "m"),
        "numeric_token_ratio": ratio(many(r"regexp_matches(x, '^\p{N}')", "w"), "m"),
        "comma_per_sentence": ratio(count(","), "n"),
        "semicolon_colon_per_sentence": ratio(count("[;:]"), "n"),
        "parenthetical_dash_per_sentence": ratio(count(r"[()—–]|\s-\s"), "n"),
        "transition_opening_ratio": ratio(many(f"regexp_matches(x, {_q(f'(?i)^(?:{C.OPENINGS})' + chr(92) + 'b')})", "s"), "n"),
        "stock_phrase_per_sentence": ratio(stock, "n"),
        "nominalization_ratio": ratio(many(f"length(x) > 5 AND regexp_matches(x, {_q(C.SUFFIX)})"), "m"),
        "adjacent_sentence_overlap": "CASE WHEN n < 2 THEN 0 ELSE list_sum(list_transform(range(1, n), lambda i: "
        "CASE WHEN len(sets[i]) + len(sets[i + 1]) = 0 THEN 0 ELSE len(list_intersect(sets[i], sets[i + 1])) / "
        "(len(sets[i]) + len(sets[i + 1]) - len(list_intersect(sets[i], sets[i + 1])))::DOUBLE END)) / (n - 1) END",
        "repeated_opener_ratio": "CASE WHEN len(opens) = 0 THEN 0 ELSE 1 - len(list_distinct(opens)) / len(opens)::DOUBLE END",
        "proper_noun_ratio": ratio(r"list_sum(list_transform(sw, lambda ws: len(list_filter(ws[2:], lambda x: regexp_matches(x, '^\p{Lu}')))))", "m"),
        "passive_construction_ratio": ratio(count(rf"(?i)\b{C.PASSIVE}\b"), "n"),
        "hedge_ratio": ratio(many(f"x IN {_words(V.HEDGES)}"), "m"),
    }
    return f"""{WINDOWS},
    cut AS (
      SELECT doc_id, start, t, regexp_extract_all(t, {word}) AS w,
        list_filter(list_transform(regexp_extract_all(t, {_q(C.SENTENCE)}), lambda x: {TRIM.format('x')}), lambda x: x <> '') AS s
      FROM win),
    lists AS (
      SELECT *, list_transform(w, lambda x: lower(x)) AS lw, list_transform(s, lambda x: regexp_extract_all(x, {word})) AS sw,
        len(s) AS n, len(w) AS m FROM cut),
    more AS (
      SELECT *, list_transform(sw, lambda x: len(x)) AS lens, len(list_distinct(lw)) AS kinds, list_histogram(lw) AS hist,
        list_filter(list_transform(sw, lambda x: lower(array_to_string(x[1:2], ' '))), lambda x: x <> '') AS opens,
        list_transform(sw, lambda ws: list_distinct(list_filter(list_transform(ws, lambda x: lower(x)),
          lambda x: length(x) > 2 AND x NOT IN {stop}))) AS sets
      FROM lists),
    ready AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE list_sum(lens) / n::DOUBLE END AS mean FROM more),
    feat AS (SELECT doc_id, start, {", ".join(f"{v} AS {k}" for k, v in values.items())} FROM ready)"""


_FEATURES = _features()
_LOGIT = " + ".join([str(V.INTERCEPT), *(f"({n} - {m}) / {s} * ({w})" for n, m, s, w in V.FEATURES)])
_LIKELIHOOD = f"""{_FEATURES},
    likely AS (SELECT doc_id, start, {_LOGIT} AS logit FROM feat),
    scored AS (
      SELECT doc_id, start, round(logit, 6) AS logit,
        round(1 / (1 + exp(-greatest(-30, least(30, logit)))), 6) AS probability FROM likely)"""


def _lines() -> str:
    i = lambda p: f"regexp_matches(line, {_q('(?i)' + p)})"
    return f"""
    WITH split AS (
      SELECT doc_id, length(text) AS size, unnest(string_split(text, chr(10))) AS raw,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, len(string_split(text, chr(10))) AS n
      FROM documents),
    placed AS (
      SELECT doc_id, line_no, raw, {TRIM.format('raw')} AS line, size,
        coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM split WHERE NOT (line_no = n - 1 AND raw = '')),
    marked AS (
      SELECT *, regexp_extract_all(line, {_q(C.TOKEN)}) AS words,
        max(CASE WHEN {i(C.REFERENCES)} AND start >= 0.1 * size THEN 1 ELSE 0 END)
          OVER (PARTITION BY doc_id ORDER BY line_no) AS refs,
        CASE WHEN regexp_matches(line, '^(?:```|~~~)') THEN 1 ELSE 0 END AS fence
      FROM placed),
    fenced AS (
      SELECT *, sum(fence) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences, len(words) AS k,
        list_transform(words, lambda x: lower(x)) AS lw,
        len(regexp_extract_all(line, '[.!?](?:\\s|$)')) AS marks,
        regexp_replace(line, '[^\\p{{L}}]', '', 'g') AS letters,
        list_filter(words, lambda x: regexp_matches(x, '\\p{{L}}')) AS cased
      FROM marked),
    counted AS (
      SELECT *, len(list_filter(lw, lambda x: x IN {_words(V.NON_ENGLISH)})) AS other,
        len(list_filter(lw, lambda x: x IN {_words(V.ENGLISH)})) AS english,
        len(list_filter(cased, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) AS titled
      FROM fenced)
    SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(start AS BIGINT) AS start,
      CAST(start + length(raw) AS BIGINT) AS stop,
      CASE WHEN refs = 1 THEN 'bibliography'
        WHEN fence = 1 OR fences % 2 = 1 OR regexp_matches(line, {_q(C.CODE)}) OR line = '' THEN 'non-prose'
        WHEN {i(C.PAGE_NUMBER)} OR {i(C.CONTENTS)} OR {i(C.LIST_ITEM)} OR {i(rf'^(?:{C.LABELS})' + chr(92) + 's*:')} OR {i(C.ADDRESS)} THEN 'non-prose'
        WHEN length(line) - length(replace(replace(line, '|', ''), chr(9), '')) >= 2 AND (k < 40 OR marks < 2) THEN 'non-prose'
        WHEN regexp_matches(line, '\\p{{Han}}|\\p{{Hiragana}}|\\p{{Katakana}}') OR (k >= 6 AND other >= 2 AND other > english)
          THEN 'unsupported-language'
        WHEN k = 0 OR k > 30 OR regexp_matches(line, '[.!?]["''”’)}}\\]]*\\s*$') THEN 'prose'
        WHEN length(letters) >= 3 AND letters = upper(letters) AND NOT contains(letters, 'ß') THEN 'non-prose'
        WHEN k > 14 THEN 'prose'
        WHEN k <= 5 OR (k <= 12 AND regexp_matches(line, '[:—-]\\s*$')) THEN 'non-prose'
        WHEN len(cased) > 0 AND 4 * titled >= 3 * len(cased) THEN 'non-prose'
        ELSE 'prose' END AS reason
    FROM counted"""


_NUMBER = r"(?i)^\s*(?:page\s+)?(?:\d{1,4}|[ivxlcdm]+)(?:\s*(?:of|/|-|–)\s*(?:\d{1,4}|[ivxlcdm]+))?\s*$"
_BOOKS = f"""WITH d AS (SELECT source AS book, doc_id AS page, string_split(concat_ws(chr(10), lang, text, 'page ' || doc_id), chr(10)) AS t FROM documents),
      l AS (SELECT book, page, unnest(t) AS line, generate_subscripts(t, 1) - 1 AS line_no, len(t) AS n FROM d),
      p AS (
        SELECT *, 800.0::DOUBLE * (1 - (line_no + 0.5::DOUBLE) / n) AS y, regexp_matches(line, {_q(_NUMBER)}) AS number,
          lower({TRIM.format("regexp_replace(line, '\\s+', ' ', 'g')")}) AS plain FROM l),
      b AS (SELECT *, CASE WHEN y >= (1 - 0.12::DOUBLE) * 800 THEN 'top' WHEN y <= 0.12::DOUBLE * 800 THEN 'bottom' END AS band FROM p),
      k AS (
        SELECT *, CASE WHEN len(regexp_extract_all(plain, '[\\p{{L}}\\p{{N}}]+')) BETWEEN 1 AND 20
          AND NOT regexp_matches(plain, '[.!?]["''”’)}}\\]]*$') THEN band || ':' || plain END AS key FROM b)"""


ORACLES = {
    "word_counts": f"""SELECT doc_id, len(regexp_extract_all(text, {_q(C.TOKEN)})) AS tokens,
        len(regexp_extract_all(text, {_q(C.WORD)})) AS words, len(regexp_extract_all(text, '\\S+')) AS pieces FROM documents""",
    "statistical_sentences": f"""WITH {SENTENCES}
      SELECT doc_id, len(s) AS sentences,
        CAST(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS chars FROM sent""",
    "window_ranges": f"WITH {WINDOWS} SELECT doc_id, start, stop FROM win",
    "statistical_features": f"WITH {_FEATURES} SELECT doc_id, start, "
    + ", ".join(f"round({n}, 6) AS {n}" for n, *_ in V.FEATURES)
    + " FROM feat",
    "window_likelihood": f"WITH {_LIKELIHOOD} SELECT doc_id, start, logit, probability FROM scored",
    "writing_characteristics": f"""WITH {SENTENCES},
      parts AS (
        SELECT d.doc_id, s, list_filter(regexp_extract_all(text, {_q(C.WORD)}), lambda x: regexp_matches(x, '^\\p{{L}}')) AS w
        FROM documents d JOIN sent USING (doc_id)),
      counted AS (
        SELECT doc_id, len(w) AS n, len(s) AS m,
          len(list_filter(w, lambda x: length(regexp_replace(x, '[''’]', '', 'g')) >= {V.LONG_WORD})) AS long,
          len(list_filter(s, lambda x: regexp_matches(x, {_q('(?i)' + C.CITATION)}))) AS cited FROM parts)
      SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE round(long / n::DOUBLE, 6) END AS long_word_ratio,
        CASE WHEN m = 0 THEN 0 ELSE round(cited / m::DOUBLE, 6) END AS citation_sentence_ratio FROM counted""",
    "fnv_split": """WITH h AS (
        SELECT doc_id, CAST(list_reduce(list_transform(string_split('essay:' || doc_id, ''), lambda c: CAST(ascii(c) AS BIGINT)),
          lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) % 20 AS INTEGER) AS bucket FROM documents)
      SELECT doc_id, bucket, CASE WHEN bucket < 14 THEN 'train' WHEN bucket < 17 THEN 'validation' ELSE 'test' END AS split FROM h""",
    "line_assessment": _lines(),
    "quantile_floor": """WITH r AS (
        SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i,
          count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL)
      SELECT source, p, n_chars FROM r, (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.995::DOUBLE]) AS p) WHERE i = floor((n - 1) * p)""",
    "roc_auc": f"""WITH {_LIKELIHOOD},
      joined AS (SELECT probability AS p, quality FROM scored JOIN labels USING (doc_id)),
      ranked AS (SELECT quality, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM joined),
      sums AS (
        SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality <> 1) AS negatives,
          sum(r) FILTER (quality = 1) AS total FROM ranked)
      SELECT positives, negatives,
        round((total::DOUBLE - positives * (positives + 1) / 2.0) / (positives * negatives), 6) AS auc FROM sums""",
    "class_weights": f"""WITH {WINDOWS},
      per AS (SELECT doc_id, quality, count(*) AS n FROM win JOIN labels USING (doc_id) GROUP BY ALL)
      SELECT doc_id, quality, round(0.5::DOUBLE / count(*) OVER (PARTITION BY quality) / n, 9) AS weight FROM per""",
    "changed_tokens": f"""WITH pairs AS (
        SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
      bags AS (
        SELECT conv_id, turn, list_histogram(regexp_extract_all(lower(coalesce(a, '')), {_q(C.EDIT_TOKEN)})) AS x,
          list_histogram(regexp_extract_all(lower(b), {_q(C.EDIT_TOKEN)})) AS y FROM pairs WHERE b IS NOT NULL)
      SELECT conv_id, turn, CAST(coalesce(list_sum(list_transform(
        list_distinct(list_concat(coalesce(map_keys(x), []), coalesce(map_keys(y), []))),
        lambda k: abs(CAST(coalesce(x[k], 0) AS BIGINT) - CAST(coalesce(y[k], 0) AS BIGINT)))), 0) AS BIGINT) AS changed FROM bags""",
    "boundary_artifacts": f"{_BOOKS} SELECT book, key, count(DISTINCT page) AS pages FROM k WHERE key IS NOT NULL AND NOT number GROUP BY ALL HAVING count(DISTINCT page) >= 2",
    "body_lines": f"""{_BOOKS}, again AS (
        SELECT book, key FROM k WHERE key IS NOT NULL AND NOT number GROUP BY ALL HAVING count(DISTINCT page) >= 2)
      SELECT book, page, count(*) AS lines FROM k WHERE (band IS NULL OR NOT number)
        AND NOT EXISTS (SELECT 1 FROM again WHERE again.book = k.book AND again.key = k.key) GROUP BY ALL""",
    "rate_limiter": """WITH RECURSIVE e AS (
        SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
      r AS (
        SELECT user_id, event_id, i, true AS accepted, [t] AS log FROM e WHERE i = 1
        UNION ALL
        SELECT e.user_id, e.event_id, e.i, len(list_filter(r.log, lambda x: e.t - x < 600000000)) < 6,
          CASE WHEN len(list_filter(r.log, lambda x: e.t - x < 600000000)) < 6
            THEN list_append(list_filter(r.log, lambda x: e.t - x < 600000000), e.t)
            ELSE list_filter(r.log, lambda x: e.t - x < 600000000) END
        FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
      SELECT event_id, accepted FROM r""",
    "ttl_latest": """WITH last AS (
        SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id)
      SELECT user_id, event_id FROM last WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 8 HOUR""",
}


def _signals() -> str:
    """CTEs up to ``sig(doc_id, i, words, signal, impact, marks)``."""
    find = lambda p, of="t", flag="(?i)": f"regexp_extract_all({of}, {_q(flag + p)})"
    lead = _q("(?i)" + V.TRANSITION)
    found = "flatten([" + ", ".join(find(p) for p in V.PHRASES) + "])"
    first = lambda values: f"list_filter({values}, lambda x, i: list_position(list_transform({values}, lambda y: lower(y)), lower(x)) = i)"
    values = {
        "stock-phrases": ("k >= 1", "least(42, 32 + 6 * (k - 1))", "k"),
        "repetitive-openings": ("opened >= 2", "least(20, 14 + 2 * (opened - 2))", "1"),
        "repeated-transitions": ("turned >= 2", "16", "1"),
        "uniform-sentence-length": ("n >= 4 AND mean >= 6 AND cv <= 0.22", "CASE WHEN cv <= 0.1 THEN 14 WHEN cv <= 0.17 THEN 11 ELSE 8 END", "1"),
        "abstract-language": ("abs >= 2 AND abs / words::DOUBLE >= 0.1::DOUBLE", "least(22, 10 + floor(abs / words::DOUBLE * 45 + 0.5))", "abs"),
        "nominalized-language": ("nom >= 2 AND nom / words::DOUBLE >= 0.08::DOUBLE", "least(20, 8 + floor(nom / words::DOUBLE * 50 + 0.5))", "nom"),
        "low-specificity": ("words >= 9 AND abs / words::DOUBLE >= 0.1::DOUBLE AND NOT concrete", "10", "1"),
    }
    opens = lambda what, n: f"'“' || {what} || '” opens ' || {n} || ' sentences'"
    says = {
        "stock-phrases": "array_to_string(stock, ' | ')",
        "repetitive-openings": opens("array_to_string(o, ' ')", "opened"),
        "repeated-transitions": opens("said", "turned"),
        "uniform-sentence-length": "'Sentence lengths vary little across this sample'",
        "abstract-language": "array_to_string(abstract, ' | ')",
        "nominalized-language": "array_to_string(nominal, ' | ')",
        "low-specificity": "'No names, numbers, quotations, or firsthand markers accompany the abstract terms'",
    }
    each = " UNION ALL ".join(
        f"SELECT doc_id, i, '{name}' AS signal, CAST({impact} AS BIGINT) AS impact, CAST({marks} AS BIGINT) AS marks, {says[name]} AS evidence FROM framed WHERE {test}"
        for name, (test, impact, marks) in values.items()
    )
    return f"""{SENTENCES},
    one AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS i FROM sent),
    draft AS (
      SELECT doc_id, i, t, regexp_extract_all(t, {_q(C.TOKEN)}) AS w, regexp_extract(t, {lead}, 1) AS said,
        regexp_extract_all(regexp_replace(t, {lead}, ''), {_q(C.TOKEN)})[1:3] AS o, {found} AS phrases FROM one),
    lists AS (
      SELECT *, nullif(lower(said), '') AS turn, {first("phrases")} AS stock, list_transform(w, lambda x: lower(x)) AS lw FROM draft),
    terms AS (
      SELECT *, list_filter(lw, lambda x: x IN {_words(V.ABSTRACT)}) AS a,
        list_filter(lw, lambda x: length(x) >= 7 AND regexp_matches(x, {_q(V.NOMINAL)})) AS b FROM lists),
    facts AS (
      SELECT *, len(w) AS words, len(stock) AS k, CASE WHEN len(o) = 3 THEN lower(array_to_string(o, ' ')) END AS opening,
        {first("a")} AS abstract, {first("b")} AS nominal, len(list_distinct(a)) AS abs, len(list_distinct(b)) AS nom,
        regexp_matches(t, {_q(V.CONCRETE)}) OR len(list_filter(w[2:], lambda x: regexp_matches(x, '^\\p{{Lu}}\\p{{Ll}}{{2,}}$'))) > 0 AS concrete
      FROM terms),
    near AS (
      SELECT *, list(words) OVER f AS lens, list(opening) OVER f AS openings, list(turn) OVER f AS turns
      FROM facts WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    sized AS (SELECT *, len(lens) AS n, list_sum(lens) / len(lens)::DOUBLE AS mean FROM near),
    framed AS (
      SELECT *, CASE WHEN mean = 0 THEN 0 ELSE sqrt(list_sum(list_transform(lens, lambda x: (x - mean) * (x - mean))) / n) / mean END AS cv,
        len(list_filter(openings, lambda x: x = opening)) AS opened, len(list_filter(turns, lambda x: x = turn)) AS turned FROM sized),
    sig AS ({each})"""


ORACLES |= {
    "sentence_signals": f"WITH {_signals()} SELECT doc_id, CAST(i AS BIGINT) AS i, signal, impact, evidence FROM sig",
    "pattern_intensity": f"""WITH {_signals()},
      total AS (SELECT doc_id, i, sum(impact) AS impact FROM sig GROUP BY ALL),
      scored AS (
        SELECT doc_id, greatest(1, words) AS w, least(100, CASE WHEN words >= 4 THEN 8 ELSE 4 END + coalesce(impact, 0)) AS p
        FROM facts LEFT JOIN total USING (doc_id, i))
      SELECT doc_id, CAST(floor(sum(p * w)::DOUBLE / sum(w)::DOUBLE + 0.5) AS BIGINT) AS intensity FROM scored GROUP BY doc_id""",
    "top_signals": f"""WITH {_signals()},
      per AS (
        SELECT doc_id, signal, count(DISTINCT i) AS affected, CAST(sum(marks) AS BIGINT) AS occurrences, CAST(sum(impact) AS BIGINT) AS impact FROM sig GROUP BY ALL)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY impact DESC, affected DESC, signal) AS rank, signal, affected, occurrences, impact
      FROM per QUALIFY rank <= 5""",
    "protected_diff": "WITH pairs AS ("
    "SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), each AS ("
    + " UNION ALL ".join(
        f"SELECT conv_id, turn, '{kind}' AS kind, lower(unnest(regexp_extract_all(coalesce({c}, ''), {_q(('(?i)' if fold else '') + p)}))) AS value, "
        f"{sign} AS s FROM pairs WHERE b IS NOT NULL"
        for kind, p, fold in (
            ("citation-or-number", P.PROTECTED, False),
            ("quotation", P.QUOTATION, False),
            ("name", P.NAME, False),
            ("qualifier", P.QUALIFIER, True),
        )
        for c, sign in (("a", 1), ("b", -1))
    )
    + ") SELECT conv_id, turn, kind, value, CASE WHEN sum(s) > 0 THEN 'removed' ELSE 'added' END AS change, "
    "CAST(abs(sum(s)) AS BIGINT) AS n FROM each GROUP BY ALL HAVING sum(s) <> 0",
}

ORACLES |= {
    "text_statistics": f"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        c AS (SELECT doc_id, {TRIM.format('t')} AS t, regexp_extract_all(lower(t), {_q(C.TOKEN)}) AS w FROM b)
      SELECT doc_id, CAST(length(t) AS BIGINT) AS characters, CAST(len(w) AS BIGINT) AS words,
        CAST(len(list_filter(regexp_split_to_array(t, '\\r?\\n\\s*\\r?\\n+'), lambda x: regexp_matches(x, '\\S'))) AS BIGINT) AS paragraphs,
        CAST(CASE WHEN len(w) = 0 THEN 0 ELSE floor(len(list_distinct(w)) / len(w)::DOUBLE * 100 + 0.5) END AS BIGINT) AS unique_percent
      FROM c""",
    "report_excerpt": f"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '\\s+', ' ', 'g') AS t FROM documents),
        d AS (SELECT doc_id, {TRIM.format('t')} AS t FROM c),
        e AS (SELECT doc_id, t, left(t, 521) AS head, 521 - strpos(reverse(left(t, 521)), ' ') AS space FROM d)
      SELECT doc_id, CASE WHEN length(t) <= 520 THEN t ELSE
        {TRIM.format("left(head, CAST(CASE WHEN contains(head, ' ') AND space > 364 THEN space ELSE 520 END AS BIGINT))")} || '...' END AS excerpt
      FROM e""",
    "page_spans": f"""WITH p AS (SELECT conv_id, turn, {TRIM.format("coalesce(text, '')")} AS t FROM conversations),
        q AS (SELECT *, string_agg(CASE WHEN t <> '' THEN t END, '\n\n') OVER (PARTITION BY conv_id ORDER BY turn, t
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM p)
      SELECT conv_id, turn, CAST(coalesce(length(so_far), 0) - length(t) AS BIGINT) AS start, CAST(coalesce(length(so_far), 0) AS BIGINT) AS stop,
        CASE WHEN t = '' THEN 'image-only' WHEN len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]')) < 24
          OR len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+')) < 4 THEN 'sparse-text' ELSE 'readable-text' END AS quality
      FROM q""",
    "threshold_choice": f"""WITH {_LIKELIHOOD},
        o AS (SELECT s.doc_id, s.probability AS p, l.quality FROM scored s JOIN labels l USING (doc_id)),
        h AS (SELECT * FROM o WHERE quality = 1),
        t AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
        cand AS (SELECT DISTINCT c FROM (SELECT p AS c FROM o UNION ALL SELECT 0.5 UNION ALL SELECT 1.0) WHERE c >= 0.5),
        point AS (SELECT doc_id, max(p) AS point FROM (
          SELECT a.doc_id, a.p, count(*) AS over FROM (SELECT DISTINCT doc_id, p FROM h) a JOIN h b ON a.doc_id = b.doc_id AND b.p >= a.p GROUP BY ALL) JOIN t USING (doc_id)
          WHERE over >= 0.2 * n GROUP BY doc_id),
        r AS (SELECT c, (SELECT count(*) FROM point WHERE point >= c) AS reported, (SELECT count(*) FROM t) AS humans FROM cand)
      SELECT c AS threshold, CAST(humans AS BIGINT) AS humans, CAST(reported AS BIGINT) AS reported FROM r
      WHERE c = (SELECT coalesce(min(c) FILTER (reported <= 0.01 * humans), 1.0) FROM r)""",
}


def _factors() -> str:
    """CTEs up to ``factor(doc_id, k, feature, value, standardized, contribution)``, means over a document's windows."""
    means = ", ".join(f"avg({n}) AS {n}" for n, *_ in V.FEATURES)
    each = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{n}' AS feature, {n} AS value, ({n} - {m}) / {s} AS standardized, ({n} - {m}) / {s} * ({w}) AS contribution FROM means"
        for k, (n, m, s, w) in enumerate(V.FEATURES)
    )
    return f"{_FEATURES}, means AS (SELECT doc_id, {means} FROM feat GROUP BY doc_id), factor AS ({each})"


_LABELLED = f"WITH {_LIKELIHOOD}, w AS (SELECT s.doc_id, s.probability AS p, l.quality = 1 AS human FROM scored s JOIN labels l USING (doc_id))"
_LEXICAL = ", ".join(f"'{n}'" for n in V.LEXICAL)
_SPLIT = ORACLES["fnv_split"].replace("WITH h AS (", "", 1)

ORACLES |= {
    "coaching": f"""WITH {_signals()},
        per AS (SELECT doc_id, signal, count(DISTINCT i) AS affected, sum(impact) AS impact FROM sig GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY impact DESC, affected DESC, signal) AS rank FROM per)
      SELECT doc_id, rank, signal, CASE rank WHEN 1 THEN 'high' WHEN 4 THEN 'low' ELSE 'medium' END AS priority,
        CASE signal WHEN 'stock-phrases' THEN 'Lead with the actual claim' WHEN 'repetitive-openings' THEN 'Let each sentence follow its idea'
          WHEN 'uniform-sentence-length' THEN 'Vary rhythm to match emphasis' WHEN 'repeated-transitions' THEN 'Make the relationship explicit'
          WHEN 'abstract-language' THEN 'Ground concepts in observable evidence' WHEN 'nominalized-language' THEN 'Turn hidden actions back into verbs'
          WHEN 'low-specificity' THEN 'Add details only this report could contain' END AS title
      FROM ranked WHERE rank <= 4""",
    "document_factors": f"""WITH {_factors()}
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY abs(contribution) DESC, k) AS rank, feature, round(value, 6) AS value,
        round(standardized, 6) AS standardized, round(contribution, 6) AS contribution,
        CASE WHEN contribution > 0 THEN 'raises' WHEN contribution < 0 THEN 'lowers' ELSE 'neutral' END AS direction FROM factor""",
    "document_rates": f"""{_LABELLED},
        d AS (SELECT doc_id, human, count(*) FILTER (p >= 0.5) >= 0.2 * count(*) AS hit FROM w GROUP BY ALL)
      SELECT count(*) FILTER (human) AS humans, round(coalesce(avg(hit::INT) FILTER (human), 0), 6) AS human_rate,
        count(*) FILTER (NOT human) AS machines, round(coalesce(avg(hit::INT) FILTER (NOT human), 0), 6) AS recall FROM d""",
    "window_metrics": f"""{_LABELLED},
        r AS (SELECT coalesce(avg((p >= 0.5)::INT) FILTER (NOT human), 0) AS tp, coalesce(avg((p < 0.5)::INT) FILTER (human), 0) AS tn FROM w)
      SELECT round(tp, 6) AS true_positive_rate, round(tn, 6) AS true_negative_rate, round((tp + tn) / 2, 6) AS balanced_accuracy FROM r""",
    "domain_bounds": f"""WITH {_factors()},
        share AS (
          SELECT doc_id, round(CASE WHEN sum(greatest(0, contribution)) = 0 THEN 0
            ELSE sum(CASE WHEN feature IN ({_LEXICAL}) THEN greatest(0, contribution) ELSE 0 END) / sum(greatest(0, contribution)) END, 6) AS lexical_share
          FROM factor GROUP BY doc_id),
        long AS ({ORACLES["writing_characteristics"].replace(SENTENCES, "", 1).replace("WITH ,", "WITH", 1)}),
        h AS ({_SPLIT.split("SELECT doc_id, bucket, CASE")[0].strip().rstrip(")")}),
        per AS (
          SELECT s.doc_id, lexical_share, long_word_ratio, CASE WHEN bucket < 14 THEN 'train' WHEN bucket < 17 THEN 'validation' ELSE 'test' END AS split
          FROM share s JOIN long USING (doc_id) JOIN h USING (doc_id)),
        t AS (SELECT list_sort(list(long_word_ratio)) AS a, list_sort(list(lexical_share)) AS b FROM per WHERE split = 'train'),
        bound AS (SELECT a[1 + CAST(floor((len(a) - 1) * 0.9::DOUBLE) AS INT)] AS x, b[1 + CAST(floor((len(b) - 1) * 0.9::DOUBLE) AS INT)] AS y FROM t)
      SELECT round(max(x), 6) AS long_word_bound, round(max(y), 6) AS lexical_bound,
        round(coalesce(avg((long_word_ratio > x AND lexical_share > y)::INT) FILTER (split = 'train'), 0), 6) AS train_unsupported,
        round(coalesce(avg((long_word_ratio > x AND lexical_share > y)::INT) FILTER (split = 'validation'), 0), 6) AS validation_unsupported
      FROM per, bound""",
    "standardized_features": f"WITH {_FEATURES} "
    + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg({n}), 6) AS mean, round(greatest(0.000001, stddev_pop({n})), 6) AS scale FROM feat" for n, *_ in V.FEATURES),
    "page_lookup": f"""WITH spans AS ({ORACLES["page_spans"]}),
        place AS (SELECT conv_id, unnest([0, 100, 250, 100000]) AS place FROM (SELECT DISTINCT conv_id FROM conversations))
      SELECT p.conv_id, CAST(place AS BIGINT) AS place, s.turn FROM place p LEFT JOIN spans s ON s.conv_id = p.conv_id AND place >= s.start AND place < s.stop""",
    "revision_requests": f"""SELECT conv_id, turn, CAST(CASE WHEN turn % 7 = 5 THEN 200 WHEN turn % 7 = 3 THEN 405 WHEN conv_id % 11 = 0 THEN 403
        WHEN coalesce(length(text) * 40, 0) > 12000 THEN 413
        WHEN text IS NULL OR length({TRIM.format('text')}) < 20 OR length(text) > 8000 OR role <> 'user' THEN 400 ELSE 200 END AS BIGINT) AS status FROM conversations""",
    "clean_paragraphs": f"""WITH p AS (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '\\r?\\n\\s*\\r?\\n+'),
          lambda x: {TRIM.format("regexp_replace(x, '\\s*\\r?\\n\\s*', ' ', 'g')")}), lambda x: x <> '') AS l FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN ['No readable text.'] ELSE l END AS l FROM p)
      SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS paragraph, unnest(l) AS text FROM s""",
}
