"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from prosegrid.llm import urls


def _urls() -> str:
    upper, lower = urls.UPPER, urls.LOWER
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))

    def case(value) -> str:
        lines = [
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h + p)}'"
            for v, h, p in rules
        ]
        return "CASE " + " ".join(lines) + " END"

    link = urls.LINK.replace("'", "''")
    steps = [
        "r0 AS (SELECT kind, host, mass FROM start)",
        *(
            f"""r{i} AS (SELECT kind, host, sum(mass) AS mass FROM (
                  SELECT kind, host, (mass * {100 - urls.DAMPING}) // 100 AS mass FROM start
                  UNION ALL
                  SELECT s.kind, s.dest, (r.mass * {urls.DAMPING}) // (100 * s.degree)
                  FROM r{i - 1} r JOIN steps s ON s.kind = r.kind AND s.host = r.host) GROUP BY kind, host)"""
            for i in range(1, urls.ROUNDS + 1)
        ),
    ]
    return f"""
    WITH parts AS (
      SELECT page_id, html,
        translate(coalesce(regexp_extract(url, '{urls.URL}', 1), ''), '{upper}', '{lower}') AS host,
        coalesce(regexp_extract(url, '{urls.URL}', 2), '') AS path
      FROM pages),
    judged AS (SELECT page_id, host, path, {case(lambda v, r: r)} AS rule, {case(lambda v, r: v)} AS ruled FROM parts),
    seeds AS (
      SELECT CASE WHEN ruled = 'allow' THEN 't' ELSE 'd' END AS kind, host, count(*) AS n
      FROM judged WHERE ruled IS NOT NULL GROUP BY ALL),
    start AS (
      SELECT kind, host, (n::HUGEINT * {urls.MASS}) // (sum(n) OVER (PARTITION BY kind))::HUGEINT AS mass FROM seeds),
    edges AS (
      SELECT DISTINCT host AS src, translate(dst, '{upper}', '{lower}') AS dst
      FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM parts)
      WHERE host <> '' AND host <> translate(dst, '{upper}', '{lower}')),
    both_ways AS (
      SELECT 't' AS kind, src AS host, dst AS dest FROM edges UNION ALL SELECT 'd', dst, src FROM edges),
    steps AS (SELECT kind, host, dest, count(*) OVER (PARTITION BY kind, host) AS degree FROM both_ways),
    {", ".join(steps)},
    ranks AS (
      SELECT host, sum(CASE WHEN kind = 't' THEN mass ELSE 0 END) AS trust,
        sum(CASE WHEN kind = 'd' THEN mass ELSE 0 END) AS distrust
      FROM r{urls.ROUNDS} GROUP BY host)
    SELECT page_id, j.host, path, rule,
      coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged j LEFT JOIN ranks r ON r.host = j.host
    """


TOPK = """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
      FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
      FROM v q JOIN v d ON d.vec_id <> q.vec_id AND len(d.e) = len(q.e) WHERE q.vec_id % 50 = 0),
    ranked AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
        vec_id, score
      FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """


WARC = rf"""
    WITH p AS (
      SELECT page_id, url, md5(coalesce(html, '')) AS digest,
        regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS head
      FROM pages),
    cut AS (
      SELECT *, regexp_replace(translate(head, '{urls.UPPER}', '{urls.LOWER}'),
          '^(http://[^/]*):80$|^(https://[^/]*):443$', '\1\2') AS host,
        regexp_replace(substr(url, length(head) + 1), '#.*$', '') AS rest
      FROM p),
    canon AS (
      SELECT page_id, digest, host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest,
          '([?&])utm_[a-z]+=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', ''), '/$', '') AS canonical
      FROM cut),
    stored AS (
      SELECT page_id * 2 AS id, canonical, page_id * 60 AS ts, '"' || digest || '"' AS etag,
        CAST(page_id AS VARCHAR) AS modified, digest AS payload
      FROM canon WHERE canonical IS NOT NULL),
    asked AS (
      SELECT page_id * 2 + 1 AS record_id, canonical, (page_id + 1000) * 60 AS ts,
        CASE page_id % 5 WHEN 0 THEN '"old"' WHEN 1 THEN NULL WHEN 2 THEN 'W/"' || digest || '"'
          ELSE '"' || digest || '"' END AS etag,
        CASE WHEN page_id % 5 = 1 THEN CAST(page_id AS VARCHAR) END AS modified
      FROM canon),
    joined AS (
      SELECT a.*, s.id, s.etag AS setag, s.modified AS smodified, s.payload,
        CASE WHEN a.etag IS NOT NULL THEN regexp_replace(a.etag, '^W/', '') = s.etag
          ELSE coalesce(a.modified = s.modified, false) END AS same
      FROM asked a ASOF LEFT JOIN stored s ON a.canonical = s.canonical AND a.ts > s.ts)
    SELECT record_id, canonical,
      CASE WHEN id IS NULL THEN 'no-earlier-response' WHEN same THEN 'resolved' ELSE 'validator-mismatch' END AS outcome,
      CASE WHEN id IS NOT NULL AND same THEN id ELSE -1 END AS target_id,
      CASE WHEN id IS NOT NULL AND same THEN
        'cache-control: max-age=120' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) ||
        'etag: ' || coalesce(etag, setag) || chr(10) || 'last-modified: ' || coalesce(modified, smodified) END AS headers,
      CASE WHEN id IS NOT NULL AND same THEN payload END AS payload
    FROM joined
    """

ORACLES = {
    "op2_url_filters": _urls(),
    "op8_warc_revisits": WARC,
    "op10_topk": TOPK,
}
