"""Rule-based rewriting of sentences, and checks that a revision keeps what must not change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.functions import phrases as P
from prosegrid.functions import tokens as T

KINDS = (("citation-or-number", P.PROTECTED, False), ("quotation", P.QUOTATION, False), ("name", P.NAME, False), ("qualifier", P.QUALIFIER, True))
OPENINGS = [(rule, P.java(p), new) for rule, p, new in P.OPENING_RULES]
WORDINGS = [(rule, P.java(rf"\b{p}\b" if p else P.TOTAL), new) for rule, p, new in P.WORDING_RULES]


def fragments(text: Column) -> Column:
    return T.find_all(text, P.java(P.PROTECTED, fold=False))


#: What a text must contain, in lower case, for a wording rule to change it; of letters with another lower form there is one.
WORDING_MARKS = tuple(sorted({words or "a total of " for _, words, _ in P.WORDING_RULES})) + ("ſ",)


def _apply(df: DataFrame, rules: list[tuple[str, str, str]], where: Column, marks: tuple[str, ...] = ()) -> DataFrame:
    """Rules in order over ``_t``; ``_ids`` gets those that changed something.

    With ``marks``, texts that contain none of them in lower case are left alone.
    """
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(p).alias("p"), F.lit(n).alias("n")) for r, p, n in rules))

    def step(acc: Column, rule: Column) -> Column:
        new = F.regexp_replace(acc["t"], rule["p"], rule["n"])
        ids = F.when(new != acc["t"], F.array_append(acc["ids"], rule["r"])).otherwise(acc["ids"])
        return F.struct(new.alias("t"), ids.alias("ids"))

    start = F.struct(F.col("_t").alias("t"), F.col("_ids").alias("ids"))
    # Most texts need none of the rules.
    some = F.col("_t").rlike("|".join(p for _, p, _ in rules))
    if marks:
        listed = F.array(*map(F.lit, marks))
        some = F.exists(F.array(F.lower("_t")), lambda low: F.exists(listed, lambda m: low.contains(m)))
    df = df.withColumn("_x", F.when(where & some, F.aggregate(steps, start, step)).otherwise(start))
    return df.withColumn("_t", F.col("_x.t")).withColumn("_ids", F.col("_x.ids")).drop("_x")


def revise(sentences: DataFrame, mode: str = "conservative", text: str = "text", stock: str = "stock", drop: str | None = None) -> DataFrame:
    """Adds ``revised`` and ``rules``.

    ``stock`` says whether a sentence has a stock phrase; ``drop``, if named,
    whether its additive transition repeats an earlier one of the paragraph.
    Quoted sentences stay, as does any whose protected fragments would change.
    """
    if mode not in ("conservative", "comprehensive"):
        raise ValueError(f"no such mode: {mode}")
    whole, t, keep = mode == "comprehensive", F.col(text), sentences.columns
    free = ~t.rlike("[“”\"]") & (F.lit(True) if whole else F.col(stock))
    df = sentences.withColumn("_t", t).withColumn("_ids", F.array().cast("array<string>")).withColumn("_free", F.coalesce(free, F.lit(False)))
    if whole:
        df = _apply(df, [("compress-transitioned-note", P.java(P.TRANSITIONED_NOTE), "$1, ")], F.col("_free"))
        if drop:
            df = _apply(df, [("remove-repeated-additive-transition", P.java(P.ADDITIVE), "")], F.col("_free") & F.col(drop))
    df = _apply(df, OPENINGS, F.col("_free") & F.col(stock))
    if whole:
        df = _apply(df, WORDINGS, F.col("_free"), WORDING_MARKS)
    new = F.col("_t")
    new = F.when((new != t) & new.rlike(r"^\p{Ll}"), F.concat(F.upper(F.substring(new, 1, 1)), F.expr("substring(_t, 2)"))).otherwise(new)
    df = df.withColumn("_new", new)
    same = (F.col("_new") == t) | (fragments(F.col("_new")) == fragments(t))
    return df.select(
        *keep,
        F.when(same, F.col("_new")).otherwise(t).alias("revised"),
        F.when(same, F.array_distinct("_ids")).otherwise(F.array().cast("array<string>")).alias("rules"),
    )


def protected_diff(pairs: DataFrame, keys: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """``keys, kind, value, change, n``: protected values that one side has ``n`` more of.

    Neither case nor Unicode's compatibility forms (NFKC) tell values apart.
    """
    def side(c: Column, sign: int) -> Column:
        def of(kind: str, pattern: str, fold: bool) -> Column:
            values = T.find_all(F.coalesce(c, F.lit("")), P.java(pattern, fold))
            return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"), F.lit(sign).alias("n")))

        return F.concat(*(of(*kind) for kind in KINDS))

    each = pairs.select(*keys, F.explode(F.concat(side(F.col(before), 1), side(F.col(after), -1))).alias("x"))
    each = each.select(*keys, "x.kind", F.lower(T.nfkc(F.col("x.value"))).alias("value"), "x.n")
    summed = each.groupBy(*keys, "kind", "value").agg(F.sum("n").alias("d")).where("d <> 0")
    return summed.select(*keys, "kind", "value", F.when(F.col("d") > 0, "removed").otherwise("added").alias("change"), F.abs("d").alias("n"))


def compose(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with ``edits(doc_id, start, end, before, after)`` spliced in, those whose ``before`` is stale left out.

    Of edits that overlap the first is taken; offsets count code points of the original.
    """
    edits = edits.withColumn("_over", F.coalesce(F.max("end").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)) > F.col("start"), F.lit(False)))
    joined = edits.where("not _over").drop("_over").join(texts, "doc_id")
    good = joined.where(F.expr("substring(text, start + 1, end - start) = before"))
    lists = good.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in ("start", "end", "after"))))).alias("e"))
    both = texts.join(lists, "doc_id", "left")
    spliced = F.expr(
        "aggregate(e, struct(0 as pos, '' as out), (a, x) -> struct(cast(x.end as int) as pos, "
        "concat(a.out, substring(text, a.pos + 1, cast(x.start as int) - a.pos), x.after) as out), "
        "a -> concat(a.out, substring(text, a.pos + 1)))"
    )
    return both.select("doc_id", F.coalesce(spliced, F.col("text")).alias("text"))


def repeated_additive(sentences: DataFrame, key: str = "row") -> DataFrame:
    """``sentences`` with ``drop``: whether an additive transition repeats an earlier one of its paragraph.

    ``sentences`` are those to revise, ``(key, i, text, signals, paragraph)``;
    quoted ones neither count nor lose theirs.
    """
    found = F.nullif(F.lower(F.regexp_extract("text", P.java(P.ADDITIVE), 1)), F.lit(""))
    said = F.when(~F.col("text").rlike("[“”\"]"), found)
    seen = F.row_number().over(Window.partitionBy(key, "paragraph", "_said").orderBy("i"))
    again = F.exists("signals", lambda s: s["id"] == "repeated-transitions")
    return sentences.withColumn("_said", said).withColumn("drop", F.col("_said").isNotNull() & again & (seen > 1)).drop("_said")


def plan_edits(members: DataFrame, targets: DataFrame, mode: str) -> DataFrame:
    """``(row, doc_id, i, passage, start, end, before, after, rules, rationale)``: the edits of a plan.

    ``targets(row, doc_id, i, text, start, end, signals, paragraph)`` are a
    document's sentences to revise, ``members(row, i, passage)`` those in passages.
    """
    found = repeated_additive(targets).withColumn("stock", F.exists("signals", lambda s: s["id"] == "stock-phrases"))
    found = revise(found, mode, drop="drop" if mode == "comprehensive" else None).where("revised <> text")
    opening = F.array(*(F.lit(r) for r, _, _ in P.OPENING_RULES))
    why = F.when(F.size(F.array_except("rules", opening)) > 0, "Tightened redundant or wordy phrasing while preserving the sentence's claims and protected details.").otherwise(
        "Compressed sentence-opening boilerplate while retaining the original claim and qualifiers."
    )
    found = found.join(members.select("row", "i", "passage"), ["row", "i"], "left")
    return found.select("row", "doc_id", "i", "passage", "start", "end", F.col("text").alias("before"), F.col("revised").alias("after"), "rules", why.alias("rationale"))


def plan_status(audited: DataFrame, passages: DataFrame, edits: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """``(row, doc_id, status, passages, edits, guidance)`` of each document's plan.

    ``unavailable`` without a passage to show, ``stale-audit`` if passages
    overlap or the text of ``current(doc_id, text)`` is another one at a
    passage's place, ``ready`` with edits, else ``no-safe-edits``.  ``guidance``
    names the signals of its passages.  Without ``current`` the audited text counts.
    """
    df = passages.select("row", "doc_id", "start", "end", "text", "signals.id")
    wrong = F.coalesce(F.lag("end").over(Window.partitionBy("row").orderBy("start")) > F.col("start"), F.lit(False))
    df = df.withColumn("wrong", wrong)
    if current is not None:
        df = df.join(current.select("doc_id", F.col("text").alias("now")), "doc_id", "left")
        there = F.expr("substring(now, start + 1, end - start)")
        df = df.withColumn("wrong", F.col("wrong") | ~there.eqNullSafe(F.col("text")))
    of = df.groupBy("row").agg(F.count(F.lit(1)).alias("passages"), F.max("wrong").alias("wrong"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("id")))).alias("guidance"))
    number = edits.groupBy("row").agg(F.count(F.lit(1)).alias("edits"))
    out = audited.select("row", "doc_id").join(of, "row", "left").join(number, "row", "left").na.fill(0, ["passages", "edits"])
    status = F.when(F.col("passages") == 0, "unavailable").when(F.col("wrong"), "stale-audit").when(F.col("edits") > 0, "ready").otherwise("no-safe-edits")
    out = out.withColumn("status", status)
    open_ = F.col("status").isin("ready", "no-safe-edits")
    none = F.array().cast("array<string>")
    return out.select("row", "doc_id", "status", F.col("passages"), F.when(open_, F.col("edits")).otherwise(0).alias("edits"), F.when(open_, F.col("guidance")).otherwise(none).alias("guidance"))


def applied(plans: DataFrame, current: DataFrame, revised: DataFrame) -> DataFrame:
    """``(doc_id, status, text)``: the revised text where the plan still holds, else the current one.

    ``plans(doc_id, status, source)`` names the text each plan was made for.
    """
    df = plans.join(current.select("doc_id", F.col("text").alias("now")), "doc_id").join(revised.select("doc_id", F.col("text").alias("new")), "doc_id", "left")
    good = (F.col("now") == F.col("source")) & ~F.col("status").isin("stale-audit", "unavailable") & F.col("new").isNotNull()
    return df.select("doc_id", F.when(good, "applied").otherwise("stale-plan").alias("status"), F.when(good, F.col("new")).otherwise(F.col("now")).alias("text"))


def minor_edits(edits: DataFrame, changed: DataFrame, key: str = "doc_id", most: int = 3, tokens: int = 12) -> DataFrame:
    """``(key, minor)``: whether a plan has few edits that change few tokens; ``changed(key, changed)`` counts them by edit."""
    number = edits.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = changed.groupBy(key).agg(F.sum("changed").alias("t"))
    return number.join(total, key).select(key, ((F.col("n") <= most) & (F.col("t") <= tokens)).alias("minor"))


def last_versions(history: DataFrame, key: str, version: str, most: int = 10) -> DataFrame:
    """What can be undone: the last ``most`` versions of each document."""
    newest = Window.partitionBy(key).orderBy(F.desc(version))
    return history.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")


def compare_audits(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(doc_id, direction, delta)`` from ``(doc_id, status, raw_percent)`` of two versions."""
    b, a = (d.select("doc_id", F.col("status").alias(f"s{n}"), F.col("raw_percent").alias(f"p{n}")) for n, d in enumerate((before, after)))
    delta = F.col("p1") - F.col("p0")
    exact = (F.col("s0") == "exact") & (F.col("s1") == "exact")
    fell = (F.col("s0") == "exact") & (F.col("s1") == "below-reporting-threshold")
    way = F.when(delta < 0, "decreased").when(delta > 0, "increased").otherwise("unchanged")
    return b.join(a, "doc_id").select("doc_id", F.when(fell, "decreased").when(~exact, "unavailable").otherwise(way).alias("direction"), F.when(exact, delta).alias("delta"))
