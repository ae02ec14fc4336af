"""URL filters: rules, and for hosts without one, propagation over the link graph.

Personalised PageRank starts at trusted hosts, those with pages that a rule
allows, and follows links forward; distrust starts at hosts with pages that a
rule blocks and follows links backward, to those who link there.  Both are
iterated joins over distinct host pairs in integers, so sums do not depend on
their order.  A host without a rule is blocked if its distrust exceeds its
trust times a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.scratch import Scratch

#: (verdict, host, path), as text ``host`` + ``path``.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
ROUNDS = 12
MASS = 10**12
DAMPING = 85
#: What each kind spreads here, in whole units of decimal(38); a host that is reached has one unit at least.
#: ``MASS`` and ``ROUNDS`` are those of the SQL, which cannot go on until ranks settle.
UNITS = 10**28
#: Ranks have settled when none changes by more than this part of it.
SETTLED = 1e-6
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _by_rule(rules, host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null; rules of one length in the order given."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def propagate(seeds: DataFrame, edges: DataFrame, scratch: Scratch, rounds: int | None = None) -> DataFrame:
    """``seeds(kind, host, n)`` and ``edges(src, dst)``, each once -> ``(host, trust, distrust)``.

    ``kind`` is ``t`` or ``d``; each kind spreads ``UNITS`` over its seeds by
    ``n``.  What a host without a link hands on is lost.  Hosts that neither
    kind reaches are not in the result.  Rounds go on until one reaches no new
    host and changes no rank by over ``SETTLED`` of it (damping sees to that),
    or to a number of ``rounds`` if one is given.
    """
    whole = lambda e: F.expr(f"cast(greatest(floor({e}), 1) as decimal(38,0))").alias("mass")
    total = seeds.groupBy("kind").agg(F.sum("n").cast("decimal(38,0)").alias("total"))
    start = scratch.store(
        seeds.join(F.broadcast(total), "kind").select(  # two rows
            "kind", "host", whole(f"cast(cast(n as decimal(10,0)) * {UNITS} as decimal(38,0)) / total")
        )
    )
    steps = edges.select(F.lit("t").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to")).unionByName(
        edges.select(F.lit("d").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"))
    )
    degree = steps.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("degree"))
    steps = scratch.store(steps.join(degree, ["kind", "host"]))
    stay = start.select("kind", "host", whole(f"mass * {100 - DAMPING} / 100"))
    now = start
    done = steps.isEmpty() or rounds == 0
    turn = 0
    while not done:
        sent = now.join(steps, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), whole(f"mass * {DAMPING} / (100 * degree)")
        )
        new = scratch.store(stay.unionByName(sent).groupBy("kind", "host").agg(F.sum("mass").cast("decimal(38,0)").alias("mass")))
        was = now.select("kind", "host", F.col("mass").cast("double").alias("was"))
        moved = new.join(was, ["kind", "host"], "left").where(
            F.expr(f"was is null or abs(cast(mass as double) - was) > {SETTLED} * cast(mass as double)")
        )
        turn += 1
        done = turn == rounds or moved.isEmpty()
        if now is not start:
            scratch.drop(now)
        now = new
    if now is start:
        now = stay
    return now.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "t", F.col("mass")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "d", F.col("mass")).otherwise(0)).alias("distrust"),
    )


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: tuple = RULES,
    rounds: int | None = None,
    threshold: float = 1.0,
) -> DataFrame:
    """``(id, host, path, rule, verdict, trust, distrust)`` for every row.

    A rule fits its host and all subdomains if the path starts with its path;
    the longest one decides.  Else the host does: ``block`` if distrust is over
    ``threshold`` times trust, ``allow`` if not, so hosts that neither reaches
    are allowed.  Null urls and those without ``://`` have an empty host and
    path and no rule, and are allowed unless links say otherwise.  Null ids and
    repeated rows are returned as they come; a null html has no links.  The
    rules are configuration: they are compiled into the plan.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = (
        pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
        .withColumn("rule", _by_rule(rules, F.col("host"), F.col("path"), lambda r: r[1] + r[2]))
        .withColumn("ruled", _by_rule(rules, F.col("host"), F.col("path"), lambda r: r[0]))
    )
    judged = scratch.store(judged)
    seeds = (
        judged.where("ruled is not null")
        .groupBy(F.when(F.col("ruled") == "allow", "t").otherwise("d").alias("kind"), "host")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    linked = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1)).alias("dst"))
    edges = linked.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst and src <> ''").distinct()
    ranks = scratch.store(propagate(seeds, scratch.store(edges), scratch, rounds))
    return (
        judged.join(ranks, "host", "left")
        .withColumn("trust", F.coalesce("trust", F.lit(0)))
        .withColumn("distrust", F.coalesce("distrust", F.lit(0)))
        .withColumn(
            "verdict",
            F.coalesce("ruled", F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")),
        )
        .select("id", "host", "path", "rule", "verdict", "trust", "distrust")
    )
