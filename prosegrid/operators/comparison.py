"""Differences between two versions of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.functions import constants as C
from prosegrid.functions import tokens as T


def next_versions(turns: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """``(group, order, before, after)``: each text and the one that follows it."""
    following = F.lead(text).over(Window.partitionBy(group).orderBy(order))
    return turns.select(group, order, F.col(text).alias("before"), following.alias("after")).where("after is not null")


def changed_tokens(pairs: DataFrame, keys: list[str], pattern: str = C.EDIT_TOKEN) -> DataFrame:
    """``keys`` and ``changed``: how many tokens, lower-cased, one side has more of than the other."""
    found = lambda c: T.find_all(F.lower(c), pattern)
    side = lambda c, sign: F.transform(found(F.coalesce(c, F.lit(""))), lambda x: F.struct(x.alias("t"), F.lit(sign).alias("n")))
    each = pairs.select(*keys, F.explode_outer(F.concat(side(F.col("before"), 1), side(F.col("after"), -1))).alias("x"))
    summed = each.groupBy(*keys, "x.t").agg(F.abs(F.sum("x.n")).alias("d"))
    return summed.groupBy(*keys).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("changed"))


def direction(before, after):
    return F.when(after < before, "decreased").when(after > before, "increased").otherwise("unchanged")
