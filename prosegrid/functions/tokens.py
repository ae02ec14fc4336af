"""Tokenizers, splitters and ratios as Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from prosegrid.functions import constants as C


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def sentences(text: Column) -> Column:
    """Splits at every run of sentence marks with the closers after it; pieces are trimmed, blank ones dropped."""
    return F.filter(F.transform(find_all(text, C.SENTENCE), trimmed), lambda s: s != "")


def words(text: Column) -> Column:
    return find_all(text, C.WORD)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; 0 if ``b`` is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def how_many(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def ascii_edges(pattern: str) -> str:
    """``pattern`` between ASCII word edges, which Java's ``\\b`` is not."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def window_ranges(n: Column, size: int = 7, stride: int = 3, least: int = 5) -> Column:
    """Ranges of ``size`` sentences every ``stride``, the last one at the end; one for all if there are few."""
    last = F.greatest(n - size, F.lit(0))
    starts = F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
    many = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end")))
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    none = F.filter(whole, lambda x: F.lit(False))
    return F.when(n == 0, none).when(n <= size, whole).otherwise(many)


def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode's compatibility form NFKC of a column; texts of ASCII alone are in that form."""
    compatible = F.pandas_udf(_compatible, StringType())
    plain = text.isNull() | ~text.rlike(r"[^\x00-\x7F]")
    return F.when(plain, text).otherwise(compatible(F.when(~plain, text)))
