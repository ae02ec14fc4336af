"""The 22 features of a window of sentences, and the logistic model.

``windowed`` measures all windows of a document, each sentence once, in an
Arrow function; ``with_features`` measures any column of texts by expressions.
Both give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrid.functions import constants as C
from prosegrid.functions import tokens as T
from prosegrid.operators import window_features

NAMES = [name for name, *_ in C.FEATURES]


@dataclass(frozen=True)
class Profile:
    """A calibrated model: ``(feature, mean, scale, coefficient)`` in the order of ``NAMES``, and its thresholds."""

    features: tuple = C.FEATURES
    intercept: float = C.INTERCEPT
    threshold: float = C.THRESHOLD
    long_word_bound: float = C.LONG_WORD_BOUND
    lexical_bound: float = C.LEXICAL_BOUND
    lexical: tuple = C.LEXICAL


PROFILE = Profile()


def profile_rows(spark: SparkSession, profile: Profile = PROFILE) -> DataFrame:
    """A model as a table, to be kept: ``(no, feature, mean, scale, coefficient, lexical, intercept, threshold, long_word_bound, lexical_bound)``."""
    rows = [
        (i, n, float(m), float(s), float(w), n in profile.lexical, profile.intercept, profile.threshold, profile.long_word_bound, profile.lexical_bound)
        for i, (n, m, s, w) in enumerate(profile.features)
    ]
    kinds = "no int, feature string, mean double, scale double, coefficient double, lexical boolean, intercept double, threshold double, long_word_bound double, lexical_bound double"
    return spark.createDataFrame(rows, kinds)


def profile_of(rows: DataFrame) -> Profile:
    """The model that such a table, one row for each feature, holds."""
    found = rows.orderBy("no").collect()
    if [r["feature"] for r in found] != NAMES:
        raise ValueError("a profile has the features of the model, in order")
    r = found[0]
    return Profile(
        tuple((x["feature"], x["mean"], x["scale"], x["coefficient"]) for x in found),
        r["intercept"], r["threshold"], r["long_word_bound"], r["lexical_bound"], tuple(x["feature"] for x in found if x["lexical"]),
    )


def _bare(word: Column) -> Column:
    return F.length(F.regexp_replace(word, "['’]", ""))


def with_features(df: DataFrame, text: str = "window_text") -> DataFrame:
    """Adds the features, in the model's order; all are 0 for a text without words and sentences.

    Arrays that several features need are columns, so each is made once.
    """
    t, keep = F.col(text), df.columns
    stop = F.array(*map(F.lit, C.STOPWORDS))
    lists = {"hedge": C.HEDGES, "first": C.FIRST_PERSON, "stop": C.STOPWORDS}
    df = df.withColumn("_s", T.sentences(t)).withColumn("_w", T.words(t))
    df = df.withColumn("_lw", F.transform("_w", F.lower)).withColumn("_sw", F.transform("_s", T.words))
    df = df.withColumn("_sorted", F.array_sort("_lw")).withColumn("_len", F.transform("_sw", F.size))
    df = df.withColumn(
        "_sets",
        F.transform(
            "_sw",
            lambda ws: F.array_distinct(
                F.filter(F.transform(ws, F.lower), lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))
            ),
        ),
    ).withColumn(
        "_open",
        F.filter(F.transform("_sw", lambda ws: F.lower(F.array_join(F.slice(ws, 1, 2), " "))), lambda x: x != ""),
    )
    n, m, lw = F.size("_s"), F.size("_w"), F.col("_lw")
    df = df.withColumn("_mean", T.ratio(T.total(F.col("_len")), n)).withColumn("_kinds", F.size(F.array_distinct("_lw")))
    mean = F.col("_mean")
    sd = F.sqrt(T.ratio(T.total(F.transform("_len", lambda x: (x - mean) * (x - mean))), n))
    srt = F.col("_sorted")
    once = F.filter(
        srt,
        lambda x, i: F.coalesce(F.get(srt, i - 1) != x, F.lit(True)) & F.coalesce(F.get(srt, i + 1) != x, F.lit(True)),
    )

    def overlap(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return T.ratio(both, F.size(a) + F.size(b) - both)

    sets = F.col("_sets")
    adjacent = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: overlap(F.get(sets, i - 1), F.get(sets, i))))
    stock = sum((T.count(t, f"(?i){p}") for p in C.STOCK), F.lit(0))
    among = lambda name: T.how_many(lw, lambda x: x.isin(*lists[name]))
    values = {
        "mean_sentence_words": mean,
        "sentence_length_cv": T.ratio(sd, mean),
        "short_sentence_ratio": T.ratio(T.how_many(F.col("_len"), lambda x: x <= 8), n),
        "long_sentence_ratio": T.ratio(T.how_many(F.col("_len"), lambda x: x >= 28), n),
        "mean_word_length": T.ratio(T.total(F.transform("_lw", _bare)), m),
        "repeated_word_ratio": F.when(m > 0, 1 - T.ratio(F.col("_kinds"), m)).otherwise(0.0),
        "hapax_ratio": T.ratio(F.size(once), F.col("_kinds")),
        "stopword_ratio": T.ratio(among("stop"), m),
        "first_person_ratio": T.ratio(among("first"), m),
        "contraction_ratio": T.ratio(T.how_many(F.col("_w"), lambda x: x.rlike("['’]")), m),
        "numeric_token_ratio": T.ratio(T.how_many(F.col("_w"), lambda x: x.rlike(r"^\p{N}")), m),
        "comma_per_sentence": T.ratio(T.count(t, ","), n),
        "semicolon_colon_per_sentence": T.ratio(T.count(t, "[;:]"), n),
        "parenthetical_dash_per_sentence": T.ratio(T.count(t, r"[()—–]|\s-\s"), n),
        "transition_opening_ratio": T.ratio(
            T.how_many(F.col("_s"), lambda x: x.rlike(rf"(?i)^(?:{C.OPENINGS})(?![A-Za-z0-9_])")), n
        ),
        "stock_phrase_per_sentence": T.ratio(stock, n),
        "nominalization_ratio": T.ratio(T.how_many(lw, lambda x: (F.length(x) > 5) & x.rlike(C.SUFFIX)), m),
        "adjacent_sentence_overlap": F.when(n > 1, T.ratio(T.total(adjacent), n - 1)).otherwise(0.0),
        "repeated_opener_ratio": F.when(
            F.size("_open") > 0, 1 - T.ratio(F.size(F.array_distinct("_open")), F.size("_open"))
        ).otherwise(0.0),
        "proper_noun_ratio": T.ratio(
            T.total(
                F.transform("_sw", lambda ws: T.how_many(ws, lambda x, i: (i > 0) & x.rlike(r"^\p{Lu}")))
            ),
            m,
        ),
        "passive_construction_ratio": T.ratio(T.count(t, "(?i)" + T.ascii_edges(C.PASSIVE)), n),
        "hedge_ratio": T.ratio(among("hedge"), m),
    }
    return df.select(*keep, *(values[name].alias(name) for name in NAMES))


def contributions(x: Column, profile: Profile = PROFILE) -> list[Column]:
    """What each feature of an array in the model's order adds to the logit."""
    return [(x[i] - mean) / scale * weight for i, (_, mean, scale, weight) in enumerate(profile.features)]


def logit(parts: list[Column], profile: Profile = PROFILE) -> Column:
    out = F.lit(profile.intercept)
    for part in parts:
        out = out + part
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def with_likelihood(df: DataFrame, profile: Profile = PROFILE) -> DataFrame:
    """Adds each feature's contribution ``c_*``, the logit, summed in the model's order, and the probability."""
    parts = {f"c_{name}": (F.col(name) - mean) / scale * weight for name, mean, scale, weight in profile.features}
    df = df.withColumns(parts).withColumn("logit", logit([F.col(p) for p in parts], profile))
    return df.withColumn("probability", sigmoid(F.col("logit")))


def characteristics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the share of long words and of sentences with a citation."""
    words = F.filter(T.words(F.col(text)), lambda x: x.rlike(r"^\p{L}"))
    citation = "(?i)" + C.CITATION.replace(r"\b", r"(?<![A-Za-z0-9_])")
    found = T.sentences(F.col(text))
    return (
        df.withColumn("_words", words)
        .withColumn("_found", found)
        .withColumn("long_word_ratio", T.ratio(T.how_many(F.col("_words"), lambda x: _bare(x) >= C.LONG_WORD), F.size("_words")))
        .withColumn("citation_sentence_ratio", T.ratio(T.how_many(F.col("_found"), lambda x: x.rlike(citation)), F.size("_found")))
        .drop("_words", "_found")
    )


def statistical_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, end)``: windows over the sentences of the raw text."""
    n = F.size(T.sentences(F.coalesce(F.col(text_col), F.lit(""))))
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(T.window_ranges(n)).alias("r"))
    return found.select("doc_id", "r.start", "r.end")


def windowed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, end, features...)`` of the same windows, sentences tokenised once; a null text is an empty one."""
    names = ["doc_id", "start", "end", *NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                whose, rows = [], []
                for i, text in enumerate(texts.slice(at, 256).to_pylist(), at):
                    found = window_features.of_sentences(window_features.split(text or ""))
                    whose += [i] * len(found)
                    rows += [(a, b, *x) for a, b, x in found]
                if rows:
                    first, last, *x = zip(*rows)
                    columns = [pa.array(first, pa.int32()), pa.array(last, pa.int32()), *(pa.array(c, pa.float64()) for c in x)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(whose)), *columns], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, start int, end int, " + ", ".join(f"{n} double" for n in NAMES))
