"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are read as code points; every n-gram of 1, 2 and 3 of them is hashed to
one of 2^16 buckets.  Training sums bucket counts for each label in each task
and then over tasks.  The model is one row of log-probabilities for each label,
kept as integers in units of 2^-20, so sums do not depend on their order and
reruns agree to the last digit.  It is broadcast: its size is the number of
distinct labels times 256 kB, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.blocks import code_points, lean, text_blocks

BUCKETS = 1 << 16
#: Distinct labels at most: a task counts 512 kB for each, and the model that is broadcast has 256 kB.
MOST_LABELS = 256
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNIT = 1 << 20
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


#: Units of a mean log-probability and of one over a number of n-grams, for sums that do not depend on their order.
FINE, PART = 1 << 10, 1 << 20


@dataclass(frozen=True)
class Model:
    """Labels in code-point order, and for each its integer log-probabilities."""

    langs: list[str]
    grams: np.ndarray
    prior: np.ndarray


def _grams(points: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that lie in one text, and how many each text has."""
    n = len(points) - order + 1
    sizes = np.maximum(np.diff(offsets) - order + 1, 0)
    if n <= 0:
        return np.empty(0, np.int64), sizes
    wide = points.astype(np.uint64)
    h = np.full(n, order, np.uint64)
    for j in range(order):
        h += wide[j : j + n] * _STEPS[j]
    h *= np.uint64(0xD6E8FEB86659FD93)
    inside = np.arange(n) + order <= np.repeat(offsets[1:], np.diff(offsets))[:n]
    return (h >> np.uint64(48)).astype(np.int64)[inside], sizes


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows that have a text and a label; nothing else of them is read.

    Rows with a null text or label are left out, and repeated rows count as
    often as they come.  An empty table gives a model without labels.  More
    than ``MOST_LABELS`` distinct labels raise ``ValueError``: they are no
    languages, and the model would not be small any more.
    """
    labels = docs.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(MOST_LABELS + 1).count()
    if labels > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} distinct labels")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, data, offsets in text_blocks(batch.column(0)):
                points, offsets, _ = code_points(data, offsets)
                labels, of = np.unique(np.array(langs[a:b], object).astype(str), return_inverse=True)
                for k, lang in enumerate(labels.tolist()):
                    rows[lang] = rows.get(lang, 0) + int((of == k).sum())
                    totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for order in ORDERS:
                    grams, sizes = _grams(points, offsets, order)
                    whose = np.repeat(of, sizes)
                    for k, lang in enumerate(labels.tolist()):
                        totals[lang] += np.bincount(grams[whose == k], minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(at) + 1)),
                    pa.array(np.append(at, -1).astype(np.int32)),
                    pa.array(np.append(total[at], rows[lang])),
                ],
                ["lang", "bucket", "n"],
            )

    rows = docs.select(F.col(text_col).cast("binary").alias("t"), F.col(lang_col).cast("string").alias("l"))
    found = (
        rows.where("t is not null and l is not null")
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    labels = np.array(found.column("lang").to_pylist(), object).astype(str)
    langs, of = np.unique(labels, return_inverse=True)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    counts, docs_of = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    gram = bucket >= 0
    counts[of[gram], bucket[gram]] = n[gram]
    docs_of[of[~gram]] = n[~gram]
    p = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    prior = np.rint(np.log(docs_of / max(docs_of.sum(), 1)) * UNIT).astype(np.int64)
    return Model(langs.tolist(), np.rint(np.log(p) * UNIT).astype(np.int32), prior)


@dataclass(frozen=True)
class Norms:
    """For each label of a model: the mean log-probability of an n-gram in its texts, and its variance ``wide + thin / n``."""

    mean: np.ndarray
    wide: np.ndarray
    thin: np.ndarray

    def unlike(self, label: np.ndarray, each: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many standard deviations texts of ``n`` n-grams lie below their label's mean."""
        return (self.mean[label] - each) / np.sqrt(self.wide[label] + self.thin[label] / np.maximum(n, 1))


def _sums(model: Model, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of texts: log-probabilities by label, how many n-grams, and whether there is a letter."""
    for _, _, data, offsets in text_blocks(texts):
        points, offsets, text = code_points(data, offsets)
        total, number = np.repeat(model.prior[:, None], len(offsets) - 1, 1), np.zeros(len(offsets) - 1, np.int64)
        for order in ORDERS:
            grams, sizes = _grams(points, offsets, order)
            number += sizes
            bound = np.concatenate(([0], np.cumsum(sizes)))
            for k in range(len(model.langs)):
                sums = np.concatenate(([0], np.cumsum(model.grams[k][grams], dtype=np.int64)))
                total[k] += sums[bound[1:]] - sums[bound[:-1]]
        letter = [any(map(str.isalpha, text[offsets[i] : offsets[i + 1]])) for i in range(len(offsets) - 1)]
        yield total, number, np.array(letter, bool)


def scores(model: Model, texts: pa.Array, norms: Norms | None = None) -> tuple:
    """The label and its posterior probability for each text; ``und``, 0 without a letter or a model.

    With ``norms``, also how many standard deviations the text is less likely than the texts of its label.
    """
    langs, best, far = [], [], []
    for total, number, letter in _sums(model, texts):
        if not len(model.langs):
            letter[:] = False
        top = total.argmax(0) if len(model.langs) else np.zeros(len(letter), np.int64)
        if len(model.langs):
            p = 1 / np.exp((total - total.max(0)) / UNIT).sum(0)
            each = (total.max(0) - model.prior[top]) / UNIT / np.maximum(number, 1)
            far.append(norms.unlike(top, each, number) if norms else np.zeros(len(letter)))
        for i, known in enumerate(letter.tolist()):
            langs.append(model.langs[top[i]] if known else "und")
            best.append(round(float(p[i]), 9) if known else 0.0)
    out = langs, np.array(best, np.float64)
    return (*out, np.concatenate([np.empty(0), *far]) if len(model.langs) else np.zeros(len(langs))) if norms else out


def norms(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> Norms:
    """How likely an n-gram is in the texts of each label: of all labelled rows with a letter, each under its own label.

    The variance of a text's mean has a part that all lengths share and one in
    proportion to 1/n; both by least squares over the rows (only the second if all have one length).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        at = {lang: k for k, lang in enumerate(own.langs)}
        for batch in batches:
            label = np.array([at.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            done = 0
            for total, number, letter in _sums(own, batch.column(0)):
                of = label[done : done + len(number)]
                done += len(number)
                use = np.flatnonzero(letter & (of >= 0))
                each = (total[of[use], use] - own.prior[of[use]]) / UNIT / number[use]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of[use]), pa.array(np.rint(each * FINE).astype(np.int64)), pa.array(PART // number[use])], ["k", "x", "r"]
                )

    rows = docs.select(F.col(text_col).cast("binary").alias("t"), F.col(lang_col).cast("string").alias("l"))
    each = rows.where("t is not null and l is not null").mapInArrow(run, "k long, x long, r long")
    whole = [F.sum(F.expr(e).cast("decimal(38,0)")).alias(f"s{i}") for i, e in enumerate(("1", "x", "x * x", "r", "r * r", "x * r", "x * x * r"))]
    mean, wide, thin = np.zeros(len(model.langs)), np.ones(len(model.langs)), np.zeros(len(model.langs))
    for row in each.groupBy("k").agg(*whole).collect():
        n, x, xx, r, rr, xr, xxr = (float(row[f"s{i}"]) / u for i, u in enumerate((1, FINE, FINE**2, PART, PART**2, FINE * PART, FINE**2 * PART)))
        m = x / n
        u, ur = xx - m * x, xxr - 2 * m * xr + m * m * r  # squared distances from the mean, and those over n
        spread = n * rr - r * r
        b = max(0.0, (n * ur - r * u) / spread) if spread > 1e-9 * n * rr else u / r
        if b * r > u:
            b = u / r
        k = row["k"]
        mean[k], wide[k], thin[k] = m, max(u / n - b * r / n, 1e-4), b
    return Norms(mean, wide, thin)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``keep`` columns of every row, and ``lang_pred`` and ``score`` (0 to 1) of its whole text.

    A null text, an empty one and one without a letter are ``und`` with score
    0, as is everything if the model has no label.  Ties go to the label that
    is first in code-point order.  Only the text is used for the prediction.
    """
    keep = keep or {}
    plain = docs.select(*(c.alias(f"k{i}") for i, c in enumerate(keep.values())), F.col(text_col).cast("binary").alias("t"))
    shared, kept = docs.sparkSession.sparkContext.broadcast(model), len(keep)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, p = scores(shared.value, batch.column(kept))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(langs, pa.string()), pa.array(p)],
                [*batch.schema.names[:kept], "lang_pred", "score"],
            )

    schema = "".join(f"{n} {t}, " for n, t in plain.dtypes[:-1]) + "lang_pred string, score double"
    return plain.mapInArrow(run, schema).toDF(*keep, "lang_pred", "score")


def in_known_language(
    docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text", norms: Norms | None = None, most: float = 6.0
) -> DataFrame:
    """The rows, unchanged, whose text has a language that the model names with ``least`` probability or more.

    The probability is among the labels of the model, and near 1 for any text
    of some length.  With ``norms`` texts also go whose n-grams are less likely,
    on average, than those of their label's texts by over ``most`` standard deviations.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    shared = docs.sparkSession.sparkContext.broadcast((model, norms))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, usual = shared.value
        for batch in batches:
            langs, p, *far = scores(own, batch.column(at).cast(pa.binary()), usual)
            good = np.array([x != "und" for x in langs], bool) & (p >= least)
            if far:
                good &= far[0] <= most
            yield batch.filter(pa.array(good))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
