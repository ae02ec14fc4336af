"""Passages that repeat across documents, by a sparse suffix array over words.

Only suffixes at *minimiser* positions are retained: of any ``window``
consecutive runs of ``run`` words, the one with the least hash (the leftmost of
equals).  What is selected depends on nothing but the words, so every passage
of ``window + run - 1`` words (50) retains a suffix at the same place in each
document that holds it.

1. The retained suffixes are sorted by their first ``run`` words and then by
   their whole context, ``window - 1`` words to the left and 50 to the right.
   Neighbours with other first words share no passage with the suffix, and
   most suffixes leave here.  Neighbours with the same context share every
   passage around the suffix, whichever documents they are from.
2. What remains shares its first words, not its context.  One suffix of each
   context is extended to the left and right, into the passages of 50 words
   around it; these are sorted and neighbours compared again.  If an earlier
   document is found to hold one of them, the others of the context learn it.
3. The intervals found are merged in each document.

Sorting is by range, so suffixes of one very common passage lie in several
tasks.  A group that a task boundary cuts cannot be judged from one side; its
members are extended as in step 2, or compared with the other side through one
summary row for each task, so the result does not depend on the boundaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.blocks import Spans, Words, lean, text_blocks
from prosegrid.llm.scratch import Scratch

RUN, WINDOW = 25, 26
#: Rows of one group that a task holds before it treats the group as cut.
HELD = 1 << 18


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` consecutive values, the place of the leftmost least."""
    at, now, have = np.arange(len(values)), values, 1
    while have < width and len(now):
        step = min(have, width - have)
        less = now[step:] < now[:-step]
        at = np.where(less, at[step:], at[:-step])
        now = np.where(less, now[step:], now[:-step])
        have += step
    return at


class _Block:
    """Minimisers of the passages of ``run + window - 1`` words of a block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, run: int, window: int):
        self.words = w = Words(data, offsets)
        self.size = run + window - 1
        self.spans = Spans(w.hashes)
        n = len(w.doc)
        grams = self.spans(np.arange(max(0, n - run + 1)), np.arange(run, max(run, n + 1)))
        least = _least(grams, window)
        end = w.hi[w.doc] if n else np.empty(0, np.int64)
        at = np.arange(len(least))
        self.at = at[at + self.size <= end[: len(least)]]
        self.least, self.grams, self.end = least[self.at], grams, end


def _suffixes(run: int, window: int) -> Callable:
    size = run + window - 1

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_blocks(batch.column(1)):
                k = _Block(data, offsets, run, window)
                keep = np.zeros(len(k.words.doc), bool)
                keep[k.least] = True
                p = np.flatnonzero(keep)
                doc = k.words.doc[p]
                left = np.minimum(p - k.words.lo[doc], window - 1)
                right = np.minimum(k.end[p] - p, size)
                full = k.spans(p - left, p + right) ^ (left * 64 + right).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k.grams[p].view(np.int64)),
                        pa.array(full.view(np.int64)),
                        pa.array(ids[a:b][doc]),
                        pa.array((p - k.words.lo[doc]).astype(np.int32)),
                        pa.array(right.astype(np.int32)),
                    ],
                    ["h", "context", "doc", "p", "r"],
                )

    return rows


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _groups(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Sorted rows -> pieces of whole groups of the first column, and cut groups.

    Yields ``(columns, cut)``.  The first and last group of the task and groups
    of over ``held`` rows count as cut; they come by themselves, perhaps in parts.
    """
    rest: list[np.ndarray] | None = None
    first = True  # what stands at the front belongs to a group that counts as cut
    for batch in batches:
        if not batch.num_rows:
            continue
        now = _columns(batch)
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        key = now[0]
        last = int(np.argmax(key == key[-1]))
        if last and first:
            head = int(np.argmax(key != key[0]))
            yield [x[:head] for x in now], True
            now, last, first = [x[head:] for x in now], last - head, False
        if last:
            yield [x[:last] for x in now], False
        rest = [x[last:] for x in now]
        if len(rest[0]) > held:
            yield rest, True
            rest, first = [x[-1:] for x in rest], True
    if rest is not None:
        yield rest, True


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _several(doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the groups that begin at ``lo``: their least document, and whether there is another."""
    low, high = np.minimum.reduceat(doc, lo), np.maximum.reduceat(doc, lo)
    return low, low != high


def _neighbours(window: int, size: int, held: int) -> Callable:
    """Sorted suffixes -> marks ``(doc, s, e, first, at)`` and, with a null ``e``, suffixes to extend.

    ``at`` is where the suffix stands in ``first`` that is extended in place of this one, if one is.
    """

    def judge(cols: list[np.ndarray], cut: bool) -> pa.RecordBatch | None:
        h, context, doc, p, r = cols
        group = _starts(h)
        alone = _starts(h, context)
        number = np.diff(np.append(alone, len(h)))
        low, shared = _several(doc, alone)
        of = np.searchsorted(group, alone, "right") - 1
        low_g, wide = _several(doc, group)
        mixed = (np.bincount(of, minlength=len(group)) > 1) & wide if not cut else np.ones(len(group), bool)
        shared_row, mixed_row, low_row = (np.repeat(x, number) for x in (shared, mixed[of], low))
        head = np.zeros(len(h), bool)
        head[alone] = True
        grow = mixed_row & (head | ~shared_row)
        left = np.minimum(p, window - 1)
        mark = shared_row & (left + r >= size)
        if not (grow.any() or mark.any()):
            return None
        stands_in = (mixed_row & ~head)[mark]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((doc[mark], doc[grow]))),
                pa.array(np.concatenate(((p - left)[mark], p[grow])).astype(np.int32)),
                pa.array(
                    np.concatenate(((p + r)[mark], p[grow])).astype(np.int32),
                    mask=np.concatenate((np.zeros(mark.sum(), bool), np.ones(grow.sum(), bool))),
                ),
                pa.array(np.concatenate((low_row[mark], doc[grow]))),
                pa.array(
                    np.concatenate((np.repeat(p[alone], number)[mark], p[grow])).astype(np.int32),
                    mask=np.concatenate((~stands_in, np.ones(grow.sum(), bool))),
                ),
            ],
            ["doc", "s", "e", "first", "at"],
        )

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, cut in _groups(batches, held):
            out = judge(cols, cut)
            if out is not None:
                yield out

    return rows


def _passages(run: int, window: int) -> Callable:
    """``(doc, text, places)`` -> ``(h, doc, s, p)``: the passages around these suffixes, which stand at ``p``."""

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            places = batch.column(2)
            flat = places.flatten().to_numpy(zero_copy_only=False)
            bound = np.concatenate(([0], np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))))
            for a, b, data, offsets in text_blocks(batch.column(1)):
                k = _Block(data, offsets, run, window)
                own = np.repeat(k.words.lo, np.diff(bound[a : b + 1])) + flat[bound[a] : bound[b]]
                grown = np.zeros(len(k.words.doc) + 1, bool)
                grown[own] = True
                s = k.at[grown[k.least]]
                doc = k.words.doc[s]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k.spans(s, s + k.size).view(np.int64)),
                        pa.array(ids[a:b][doc]),
                        pa.array((s - k.words.lo[doc]).astype(np.int32)),
                        pa.array((k.least[grown[k.least]] - k.words.lo[doc]).astype(np.int32)),
                    ],
                    ["h", "doc", "s", "p"],
                )

    return rows


def _repeated(held: int) -> Callable:
    """Sorted passages -> kind 0: repeated, with its first document; 1: of a cut group; 2: a summary of one."""

    def out(kind: int, h, doc, s, p, first) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(h), kind, np.int32)), *map(pa.array, (h, doc, s, p, first))],
            ["kind", "h", "doc", "s", "p", "first"],
        )

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (h, doc, s, p), cut in _groups(batches, held):
            lo = _starts(h)
            low, several = _several(doc, lo)
            if cut:
                yield out(1, h, doc, s, p, doc)
                yield out(2, h[lo], low, s[lo], p[lo], np.maximum.reduceat(doc, lo))
            else:
                number = np.diff(np.append(lo, len(h)))
                keep = np.repeat(several, number)
                if keep.any():
                    yield out(0, h[keep], doc[keep], s[keep], p[keep], np.repeat(low, number)[keep])

    return rows


def _union(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals sorted by start -> their union, as starts and ends."""
    if not len(s):
        return s, e
    reach = np.maximum.accumulate(e)
    lo = np.flatnonzero(np.concatenate(([True], s[1:] > reach[:-1])))
    return s[lo], np.append(reach[lo[1:] - 1], reach[-1])


@lean
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks sorted by document and start -> spans."""

    def spans(doc: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        base = np.searchsorted(np.unique(doc), doc).astype(np.int64) << 32  # documents apart from each other
        s, e = s + base, e + base
        lo, hi = _union(s, e)
        at = np.searchsorted(s, lo)
        later = first < doc
        clo, chi = _union(s[later], e[later])
        of = np.searchsorted(lo, clo, "right") - 1
        cut = np.bincount(of, chi - clo, len(lo)).astype(np.int32)
        both = np.stack((clo, chi), 1).reshape(-1) & 0xFFFFFFFF
        bound = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(lo)) * 2)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc[at]),
                pa.array((lo & 0xFFFFFFFF).astype(np.int32)),
                pa.array((hi - lo).astype(np.int32)),
                pa.array(cut),
                pa.array(np.minimum.reduceat(first, at)),
                pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(both.astype(np.int32))),
            ],
            ["doc", "start", "words", "duplicate_words", "first_doc", "cuts"],
        )

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = _columns(batch)
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        last = int(np.argmax(now[0] == now[0][-1]))
        if last:
            yield spans(*(x[:last] for x in now))
        rest = [x[last:] for x in now]
    if rest is not None:
        yield spans(*rest)


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    run: int = RUN,
    window: int = WINDOW,
    held: int = HELD,
) -> DataFrame:
    """``(doc, start, words, duplicate_words, first_doc, cuts)``: what other documents hold as well.

    A span is a maximal stretch of words ``[start, start + words)`` covered by
    passages of ``run + window - 1`` words that occur, word for word, in a
    document with another id.  ``first_doc`` is the smallest id that holds one
    of its passages.  ``cuts`` lists start and end of the parts, together
    ``duplicate_words`` long, that a document with a smaller id holds; without
    them every passage stays once.  Words are what ASCII white space separates.

    Nulls: rows with a null id or text take no part.  Rows that share an id are
    one document, so repeats within a document do not count.  Texts shorter
    than a passage, and an empty table, give no spans.  Other columns of
    ``docs`` are not read.
    """
    size = run + window - 1
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("t"))
    rows = rows.where("doc is not null and t is not null")
    kept = scratch.store(
        rows.where(F.octet_length("t") >= 2 * size - 1).mapInArrow(
            _suffixes(run, window), "h long, context long, doc long, p int, r int"
        )
    )
    order = ["h", "context", "doc", "p"]
    judged = scratch.store(
        kept.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_neighbours(window, size, held), "doc long, s int, e int, first long, at int")
    )
    scratch.drop(kept)
    marks = judged.where("e is not null")
    places = judged.where("e is null").groupBy("doc").agg(F.collect_set("s").alias("places"))
    passages = scratch.store(
        rows.join(places, "doc").select("doc", "t", "places").mapInArrow(_passages(run, window), "h long, doc long, s int, p int")
    )
    found = scratch.store(
        passages.repartitionByRange("h", "doc", "s")
        .sortWithinPartitions("h", "doc", "s")
        .mapInArrow(_repeated(held), "kind int, h long, doc long, s int, p int, first long")
    )
    scratch.drop(passages)
    # A few rows for each task; written, so that the join knows its size beforehand and a common passage stays spread.
    across = found.where("kind = 2").groupBy("h").agg(F.min("doc").alias("low"), F.max("first").alias("high"))
    across = scratch.store(across.where("low < high"))
    cut = found.where("kind = 1").select("h", "doc", "s", "p").join(across, "h")
    ends = F.col("s") + F.lit(size)
    grown = found.where("kind = 0").select("doc", "s", ends.alias("e"), "first", "p").unionByName(
        cut.select("doc", "s", ends.alias("e"), F.col("low").alias("first"), "p")
    )
    # Where what was extended has an earlier document, those that it stood for have it too.
    earlier = grown.where("first < doc").groupBy("doc", "p").agg(F.min("first").alias("m"))
    earlier = scratch.store(earlier.select(F.col("doc").alias("first"), F.col("p").alias("at"), "m"))
    told = marks.where("at is not null").join(earlier, ["first", "at"], "left")
    told = told.select("doc", "s", "e", F.least("first", "m").alias("first"))
    marks = marks.where("at is null").select("doc", "s", "e", "first").unionByName(told).unionByName(grown.drop("p"))
    return (
        marks.repartition("doc")
        .sortWithinPartitions("doc", "s")
        .select("doc", "s", "e", "first")
        .mapInArrow(_merge, "doc long, start int, words int, duplicate_words int, first_doc long, cuts array<int>")
    )


def _cut_text(text: bytes, cuts: np.ndarray) -> bytes:
    """The text without these words, each with the white space after it."""
    data = np.frombuffer(text, np.uint8)
    starts = np.append(Words(data, np.array([0, len(data)])).starts, len(data))
    out, at = [], 0
    for lo, hi in np.sort(cuts.reshape(-1, 2), axis=0):
        out.append(text[at : starts[lo]])
        at = max(at, starts[hi])
    return b"".join([*out, text[at:]])


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages that an earlier document holds, other columns as they are.

    Documents of which nothing but white space remains go; all others stay,
    and those without a cut unchanged, whatever nulls or clashing names their
    columns have.  A column ``n_chars`` is counted anew where a text is cut.
    """
    names, types = docs.columns, dict(docs.dtypes)
    at, chars = names.index(text_col), names.index("n_chars") if "n_chars" in names else None
    cuts = (
        spans.where("duplicate_words > 0").groupBy("doc").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    )
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    joined = plain.join(cuts, F.col(f"c{names.index(id_col)}") == F.col("doc"), "left").drop("doc")

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(len(names))
            cols = batch.columns[: len(names)]
            hit = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
            keep = np.ones(batch.num_rows, bool)
            if len(hit):
                texts = cols[at].to_pylist()
                sizes = cols[chars].to_pylist() if chars is not None else None
                for i in hit.tolist():
                    if texts[i] is None:
                        continue
                    texts[i] = _cut_text(texts[i].encode(), np.array(cuts[i].as_py(), np.int64)).decode()
                    keep[i] = bool(texts[i].strip(" \t\n\x0b\x0c\r"))
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                cols[at] = pa.array(texts, cols[at].type)
                if sizes is not None:
                    cols[chars] = pa.array(sizes, cols[chars].type)
            out = pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(names))])
            yield out if keep.all() else out.filter(pa.array(keep))

    schema = ", ".join(f"c{i} {types[n]}" for i, n in enumerate(names))
    return joined.mapInArrow(rows, schema).toDF(*names)
