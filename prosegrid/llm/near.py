"""Near copies of whole documents: SimHash links most of them, an exact join finds the rest.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more.  A shingle SimHash of 64 bits differs in some ten bits
at that similarity, more than a byte-position index can guarantee to find.  So
a first step takes candidates from a SimHash over the *set of words*, which a
changed word hardly moves: of eight bytes at least three have to be equal and
at most twelve bits differ.  It joins what is easily found; nothing is lost if
it misses a pair, since the second step is complete.

Second step: put the shingles of every text in one order, the same for all.
Two sets of similarity 0.8 share one of the first ``n - ceil(0.8 n) + 1`` of
each (prefix filter).  Shingles that are common in a sample stand last in the
order, so few documents meet under them; any order gives the same pairs.
Documents that meet under a shingle and are not joined yet are paired if sizes,
places and bitmaps leave room for 0.8.  A bitmap has a bit for each of 512
classes of shingles, set if the set holds an odd number of it: two sets differ
in as many shingles at least as their bitmaps differ in bits.  A first round
takes the closest pair of any two components under each shingle, a second one
every pair whose ends are not joined by then.

Whatever proposes a pair, wider bitmaps, of two to four bits for a shingle,
are compared, and of the pairs that these leave, few of them below 0.78, the
sets of shingles themselves before the pair counts.  Equal texts are one entry throughout.  Links are transitive;
of each component the document with the smallest id stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.blocks import Spans, Words, lean, mix, text_blocks
from prosegrid.llm.components import connected_components
from prosegrid.llm.scratch import Scratch
from prosegrid.llm.simhash import SMALL, fold, links

WIDTH, SIMILARITY = 5, 0.8
MATCHES, MAX_BITS = 3, 12
#: One text in so many is read to learn which shingles are common: those in ``COMMON`` of them,
#: or more of a large sample, so that the list stays short.  Only speed depends on it.
SAMPLE, COMMON, LIST = 16, 3, 4096
#: Pairs that are formed at a time, and documents (as the sample tells) under one part of a shingle.
PAIRS, PART = 1 << 18, 1 << 14
#: 64-bit words of a bitmap.
WORDS = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASSES = "c long, t1 long, t2 long, id long, n long"


def bitmap(hashes: np.ndarray, bits: int = 64 * WORDS) -> np.ndarray:
    """Which of so many classes, a power of two, an odd number of these distinct hashes is in."""
    odd = np.bincount((hashes >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def wide_bitmap(hashes: np.ndarray) -> np.ndarray:
    """The same with two to four classes for each hash, 64 at least."""
    return bitmap(hashes, max(64, 1 << (2 * len(hashes) - 1).bit_length()))


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """In how many bits two bitmaps of perhaps different widths differ; classes of the wider one are put together."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        odd = np.unpackbits(x, bitorder="little").reshape(-1, 2)
        x = np.packbits(odd[:, 0] ^ odd[:, 1], bitorder="little")
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def room(na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """How many shingles two sets of these sizes may differ in, at most."""
    return (1 - least) / (1 + least) * (na.astype(np.int64) + nb) + 1e-9


def _own_shingles(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of every text with words: its row, its distinct shingle hashes, sorted, and its distinct word hashes."""
    for a, _, data, offsets in text_blocks(texts):
        w = Words(_LOWER[data], offsets)
        grams, words = Spans(w.hashes), mix(w.hashes)
        for i, (lo, hi) in enumerate(zip(w.lo.tolist(), w.hi.tolist())):
            if hi > lo:
                at = np.arange(lo, max(lo + 1, hi - width + 1))
                yield a + i, np.unique(grams(at, np.minimum(at + width, hi))), np.unique(words[lo:hi])


def _all_shingles(width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own, _ in _own_shingles(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["h"])

    return run


def _describe(width: int, least: float, common):
    """``(id, t, t1, t2)`` -> fingerprint, number of shingles, bitmap, and the first shingles in the common order."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, number = common.value
        for batch in batches:
            at, fa, size, bits, wide, prefix = [], [], [], [], [], []

            def rows() -> pa.RecordBatch:
                mine = pa.array(at, pa.int64())
                out = [batch.column(0).take(mine), batch.column(2).take(mine), batch.column(3).take(mine)]
                out += [pa.array(np.array(fa, np.uint64).view(np.int64)), pa.array(size, pa.int32())]
                out += [pa.array(x, pa.binary()) for x in (bits, wide, prefix)]
                for x in (at, fa, size, bits, wide, prefix):
                    x.clear()
                return pa.RecordBatch.from_arrays(out, ["id", "t1", "t2", "fa", "n", "bits", "wide", "prefix"])

            held = 0
            for i, own, words in _own_shingles(batch.column(1), width):
                weight = np.zeros(len(own), np.int64)
                if len(often):
                    place = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    weight = np.where(often[place] == own, number[place], 0)
                first = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
                at.append(i)
                fa.append(fold(words))
                size.append(len(own))
                bits.append(bitmap(own).tobytes())
                wide.append(wide_bitmap(own).tobytes())
                prefix.append(own[np.lexsort((own, weight))[:first]].tobytes())
                held += 8 * first
                if held > 1 << 22:
                    yield rows()
                    held = 0
            yield rows()

    return run


def _prefixes(common, part: int):
    """``(c, root, n, prefix)`` -> ``(h, part, c, root, n, at)``; shingles that many hold are dealt to parts by ``c``.

    The column ``part`` has the number of parts in its upper half.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, number = common.value
        for batch in batches:
            own = batch.column(3)
            for lo in range(0, batch.num_rows, 256):
                some = [np.frombuffer(own[i].as_buffer(), np.uint64) for i in range(lo, min(lo + 256, batch.num_rows))]
                count = np.array([len(x) for x in some], np.int64)
                h = np.concatenate(some)
                c, root, n = (np.repeat(batch.column(k).slice(lo, 256).to_numpy(zero_copy_only=False), count) for k in range(3))
                parts = np.ones(len(h), np.int64)
                if len(often):
                    place = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    parts = np.where(often[place] == h, np.minimum(-(-number[place] * SAMPLE // part), (1 << 15) - 1), 1)
                at = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
                dealt = (mix(c.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
                columns = [h.view(np.int64), (parts << 16 | dealt).astype(np.int32), c, root, n, at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["h", "part", "c", "root", "n", "at"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Sorted rows -> columns (binary ones as Arrow arrays) of one or more whole groups of the first ``keys`` columns."""

    def join(pieces: list[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(pieces).combine_chunks()

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)])
        last = int(np.argmax((key == key[:, -1:]).all(0)))
        before = rest and tuple(rest[-1].column(i)[-1].as_py() for i in range(keys))
        if rest and (last or before != tuple(key[:, 0].tolist())):
            yield join([*rest, batch.slice(0, last)])
            rest = []
        elif last:
            yield join([batch.slice(0, last)])
        rest.append(batch.slice(last))
    if rest:
        yield join(rest)


def _edges(*keys: np.ndarray) -> np.ndarray:
    """For each row of sorted keys, where its group ends."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[:-1] |= k[1:] != k[:-1]
    new[-1:] = True
    ends = np.flatnonzero(new) + 1
    return ends[np.searchsorted(ends, np.arange(len(new)), "right")]


def _met(least: float):
    """Prefix rows sorted by shingle and part -> those that another row of the shingle may be paired with.

    That is of another root, and as large but for a factor of ``least``.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 2):
            h, part, _, root, n = (table.column(i).to_numpy() for i in range(5))
            order = np.lexsort((n, part, h))
            h, part, root, n = h[order], part[order], root[order], n[order].astype(np.int64)
            same = (h[1:] == h[:-1]) & (part[1:] == part[:-1])
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            several = np.maximum.reduceat(root, first) != np.minimum.reduceat(root, first)
            several = np.repeat(several, np.diff(np.append(first, len(h))))
            close = same & (n[:-1] + 1e-9 >= least * n[1:])
            keep = several & (np.concatenate((close, [False])) | np.concatenate(([False], close)))
            keep |= part >> 16 > 1  # the other parts are not here
            rows = np.sort(order[keep])
            if len(rows):
                yield from table.select([0, 1, 2, 4, 5]).take(pa.array(rows)).combine_chunks().to_batches()

    return run


def _meetings(least: float, closest: bool):
    """``(h, i, j, root, part, c, n, at, bits)`` sorted by the first four -> pairs ``(a, b)`` of different roots that can reach ``least``.

    Under one shingle every pair of documents is looked at whose parts are ``i``
    and ``j``; with ``closest``, only the closest of two roots is returned, with
    the shingle ``h`` if there are others.
    """

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h, i, j, root, part, c, n, at = (table.column(k).to_numpy() for k in range(8))
        bits = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint64).reshape(-1, WORDS)
        end, begin = _edges(h, i, j), _edges(h, i, j, root)
        bound = np.concatenate(([0], np.cumsum(end - begin)))
        for lo in range(0, int(bound[-1]), PAIRS):
            each = np.arange(lo, min(lo + PAIRS, int(bound[-1])))
            x = np.searchsorted(bound, each, "right") - 1
            y = begin[x] + each - bound[x]
            apart = (i[x] == j[x]) | (part[x] != part[y])
            both = np.minimum(n[x] - at[x], n[y] - at[y])  # at most, if this is the first that they share
            good = apart & (both + 1e-9 >= least / (1 + least) * (n[x].astype(np.int64) + n[y]))
            x, y = x[good], y[good]
            far = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
            good = far <= room(n[x], n[y], least)
            x, y, far = x[good], y[good], far[good]
            if not len(x):
                continue
            more = np.zeros(len(x), bool)
            if closest:
                one, two = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
                order = np.lexsort((c[y], c[x], far / (n[x] + n[y]), two, one, h[x]))
                x, y, one, two = x[order], y[order], one[order], two[order]
                first = np.flatnonzero(np.concatenate(([True], (h[x][1:] != h[x][:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
                more = np.diff(np.append(first, len(x))) > 1
                x, y = x[first], y[first]
            a, b = np.minimum(c[x], c[y]), np.maximum(c[x], c[y])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(h[x], mask=~more)], ["a", "b", "h"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 3):
            yield from pairs(table)

    return run


def _possible(least: float):
    """``(a, b, na, nb, x, y)``, sizes and bitmaps -> pairs that can reach ``least``, and how far apart they are."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, WORDS) for i in (4, 5))
                na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
                far = np.maximum(np.bitwise_count(x ^ y).sum(1, dtype=np.int64), np.abs(na - nb))
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far / (na + nb))], ["a", "b", "far"])
                yield out.filter(pa.array(far <= room(na, nb, least)))

    return run


def _closer(least: float):
    """``(a, b, na, nb, x, y)``, sizes and wide bitmaps -> pairs that can reach ``least``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            far = [
                differing(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8))
                for x, y in zip(batch.column(4), batch.column(5))
            ]
            good = pa.array(np.array(far, np.int64) <= room(na, nb, least), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)

    return run


def _shingle_sets(width: int):
    """``(c, t)`` -> ``(c, sorted distinct shingle hashes)``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sets = [], []
            for i, own, _ in _own_shingles(batch.column(1), width):
                at.append(i)
                sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(sets, pa.binary())], ["c", "own"])

    return run


def _compare(least: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both + 1e-9 >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _common(texts: DataFrame, number: int, width: int):
    """Broadcast: shingles that are common in a sample of the texts, sorted, and in how many of them each is."""
    sample = texts.where(F.pmod("t1", F.lit(SAMPLE)) == 0).dropDuplicates(["t1"]).select("id", "t")
    found = sample.mapInArrow(_all_shingles(width), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    found = found.where(F.col("n") >= max(COMMON, number // (SAMPLE * LIST))).toArrow()
    often, times = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(often)
    return texts.sparkSession.sparkContext.broadcast((often[order], times[order]))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), t.alias("t"), F.xxhash64(t).alias("t1"), F.crc32(t).alias("t2"))
    return rows.where("t is not null")


def _same(x: DataFrame, y: DataFrame) -> Column:
    """The same id, null or not, and the same text."""
    return x["id"].eqNullSafe(y["id"]) & (x["t1"] == y["t1"]) & (x["t2"] == y["t2"])


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    least: float = SIMILARITY,
    small_size: int = SMALL,
    part: int = PART,
) -> DataFrame:
    """``(id, t1, t2, keeper, again)``: every id and text, named by two digests, that does not stay.

    ``keeper`` is the smallest id of the component (null is greater than any);
    of texts that share it, one.  With ``again`` the document stays, but comes
    more than once.  Texts without words (null, empty, white space) are
    nobody's copy.  Rows that share an id but not their text are told apart.
    Whole texts are compared; other columns are not read.  ``small_size`` and
    ``part`` decide how work is dealt, not what is found.
    """
    scratch = Scratch(docs.sparkSession, "near")
    texts = _texts(docs, id_col, text_col)
    shared = _common(texts, docs.count(), width)
    described = scratch.store(
        texts.mapInArrow(_describe(width, least, shared), "id long, t1 long, t2 long, fa long, n int, bits binary, wide binary, prefix binary")
    )
    often = scratch.store(described.groupBy("t1", "t2", "id").agg(F.count(F.lit(1)).alias("n")))
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("n"))).alias("f")
    classes = often.groupBy("t1", "t2").agg(first).select("t1", "t2", "f.id", "f.n")
    classes = scratch.store(classes.select(F.monotonically_increasing_id().alias("c"), "*"))
    own = described.withColumnRenamed("n", "size").join(classes, _same(described, classes))
    own = own.select("c", "fa", F.col("size").alias("n"), "bits", "wide", "prefix", F.col("n").alias("times"))
    once, again = own.where("times = 1"), own.where("times > 1").dropDuplicates(["c"])
    own = scratch.store(once.unionByName(again).drop("times"))
    scratch.drop(described)

    def hold(some: DataFrame) -> DataFrame:
        """Of these pairs, written already, those whose sets of shingles are as similar as wanted."""
        met = own.join(some.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c", "left_semi")
        met = scratch.store(met.select("c", "n", "wide"))
        x, y = (met.select(F.col("c").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(w)) for c, w in (("a", "x"), ("b", "y")))
        closer = some.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y")
        some = scratch.store(closer.mapInArrow(_closer(least), "a long, b long"))
        ends = classes.join(some.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c", "left_semi")
        whole = texts.join(ends.drop("n"), _same(texts, ends)).select("c", "t").dropDuplicates(["c"])
        sets = scratch.store(whole.mapInArrow(_shingle_sets(width), "c long, own binary"))
        x = sets.select(F.col("c").alias("a"), F.col("own").alias("x"))
        y = sets.select(F.col("c").alias("b"), F.col("own").alias("y"))
        good = scratch.store(some.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_compare(least), "a long, b long"))
        scratch.drop(sets, met)
        return good

    def grown(joined: DataFrame | None, some: DataFrame) -> DataFrame:
        if joined is not None:
            some = some.unionByName(joined.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        return connected_components(some, scratch)

    # What the SimHash of the set of words finds.
    each = scratch.store(own.groupBy(F.col("fa").alias("fp")).agg(F.min("c").alias("head")))
    near = links(each.select("fp"), scratch, MAX_BITS, MATCHES, small_size=small_size, radii=(3, 7, MAX_BITS)).distinct()
    heads = [each.select(F.col("fp").alias(f), F.col("head").alias(c)) for f, c in (("a", "x"), ("b", "y"))]
    across = near.join(heads[0], "a").join(heads[1], "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    equal = own.select(F.col("fa").alias("fp"), F.col("c").alias("b")).join(each, "fp").where("head <> b").select(F.col("head").alias("a"), "b")
    mine = own.select("c", "n", "bits")
    x, y = (mine.select(F.col("c").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in ("a", "b"))
    found = across.unionByName(equal).distinct().join(x, "a").join(y, "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
    judged = scratch.store(found.mapInArrow(_possible(least), "a long, b long, far double"))
    ends = judged.select(F.explode(F.array("a", "b")).alias("c"), F.struct("far", "a", "b").alias("e"))
    best = scratch.store(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.a", "e.b").distinct())
    joined = grown(None, hold(best))

    def apart(some: DataFrame, *more: str) -> DataFrame:
        ra, rb = (joined.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
        some = some.join(ra, "a", "left").join(rb, "b", "left")
        return some.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", *more)

    rest = scratch.store(apart(judged.join(best, ["a", "b"], "left_anti").select("a", "b")))
    if not rest.isEmpty():
        joined = grown(joined, hold(rest))

    # What it missed: all that share a shingle of their prefixes.
    rooted = lambda some: some.join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    prefixes = rooted(own.select("c", "n", "prefix")).select("c", "root", "n", "prefix")
    prefixes = prefixes.mapInArrow(_prefixes(shared, part), "h long, part int, c long, root long, n int, at int")
    met = prefixes.repartition("h", "part").sortWithinPartitions("h", "part")
    met = scratch.store(met.mapInArrow(_met(least), "h long, part int, c long, n int, at int"))

    def meetings(rows: DataFrame, closest: bool) -> DataFrame:
        parts, own_part = F.shiftright("part", 16), F.col("part").bitwiseAND(F.lit(0xFFFF))
        cells = rooted(rows).join(mine.select("c", "bits"), "c").withColumn("k", F.explode(F.sequence(F.lit(0), parts - 1)))
        cells = cells.withColumn("part", own_part).withColumn("i", F.least("part", "k")).withColumn("j", F.greatest("part", "k"))
        cells = cells.select("h", "i", "j", "root", "part", "c", "n", "at", "bits").repartition("h", "i", "j")
        cells = cells.sortWithinPartitions("h", "i", "j", "root", "c")
        return scratch.store(cells.mapInArrow(_meetings(least, closest), "a long, b long, h long"))

    some = meetings(met, True)
    joined = grown(joined, hold(scratch.store(some.select("a", "b").distinct())))
    # Roots that are still apart, with more pairs under a shingle than the closest.
    open_ = some.where("h is not null")
    left = scratch.store(apart(open_, "h").select("h").distinct())
    if not left.isEmpty():
        rest = meetings(met.join(left, "h", "left_semi"), False)
        rest = rest.select("a", "b").distinct().join(some.select("a", "b").distinct(), ["a", "b"], "left_anti")
        joined = grown(joined, hold(scratch.store(rest)))

    rooted_classes = classes.join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    rooted_classes = scratch.store(rooted_classes)
    keep = rooted_classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "c")).alias("k"))
    keep = rooted_classes.join(keep.select("root", F.col("k.id").alias("keeper"), F.col("k.c").alias("kc")), "root")
    keep = keep.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("id").alias("own"), "n", "keeper", (F.col("c") == F.col("kc")).alias("stays"))
    said = often.drop("n").join(keep, (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")))
    first = F.col("stays") & F.col("id").eqNullSafe(F.col("own"))
    said = said.withColumn("again", first).where(~F.col("again") | (F.col("n") > 1))
    return scratch.store(said.select("id", "t1", "t2", "keeper", "again"))


def without_near_copies(docs: DataFrame, copies: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without what ``copies`` lists; of rows that repeat a document that stays, one."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    t = F.col(f"c{names.index(text_col)}").cast("binary")
    plain = plain.withColumn("id", F.col(f"c{names.index(id_col)}").cast("long")).withColumn("t1", F.xxhash64(t)).withColumn("t2", F.crc32(t))
    said = copies.select(F.col("id").alias("u"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "again")
    same = F.col("id").eqNullSafe(F.col("u")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2"))
    joined = plain.join(said, same, "left").select(*plain.columns, "again")
    out = joined.where("again is null")
    if not said.where("again").isEmpty():
        out = out.unionByName(joined.where("again").dropDuplicates(["t1", "t2"]))
    return out.drop("id", "t1", "t2", "again").toDF(*names)
