"""SimHash near-duplicates through a byte-position inverted index.

A 64-bit fingerprint is eight bytes.  Two fingerprints that differ in at most
``b`` bits have at least ``8 - b`` equal bytes at equal positions, so that many
shared positional bytes is the guaranteed minimum.  Posting lists of single
bytes hold a 256th of the corpus each, and tallying them pair by pair grows
with the square of it.  The index is therefore keyed by *sets* of positions of
just the guaranteed size with the bytes there: a pair that reaches the minimum
meets under at least one key, and meets under few others.  Within a key the
shared positional bytes of a pair are tallied, pairs that reach the minimum
are kept (a pair only under the first key that it shares), and their full
fingerprints are compared.

Groups: equal fingerprints are one entry of the index, so exact copies add
nothing to it.  A key with many entries is walked breadth first, which emits a
spanning tree of its links and never the pairs; keys with over ``BLOCK``
entries are cut into blocks, and the pairs of blocks are done by other tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.blocks import lean, mix
from prosegrid.llm.components import connected_components
from prosegrid.llm.scratch import Scratch

#: Entries of one key that one task compares at a time; more are cut in blocks.
BLOCK = 1 << 16
#: Up to this many entries under a key, all pairs are compared at once.
SMALL = 16
SEED = 42


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, A-Z lower-cased, joined by spaces.

    Words are what ASCII white space separates.  Fewer words than ``width``
    make one shingle; no word makes none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """The 64 bits that are set in more than half of the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        votes += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(id, fp)``: the SimHash of every whole text; null counts as empty."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter(
                (fold(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", width)) for t in texts),
                np.uint64,
                len(texts),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def position_masks(matches: int) -> list[int]:
    """Masks that select every set of ``matches`` of the eight byte positions."""
    return [sum(0xFF << 8 * p for p in some) for some in combinations(range(8), matches)]


def _tally(diff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of XORed fingerprints: how many bytes are equal, and the mask of these bytes."""
    equal = diff.view(np.uint8).reshape(-1, 8) == 0
    return equal.sum(1), np.where(equal, 0xFF, 0).astype(np.uint8).view(np.uint64).reshape(-1)


def spanning_links(entries: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between these fingerprints, breadth first.

    Every entry that is reached leaves the rest, so a tight group costs one
    pass; only links that hold (``max_bits`` or fewer differing bits) are used.
    Entries are sorted and the least go first: under all the keys that a group
    shares its members then have the same few parents.
    """
    rest, children, parents = entries, [], []
    while len(rest) > 1:
        queue, rest = deque([rest[0]]), rest[1:]
        while queue and len(rest):
            x = queue.popleft()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                hit, rest = rest[near], rest[~near]
                children.append(hit)
                parents.append(np.full(len(hit), x, np.uint64))
                queue.extend(hit)
    if not children:
        return entries[:0], entries[:0]
    return np.concatenate(children), np.concatenate(parents)


def _nested_forest(entries: np.ndarray, radii: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """One spanning forest of the links within the largest radius that prefers links within the smaller ones.

    Entries are walked in an order of the key's own (``salt``), so under each
    key that a group shares its members have other parents.
    """
    entries = entries[np.argsort(mix(entries ^ np.uint64(salt)), kind="stable")]
    place = {x: i for i, x in enumerate(entries.tolist())}
    top, a, b = list(range(len(entries))), [], []

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for radius in radii:
        if len(a) == len(entries) - 1:
            break
        x, y = spanning_links(entries, radius)
        for u, v in zip(x.tolist(), y.tolist()):
            i, j = find(place[u]), find(place[v])
            if i != j:
                top[i] = j
                a.append(u)
                b.append(v)
    return np.array(a, np.uint64), np.array(b, np.uint64)


def _first_key(masks: list[int], matches: int) -> dict[int, int]:
    """For every mask of equal bytes, the first key's mask that it covers."""
    first = {}
    for size in range(matches, 9):
        for some in combinations(range(8), size):
            mask = sum(0xFF << 8 * p for p in some)
            first[mask] = next(m for m in masks if m & mask == m)
    return first


def _links_of_keys(masks: list[int], matches: int, max_bits: int, block_size: int, small_size: int, radii: tuple[int, ...]) -> Callable:
    """Rows ``(c, fp)`` sorted by key and fingerprint -> links and, of huge keys, blocks."""
    mask_of = np.array(masks, np.uint64)
    first = _first_key(masks, matches)

    def complete(c: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links under keys that are all here."""
        key = fp & mask_of[c]
        edge = np.flatnonzero((c[1:] != c[:-1]) | (key[1:] != key[:-1])) + 1
        lo = np.concatenate(([0], edge))
        size = np.diff(np.concatenate((lo, [len(c)])))
        run = np.repeat(np.arange(len(lo)), size)
        a, b = [], []
        small = np.flatnonzero((size[run] > 1) & (size[run] <= small_size))
        for d in range(1, small_size):
            i = small[small + d < len(c)]
            i = i[run[i + d] == run[i]]
            if not len(i):
                break
            diff = fp[i] ^ fp[i + d]
            shared, equal = _tally(diff)
            i = i[(shared >= matches) & (np.bitwise_count(diff) <= max_bits) & (diff != 0)]
            if len(i):
                equal = _tally(fp[i] ^ fp[i + d])[1]
                own = np.fromiter((first[int(m)] for m in equal), np.uint64, len(i)) == mask_of[c[i]]
                a.append(fp[i[own]])
                b.append(fp[i[own] + d])
        for r in np.flatnonzero(size > small_size):
            group = fp[lo[r] : lo[r] + size[r]]
            x, y = spanning_links(group, max_bits) if len(radii) == 1 else _nested_forest(group, radii, int(c[lo[r]]))
            a.append(x)
            b.append(y)
        none = fp[:0]
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def rows(a, b) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())],
            ["a", "b", "c", "block"],
        )

    def blocks(c: int, fp: np.ndarray, block: int) -> pa.RecordBatch:
        n = len(fp)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(fp.view(np.int64)),
                pa.nulls(n, pa.int64()),
                pa.array(np.full(n, c, np.int32)),
                pa.array(np.full(n, block, np.int32)),
            ],
            ["a", "b", "c", "block"],
        )

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c0, f0, block = np.empty(0, np.int32), np.empty(0, np.uint64), 0
        for batch in batches:
            c = np.concatenate((c0, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)))
            f = np.concatenate((f0, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(c):
                continue
            same = (c == c[-1]) & (f & mask_of[c] == f[-1] & mask_of[c[-1]])
            last = len(c) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last and block:  # the rest of a key that was cut
                end = int(np.argmin((c == c[0]) & (f & mask_of[c] == f[0] & mask_of[c[0]])))
                yield blocks(int(c[0]), f[:end], block)
                yield rows(*spanning_links(f[:end], max_bits))
                c, f, last, block = c[end:], f[end:], last - end, 0
            if last:
                yield rows(*complete(c[:last], f[:last]))
            c0, f0 = c[last:], f[last:]
            while len(f0) > block_size:
                yield blocks(int(c0[0]), f0[:block_size], block)
                yield rows(*spanning_links(f0[:block_size], max_bits))
                c0, f0, block = c0[block_size:], f0[block_size:], block + 1
        if len(f0):
            if block:
                yield blocks(int(c0[0]), f0, block)
                yield rows(*spanning_links(f0, max_bits))
            else:
                yield rows(*complete(c0, f0))

    return run


def _links_of_blocks(max_bits: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, b = spanning_links(np.unique(table.column("fp").to_numpy().view(np.uint64)), max_bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def links(
    fps: DataFrame,
    scratch: Scratch,
    max_bits: int = 4,
    matches: int | None = None,
    block_size: int = BLOCK,
    small_size: int = SMALL,
    radii: tuple[int, ...] | None = None,
) -> DataFrame:
    """``fps(fp)``, each once -> ``(a, b)``: links that connect what is within ``max_bits``.

    With the default ``matches`` (``8 - max_bits``, at most 7 bits) the links
    connect exactly the fingerprints that chains of such pairs connect.  A
    larger number of ``matches`` than that finds part of them, faster.  Keys with
    many entries give one spanning forest; with several ``radii`` (ascending, the
    last one ``max_bits``) it prefers the nearest, and each key has its own.
    """
    matches = 8 - max_bits if matches is None else matches
    if not 1 <= matches <= 8:
        raise ValueError("so many differing bits leave no byte that must be equal")
    masks = position_masks(matches)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    mask = F.element_at(F.array(*map(F.lit, signed)).cast("array<bigint>"), F.col("c") + 1)
    key = F.col("fp").bitwiseAND(mask)
    index = (
        fps.select(F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("c"), "fp")
        .repartition("c", key)
        .sortWithinPartitions("c", key, "fp")
    )
    run = _links_of_keys(masks, matches, max_bits, block_size, small_size, radii or (max_bits,))
    found = scratch.store(index.mapInArrow(run, "a long, b long, c int, block int"))
    pairs = found.where("block is null").select("a", "b")
    cut = found.where("block is not null").select("c", F.col("a").alias("fp"), "block")
    if cut.isEmpty():
        return pairs
    cut = cut.withColumn("k", F.col("fp").bitwiseAND(mask))
    last = cut.groupBy("c", "k").agg(F.max("block").alias("last"))
    both = (
        cut.join(last, ["c", "k"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .where("other <> block")
        .select("c", "k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    )
    more = both.groupBy("c", "k", "i", "j").applyInArrow(_links_of_blocks(max_bits), "a long, b long")
    return pairs.unionByName(more)


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4
) -> DataFrame:
    """``(id, fp, component)`` for every row; component is the smallest id that chains of links reach.

    Fingerprints link at ``max_bits`` or fewer differing bits.  Nulls: a null
    text is an empty one, whose fingerprint is zero like that of any text
    without words; a null id takes part and gets the smallest id that is not
    null (null if its whole component has none).  Repeated rows are returned
    as often as they come.  Empty table: no rows.  Other columns of ``docs``
    are neither read nor returned, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.store(fingerprints(docs, id_col, text_col, width))
    each = scratch.store(rows.groupBy("fp").agg(F.min("id").alias("first")))
    joined = connected_components(links(each.select("fp"), scratch, max_bits), scratch)
    rooted = each.join(joined.withColumnRenamed("node", "fp"), "fp")
    low = rooted.groupBy("root").agg(F.min("first").alias("component"))
    linked = scratch.store(rooted.join(low, "root").select("fp", "component"))
    label = each.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))
    return rows.join(label, "fp").select("id", "fp", "component")


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
