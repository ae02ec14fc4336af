"""Mixing sources to target weights by balanced sampling with the cube method.

The wanted number of copies of a document is its source's target divided by
its source's size.  The whole part is taken as it is; the fraction is an
inclusion probability.  The flight phase moves three undecided probabilities
at a time along the null space of the balancing constraints, tokens and
documents, until one of them is 0 or 1; that document is decided, the next one
takes its place, and both totals have not changed.  A block of documents ends
with at most two undecided ones, and a few that it kept on the ground, each at
most half as large as the one before.  These fly again in blocks, until what is
left of each source is one block; what that leaves, 17 documents at most, is
the landing problem: all its roundings are tried.

The flight needs three documents at a time, so tasks stream their blocks.
Sources are cut into blocks by a hash of the id: a source that holds a third
of all rows is many blocks, in every flight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.llm.blocks import lean
from prosegrid.llm.scratch import Scratch

#: Documents of a source in one block of a flight, on average.
BLOCK = 4096
#: Documents that are kept for the landing.
LAST = 15
TINY = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``(source, size)`` -> ``(source, place, source_size, n, target)``, one row for each source.

    Sources in code-point order, null last, weigh ``weights``, repeating, and
    share the sum of all sizes.  A target stops at ``most`` times its source's
    size; what it can't hold the others share by weight, until none is above.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # One row for each source: these windows are over the list of sources, not over documents.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    each = each.withColumn("place", F.row_number().over(by_name) - 1)
    each = each.withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    )
    full = F.col("source_size") * most
    by_room = Window.orderBy(full / F.col("w"), "place")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0))) / F.sum("w").over(rest)
    each = each.withColumn("share", share).withColumn("fits", full / F.col("w") >= F.col("share"))
    first = F.min(F.when(F.col("fits"), F.struct(full / F.col("w"), "place", "share"))).over(everything)["share"]
    goal = F.least(full.cast("double"), F.col("w") * first)
    return each.select("source", "place", "source_size", "n", F.coalesce(goal, F.lit(0.0)).alias("target"))


def digest_of(text: Column) -> Column:
    """What tells texts apart where rows share an id; null for a null text."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def _noise(a: int, b: int) -> float:
    """A number in [0, 1) that depends on its arguments only."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def _step(active: list[list], turn: float) -> None:
    """Move along the null space of (size, 1) until a probability is 0 or 1."""
    sizes = [a[1] for a in active]
    if len(active) == 3:
        u = [sizes[1] - sizes[2], sizes[2] - sizes[0], sizes[0] - sizes[1]]
        if not any(u):
            u = [1, -1, 0]
    else:
        u = [1, -1]
    up = down = np.inf
    for a, d in zip(active, u):
        if d:
            up = min(up, ((1 - a[2]) if d > 0 else a[2]) / abs(d))
            down = min(down, (a[2] if d > 0 else (1 - a[2])) / abs(d))
    move = up if turn * (up + down) < down else -down
    for a, d in zip(active, u):
        p = a[2] + move * d
        a[2] = 0.0 if p < TINY else 1.0 if p > 1 - TINY else p


class Flight:
    """The flight phase over a stream of ``(row, size, probability, key)``; at most three are undecided."""

    def __init__(self):
        self.active: list[list] = []

    def push(self, row, size: int, p: float, key: int) -> list[list]:
        """Take one more; returns those that this decides, as ``[row, size, 0.0 or 1.0]``."""
        self.active.append([row, size, p])
        return self._settle(3, _noise(key, size))

    def close(self) -> tuple[list[list], list[list]]:
        """What the end decides, and the one or two that stay undecided."""
        done = []
        if len(self.active) == 2 and self.active[0][1] == self.active[1][1]:
            done = self._settle(2, _noise(self.active[0][1], 1))
        left, self.active = self.active, []
        return done, left

    def _settle(self, number: int, turn: float) -> list[list]:
        done = []
        while len(self.active) == number:
            _step(self.active, turn)
            done += [a for a in self.active if a[2] in (0.0, 1.0)]
            self.active = [a for a in self.active if 0 < a[2] < 1]
        return done


def land(left: list[tuple[int, int, float]]) -> list[tuple[int, float]]:
    """The rounding of the last few that comes nearest to their tokens, then to their number.

    All roundings are tried, so they have to be few (``LAST`` and two).
    """
    size, p = (np.array([x[i] for x in left], np.float64) for i in (1, 2))
    every = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(np.float64)
    tokens, number = np.abs((every - p) @ size), np.abs((every - p).sum(1))
    best = every[np.lexsort((np.round(number, 9), np.round(tokens, 6)))[0]]
    return [(row, float(x)) for x, (row, _, _) in zip(best, left)]


def _fly(names: list[str], last: bool):
    """Streams rows sorted by source (and block, unless ``last``) and size, largest first, and replaces their ``p``.

    A few documents, each at most half as large as the one before, are kept on
    the ground: with the last two, sums of these sizes come near to anything.
    """
    group_at = [names.index("place")] + ([] if last else [names.index("block")])
    size_at, p_at, key_at = (names.index(n) for n in ("size", "p", "key"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fly, group, schema = Flight(), None, None
        kept, below = [], np.inf

        def emit(done: list) -> pa.RecordBatch:
            rows = [[p if i == p_at else x for i, x in enumerate(row)] for row, _, p in done]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names
            )

        def close() -> list:
            nonlocal kept, below
            done, left = fly.close()
            left, kept, below = left + kept, [], np.inf
            if last and left:
                picked = land([(i, s, p) for i, (_, s, p) in enumerate(left)])
                left = [[left[i][0], left[i][1], p] for i, p in picked]
            return done + left

        for batch in batches:
            schema, done = batch.schema, []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                mine = [row[i] for i in group_at]
                if mine != group:
                    done += close()
                    group = mine
                if row[size_at] <= below and len(kept) < LAST:
                    kept.append([row, row[size_at], row[p_at]])
                    below = row[size_at] / 2
                else:
                    done += fly.push(row, row[size_at], row[p_at], row[key_at])
            if done:
                yield emit(done)
        done = close()
        if done:
            yield emit(done)

    return run


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    block: int = BLOCK,
) -> DataFrame:
    """``(id, source, size, source_size, target, copies, digest)`` for every row.

    ``size`` is the number of words (null: 0), ``digest`` names the text, and
    ``copies`` is how often the mix takes the document, 0 to ``most``.  The words taken from a source differ
    from its target by what landing the last few documents makes.

    Nulls: a null source is a source of its own, a null text has size 0, a null
    id is hashed like any other value.  Sources without words have target 0.
    Choices depend on ids and sizes only, so reruns agree.  Rows that repeat an
    id are chosen one by one, in no order that could be told from outside.
    Empty table: no rows.  Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.store(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            digest_of(F.col(text_col)).alias("digest"),
        )
    )
    goal = scratch.store(targets(rows.select("source", "size"), weights, most))
    key = F.xxhash64("id", "size")
    wanted = F.least(F.lit(float(most)), F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    base = (
        rows.join(goal.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")))
        .drop("its")
        .withColumn("whole", F.floor(wanted).cast("int"))
        .withColumn("p", wanted - F.floor(wanted))
        .withColumn("key", key)
        .withColumn("block", F.lit(0))
        .select("id", "source", "size", "place", "source_size", "target", "whole", "p", "key", "block", "n", "digest")
    )
    open_ = (F.col("p") > TINY) & (F.col("p") < 1 - TINY)
    order = [F.desc("size"), "key", "id", "digest"]
    decided, now, turn = base.where(~open_), base.where(open_), 0
    largest = goal.agg(F.max("n")).first()[0] or 0
    while largest > block:
        dealt = now.withColumn("block", F.pmod(F.xxhash64("key", F.lit(turn)), F.ceil(F.col("n") / block)).cast("int"))
        dealt = dealt.repartition("place", "block").sortWithinPartitions("place", "block", *order)
        flown = scratch.store(dealt.mapInArrow(_fly(base.columns, False), base.schema))
        decided = decided.unionByName(flown.where(~open_))
        left = flown.where(open_)
        number = scratch.store(left.groupBy("place").agg(F.count(F.lit(1)).alias("n")))  # one row for each source
        now = left.drop("n").join(F.broadcast(number), "place").select(*base.columns)
        fewer = number.agg(F.max("n")).first()[0] or 0
        if fewer >= largest:
            break
        largest, turn = fewer, turn + 1
    last = now.repartition("place").sortWithinPartitions("place", *order)
    decided = decided.unionByName(last.mapInArrow(_fly(base.columns, True), base.schema))
    return decided.select(
        "id", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("int")).alias("copies"), "digest"
    )


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them, repeated by their copies; columns as they are.

    Rows that agree in id, text and source share their copies as evenly as
    whole numbers allow, so as many words are taken as ``mixed`` says.
    """
    names = docs.columns
    same = ["id", "source", "digest"]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: F.col(f"c{names.index(c)}") for n, c in (("id", id_col), ("source", source_col), ("text", text_col))}
    keyed = plain.withColumn("u", at["id"].cast("long")).withColumn("v", at["source"]).withColumn("w", digest_of(at["text"]))
    often = mixed.groupBy(*same).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    meet = F.col("u").eqNullSafe(F.col("id")) & F.col("v").eqNullSafe(F.col("source")) & F.col("w").eqNullSafe(F.col("digest"))
    joined = keyed.join(often, meet).select(*plain.columns, "u", "v", "w", "copies", "n")
    order = Window.partitionBy("u", "v", "w").orderBy(F.lit(0))
    several = joined.where("n > 1").withColumn("k", F.row_number().over(order))
    several = several.withColumn("copies", F.expr("(k * copies) div n - ((k - 1) * copies) div n")).drop("k")
    out = joined.where("n = 1").unionByName(several).where("copies > 0")
    return (
        out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(*plain.columns)
        .toDF(*names)
    )
