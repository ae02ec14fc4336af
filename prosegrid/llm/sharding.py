"""Shards of even size with linked documents together: balanced label propagation.

Documents with equal texts are linked through their group.  Each document
starts in a shard by its id.  In every round a group's most frequent shard is
the one its members want; how many may move from one shard to another is a
quota: as many as want to move the other way, and a share of the room that the
wanted shard has.  All of it is joins and grouped counts.

At last all documents are put in one order, by shard, group and id, and the
order is cut into parts of equal count.  Shards then differ by one row at most
whatever the groups are, a group's rows stand together, and a cut goes through
at most one group.  A group of a third of all rows fills several shards; the
order is made by range, with the id and the row in it, so its rows are sorted
by many tasks.

DataFrame functions only: nothing here runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.llm.scratch import Scratch

ROUNDS = 4
#: Rows that a shard may hold above the even share while labels move; the last cut is even.
SLACK = 0.25


GROUP = ["g", "crc", "size"]


def _majority(now: DataFrame) -> DataFrame:
    """Each group with the label that most of its rows have, the smallest of equals."""
    tally = now.groupBy(*GROUP, "label").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", (-F.col("label")).alias("l")))["l"]
    return tally.groupBy(*GROUP).agg((-most).cast("int").alias("best"))


def _propagate(linked: DataFrame, fixed: DataFrame, shards: int, rounds: int, scratch: Scratch) -> DataFrame:
    """``linked(row, id, g, crc, size, label)`` with new labels; ``fixed(label, n)``: rows that stay."""
    now = linked
    for turn in range(rounds):
        wants = scratch.store(now.join(_majority(now), GROUP))
        asked = wants.where("label <> best").groupBy("label", "best").agg(F.count(F.lit(1)).alias("asked"))
        load = (
            wants.groupBy("label").agg(F.count(F.lit(1)).alias("n")).unionByName(fixed).groupBy("label").agg(F.sum("n").alias("n"))
        )
        # Below, every table has at most shards x shards rows.
        everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cap = F.ceil(F.sum("n").over(everything) * (1 + SLACK) / shards)
        room = load.withColumn("room", F.greatest(cap - F.col("n"), F.lit(0))).select(F.col("label").alias("best"), "room")
        back = asked.select(F.col("label").alias("best"), F.col("best").alias("label"), F.col("asked").alias("back"))
        more = F.col("asked") - F.col("swap")
        quota = (
            asked.join(back, ["label", "best"], "left")
            .join(room, "best", "left")
            .withColumn("swap", F.least("asked", F.coalesce("back", F.lit(0))))
            .withColumn("all", F.sum(more).over(Window.partitionBy("best")))
            .withColumn("open", F.least("all", F.coalesce("room", F.col("all"))))
            .withColumn("moving", F.col("swap") + F.coalesce(F.try_divide(more * F.col("open"), "all"), F.lit(0)))
            .select("label", "best", (F.col("moving") / F.col("asked")).alias("part"))
        )
        draw = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        now = scratch.store(
            wants.join(F.broadcast(quota), ["label", "best"], "left").select(
                "row",
                "id",
                *GROUP,
                F.when(draw < F.col("part"), F.col("best")).otherwise(F.col("label")).alias("label"),
            )
        )
    # Who had no room yet goes with the group; the cut into equal counts, in order, comes after.
    return now.join(_majority(now), GROUP).select("row", "id", *GROUP, F.col("best").alias("label"))


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 24,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row.

    ``size`` is the bytes of the text plus 8 and ``text_crc32`` of these bytes;
    a null text has none, like an empty one, and is linked with it.  Counts of
    shards differ by one at most, and slots run from 0 in each.  A null id is
    hashed like any other; repeated rows are rows of their own.  Fewer rows
    than shards leave shards empty; an empty table gives no rows.  Other
    columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    group = GROUP
    bytes_ = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = scratch.store(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(bytes_) + 8).cast("long").alias("size"),
            F.crc32(bytes_).alias("crc"),
            F.xxhash64(bytes_).alias("g"),
        ).withColumn("label", F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(shards)).cast("int"))
    )
    many = scratch.store(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*group))
    linked = scratch.store(rows.join(many, group, "left_semi").select("row", "id", *group, "label"))
    single = scratch.store(rows.join(many, group, "left_anti").select("row", "id", *group, "label"))
    fixed = scratch.store(single.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    placed = _propagate(linked, fixed, shards, rounds, scratch).unionByName(single)
    order = ["label", *group, "id", "row"]
    ordered = scratch.store(
        placed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("id", "size", "crc", F.monotonically_increasing_id().alias("at"))
    )
    part = F.shiftright("at", 33)
    # One row for each partition of the order.
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(everything).alias("all")
    )
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    each, over = F.expr(f"all div {shards}"), F.expr(f"all % {shards}")
    ranked = ordered.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        "id", "size", "crc", rank.alias("rank"), each.alias("each"), over.alias("over")
    )
    large = F.col("over") * (F.col("each") + 1)
    place = F.when(F.col("rank") < large, F.expr("rank div (each + 1)")).otherwise(
        F.col("over") + F.expr("(rank - over * (each + 1)) div greatest(each, 1)")
    )
    slot = F.when(F.col("rank") < large, F.expr("rank % (each + 1)")).otherwise(
        F.expr("(rank - over * (each + 1)) % greatest(each, 1)")
    )
    return ranked.select("id", "size", F.col("crc").alias("text_crc32"), place.cast("int").alias("shard"), slot.alias("slot"))
