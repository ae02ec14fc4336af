"""Keyed state over time-ordered requests: a sliding-log limiter and snapshots that expire."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, SECONDS = 6, 600
TTL_HOURS, AHEAD_SECONDS = 8, 60


def rate_limited(requests: DataFrame, client: str, ts: str, key: str, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """``(key, accepted)``: at most ``limit`` accepted requests of a client in any ``seconds``.

    Refused requests are not counted.  Each client's requests stream by in time
    order; the state is its last accepted ones, so no client is held whole.
    """
    span = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, log = None, deque()
        for batch in batches:
            out = []
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c != who:
                    who, log = c, deque()
                while log and t - log[0] >= span:
                    log.popleft()
                out.append(len(log) < limit)
                if out[-1]:
                    log.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.bool_())], ["key", "accepted"])

    rows = requests.where(F.col(client).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(client).cast("long").alias("c"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(key).cast("long").alias("k")
    )
    return rows.repartition("c").sortWithinPartitions("c", "t", "k").mapInArrow(run, "key long, accepted boolean")


def latest_unexpired(snapshots: DataFrame, owner: str, ts: str, key: str, now=None, hours: int = TTL_HOURS) -> DataFrame:
    """Each owner's last snapshot, if it is no older than ``hours`` and not over a minute ahead of ``now``.

    Without ``now`` the newest snapshot's time counts.
    """
    last = snapshots.groupBy(F.col(owner).alias("owner")).agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(key).alias("key"))).alias("s"))
    if now is None:
        last = last.crossJoin(F.broadcast(snapshots.agg(F.max(ts).alias("now"))))  # one row
    else:
        last = last.withColumn("now", F.lit(now))
    age = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("s.ts").cast("timestamp"))
    return last.where((age <= hours * 3_600_000_000) & (age >= -AHEAD_SECONDS * 1_000_000)).select("owner", F.col("s.key").alias("key"))
