from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegrid.llm import mixing as M


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, left, free = {}, float(sum(sizes.values())), set(names)
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**goal, **share}
        for s in over:
            goal[s] = float(most * sizes[s])
            left -= goal[s]
            free.remove(s)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70, "é": 0, "Z": 33}, {"x": 7}, {"a": 1, "b": 1}, {"a": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in M.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    sizes, p = rng.integers(0, 500, 3000).tolist(), 0.37
    fly, decided = M.Flight(), []
    for i, s in enumerate(sizes):
        decided += fly.push(i, s, p, int(rng.integers(1 << 40)))
    done, left = fly.close()
    decided += done
    assert len(left) <= 2 and len(decided) + len(left) == 3000 and {x[2] for x in decided} == {0.0, 1.0}
    now = decided + left
    assert abs(sum(x[2] for x in now) - 3000 * p) < 1e-5
    assert abs(sum(x[1] * x[2] for x in now) - sum(sizes) * p) < 1e-2
    assert {x[0] for x in M.land([(5, 10, 0.2), (6, 3, 0.9)])} == {5, 6}


def test_probabilities_are_kept():
    hits = np.zeros(40)
    for seed in range(400):
        rng = np.random.default_rng(seed)
        fly, got = M.Flight(), []
        for i in range(40):
            got += fly.push(i, 1 + i % 7, 0.3, int(rng.integers(1 << 50)))
        done, left = fly.close()
        for i, _, p in got + done + left:
            hits[i] += p
    assert abs(hits.mean() / 400 - 0.3) < 0.01 and np.abs(hits / 400 - 0.3).max() < 0.12


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        source = "hot" if i % 3 else [None, "a", "b", "é"][i % 4]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))), source, 1))
    rows += [(5000, None, "a", 1), (5001, "", None, 1), (None, "x y", "a", 1), (7, "x y", "b", 1), (7, "x y", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = M.mix(df, block=64).collect()
    assert len(out) == len(rows)
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        goal[r["source"]] = r["target"]
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert abs(goal[s] - want[s]) < 1e-6 and abs(taken[s] - goal[s]) <= 3
    again = M.mix(df.repartition(7), block=64).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    mixed = M.mix(df)
    kept = M.take(df, mixed)
    assert kept.columns == df.columns
    assert kept.count() == sum(r["copies"] for r in mixed.collect())
    assert M.mix(df.limit(0)).count() == 0 and M.take(df.limit(0), M.mix(df.limit(0))).count() == 0


def test_rows_that_share_an_id_are_taken_one_by_one(spark):
    rows = [(None, f"{'w ' * (i % 40)}t{i}", "hot" if i % 3 else "b", i) for i in range(900)]
    rows += [(5, "one of many", "a", 1)] * 60 + [(5, "another text", "a", 2)] * 30 + [(6, None, None, 3)] * 20 + [(6, "x" * 400000 + " y", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = M.mix(df, block=32).collect()
    taken, goal = defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["copies"] * r["size"]
        goal[r["source"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= 3 for s in goal)
    mixed = M.mix(df, block=32)
    number = Counter((r["id"], r["source"], r["digest"]) for r in mixed.collect() for _ in range(r["copies"]))
    kept = M.take(df, mixed).withColumn("digest", M.digest_of(F.col("text"))).collect()
    assert Counter((r["doc_id"], r["source"], r["digest"]) for r in kept) == number
    assert max(Counter((r["doc_id"], r["text"], r["copies"]) for r in kept if r["doc_id"] is None).values(), default=0) <= 3


def test_sizes_and_targets_as_sql_says(spark):
    sql = """
      WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        w AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s GROUP BY source)
      SELECT s.doc_id, s.source, size, CAST(source_size AS BIGINT) AS source_size, weight FROM s JOIN w ON s.source IS NOT DISTINCT FROM w.source"""
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(sql).fetchall()
    out = M.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert sorted((r["id"], r["size"], r["source_size"]) for r in out) == sorted((d, n, whole) for d, _, n, whole, _ in want)
    sizes = {s: whole for _, s, _, whole, _ in want}
    goal = brute_targets(sizes)
    taken = defaultdict(int)
    for r in out:
        taken[r["source"]] += r["copies"] * r["size"]
        assert abs(r["target"] - goal[r["source"]]) < 1e-6
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] for s in goal)
