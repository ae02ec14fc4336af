import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from prosegrid.llm import topk as T


def brute(rows, k=5):
    good = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    good = [g for n, g in enumerate(good) if g not in good[:n]]
    out = []
    for q, a in good:
        if q % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(set(out))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, id string")
    v = T.quantised(df, "vec_id", "embedding")
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in T.top_k(v, v.where("id % 50 = 0"), **kw).collect())


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(400)]
    centres = rng.normal(0, 1, (6, 8))
    rows += [(400 + i, (centres[i % 6] + rng.normal(0, 0.01, 8)).tolist()) for i in range(400)]
    rows += [(900 + i, [0.5] * 8) for i in range(30)]
    rows += [(2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (None, [0.1] * 8)]
    rows += [(2200, [0.5, 0.5]), (2201, [0.25, -1.0]), (2250, []), (2251, []), (2300, [0.1] * 3), (900, [0.5] * 8)]
    assert run(spark, rows, data_block=128, query_block=8) == brute(rows)


def test_repeated_rows_take_one_place(spark):
    rows = [(i, [i / 64, 1.0]) for i in range(1, 41)]
    rows += [(40, [40 / 64, 1.0])] * 7 + [(39, [39 / 64, 1.0])] * 2 + [(50, [1.0, 0.5])] * 3
    assert run(spark, rows) == brute(rows) and len(brute(rows)) == 5
    wide = [(i, [i * 1e5, 1e5]) for i in range(1, 9)] + [(8, [8e5, 1e5])] * 6 + [(50, [1e6, 1e5])] * 2
    assert run(spark, wide) == brute(wide) and len(brute(wide)) == 5


def test_wide_values_and_empty(spark):
    rows = [(0, [1e5, -2e5]), (1, [3e5, 4.0]), (50, [1e4, 1e6]), (3, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, [0.1])]) == [] and run(spark, [(50, [0.1])]) == []
    with pytest.raises(Exception, match="does not fit 64 bits"):
        run(spark, [(0, [3e30]), (1, [2e30])])


def test_cells_parts_and_shares(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.05, 6)).tolist()) for i in range(1, 1300)]
    rows += [(1300 + i, centres[0].tolist()) for i in range(700)]  # a third of all rows are one vector
    want = brute(rows)
    for how in ({"data_block": 64}, {"data_block": 400, "query_share": 2}, {"data_block": 1 << 20}):
        assert run(spark, rows, **how) == want


def search(x, number, k=5, floor=None):
    best = T.dual_search(T.Tree(x[:number]), np.arange(number), T.Tree(x), np.arange(len(x)), k, floor)
    scores = x[:number] @ x.T
    for q in range(number):
        order = sorted((-s, i) for i, s in enumerate(scores[q].tolist()) if i != q)[:k]
        assert [(-s, i) for s, i in order] == list(zip(best.scores[q].tolist(), best.ids[q].tolist()))
    assert best.counts["scored"] + best.counts["pruned"] == number * len(x)
    return best.counts["pruned"] / (number * len(x))


def test_dual_search_prunes():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 300, (40, 16))
    x = np.rint(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 2, (4000, 16)))
    assert search(x, 50) > 0.7 and search(x, 1000) > 0.7
    low = np.rint(rng.normal(0, 100, (4000, 3)))
    assert search(low, 500) > 0.3
    assert search(np.rint(rng.normal(0, 100, (600, 64))), 100) >= 0  # no structure, nothing to prune
    assert search(np.tile(x[:3], (40, 1)), 60) >= 0 and search(x[:1], 1) == 0


def test_a_floor_keeps_what_reaches_it():
    rng = np.random.default_rng(3)
    x = np.rint(rng.normal(0, 100, (800, 4)))
    whole = T.dual_search(T.Tree(x[:90]), np.arange(90), T.Tree(x), np.arange(800), 5)
    floor = np.array([s[-1] for s in whole.scores])
    again = T.dual_search(T.Tree(x[:90]), np.arange(90), T.Tree(x), np.arange(800), 5, floor)
    assert all((a == b).all() for a, b in zip(whole.ids, again.ids)) and again.counts["scored"] <= whole.counts["scored"]


def test_tree_covers_and_separates():
    rng = np.random.default_rng(5)
    tree = T.Tree(np.rint(rng.normal(0, 50, (3000, 5))), leaf=8)
    depth = 0
    for node, points in enumerate(tree.points):
        c, kids = tree.x[tree.centre[node]], tree.kids[node]
        assert tree.centre[node] in points and np.sqrt(((tree.x[points] - c) ** 2).sum(1)).max() <= tree.radius[node]
        if kids is not None:
            depth += 1
            parts = [tree.single[node], *(tree.points[k] for k in kids)]
            assert np.array_equal(np.sort(np.concatenate(parts)), np.sort(points))
            centres = tree.x[np.concatenate((tree.single[node], [tree.centre[k] for k in kids])).astype(int)]
            far = np.sqrt(((centres[:, None] - centres) ** 2).sum(2))[~np.eye(len(centres), dtype=bool)]
            assert far.min() > tree.radius[node] / 2 * (1 - 1e-9)
            assert all(tree.radius[k] <= tree.radius[node] / 2 * (1 + 1e-9) for k in kids)
    assert depth > 20


def test_embeddings_go_through_the_trees():
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_pylist()
    x = np.floor(256 * np.array(rows, np.float64))
    tree = T.Tree(x)
    assert len(tree.points) > 0 and tree.kids[0] is not None
    share = search(x, 200)
    print(f"pruned share of embeddings: {share}")
