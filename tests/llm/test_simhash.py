from itertools import combinations

import numpy as np
import xxhash

from prosegrid.llm import simhash as S


def brute_fp(text, width=4):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    sh = [words] if len(words) < width else [words[i : i + width] for i in range(len(words) - width + 1)]
    hs = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(ids, fps, bits=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(ids))]


def test_fingerprint_matches_definition():
    for text in ("", "  \t\n", "One", "one two three", "A b C d", "x y z w v " * 40, "é Ü ß " * 9, "ÀB cd\x0bef\x1fgh i"):
        assert S.fold(S.shingle_hashes(text.encode(), 4)) == brute_fp(text)


def test_classes_match_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "one", "one", "One"]
    for _ in range(60):
        base = list(rng.choice(words, rng.integers(20, 300)))
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 4)):
            other = list(base)
            other[rng.integers(len(other))] = "changed"
            texts.append(" ".join(other))
    ids = [*range(len(texts) - 1), None]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, fp int, c int")
    got = {(r["id"], r["fp"] & (2**64 - 1), r["component"]) for r in S.near_duplicate_classes(df).collect()}
    fps = [brute_fp(t) for t in texts]
    assert got == set(zip(ids, fps, brute_classes(ids, fps)))


def test_huge_keys_are_cut_and_stay_exact(spark):
    rng = np.random.default_rng(7)
    fps = []
    for _ in range(6):
        base = int(rng.integers(0, 2**63))
        for _ in range(60):
            x = base
            for b in rng.integers(0, 32, rng.integers(0, 7)):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps))
    scratch = S.Scratch(spark, "t")
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = [(r.a, r.b) for r in S.links(df, scratch, block_size=7, small_size=3).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in edges)
    index = {x: i for i, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(index[a])] = find(index[b])
    want = brute_classes(list(range(len(fps))), fps)
    got = [find(i) for i in range(len(fps))]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicate_classes(df).count() == 0


def test_long_texts_and_clashing_columns(spark):
    words = [f"v{i * 31 % 9973}" for i in range(120_000)]
    texts = [" ".join(words), "\n".join(words), " ".join(words[:60_000]), "x" * 2_000_000, " " * 500_000, None, ""]
    df = spark.createDataFrame([(i, t, i, "fp") for i, t in enumerate(texts)], "doc_id long, text string, fp int, component string")
    got = {r["id"]: (r["fp"], r["component"]) for r in S.near_duplicate_classes(df).collect()}
    for i in (0, 2, 3):
        want = S.fold(S.shingle_hashes(texts[i].encode(), 4))
        assert got[i][0] & (1 << 64) - 1 == want
    assert got[1] == got[0] and {got[i] for i in (4, 5, 6)} == {(0, 4)}
    hashes = S.shingle_hashes(" ".join(words[:3000]).encode(), 4)
    assert hashes.tolist() == [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(2997)]


def test_no_result_depends_on_how_work_is_dealt(spark):
    from prosegrid.llm.components import connected_components
    from prosegrid.llm.scratch import Scratch

    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 12, dtype=np.int64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.int64(1) << rng.integers(0, 60, 12)) ^ (np.int64(1) << rng.integers(0, 60, 12)) for _ in range(60))]))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    scratch, found = Scratch(spark, "test"), []
    for how in ({}, {"small_size": 2}, {"small_size": 500}, {"block_size": 40}, {"block_size": 7, "small_size": 3}):
        joined = connected_components(S.links(df, scratch, **how), scratch)
        found.append(sorted((r["node"], r["root"]) for r in joined.collect()))
    assert all(f == found[0] for f in found) and len(found[0]) > 600
