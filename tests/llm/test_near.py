import numpy as np

from prosegrid.llm import near as N


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    rows, want, far = [], set(), []
    for d in range(0, 1200, 10):
        base = list(rng.choice(words, rng.integers(60, 400)))
        rows.append((d, " ".join(base)))
        for j in range(1, 4):
            other = list(base)
            for _ in range(max(1, len(base) // 150)):
                other[rng.integers(len(other))] = f"new{d}{j}"
            rows.append((d + j, ("\n" if j == 2 else " ").join(other)))
            if len(shingles(" ".join(base)) & shingles(" ".join(other))) / len(shingles(" ".join(base)) | shingles(" ".join(other))) >= 0.8:
                want.add(d + j)
        rows.append((d + 5, " ".join(base)))
        want.add(d + 5)
        cut = base[: len(base) // 2] + list(rng.choice(words, len(base) // 2))
        rows.append((d + 6, " ".join(cut)))
        far.append(d + 6)
    rows += [(5000, None), (5001, ""), (5002, " "), (5003, "one"), (5004, "one"), (None, rows[0][1]), (5005, "a b"), (5006, "A B")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, keeper int")
    copies = N.near_copies(df)
    got = {r["id"]: r["keeper"] for r in copies.collect()}
    assert not want - got.keys() and not got.keys() & set(far) and not {d for d in got if d is not None and d % 10 == 0 and d < 1200}
    assert got[5004] == 5003 and got[5006] == 5005 and got[None] == 0 and not got.keys() & {5000, 5001, 5002}
    exact = {d: shingles(t) for d, t in rows}
    for d, k in got.items():
        assert any(len(exact[d] & exact[o]) >= 0.8 * len(exact[d] | exact[o]) for o in got.keys() | {k} if o is not d)
    kept = N.without_near_copies(df, copies)
    assert kept.columns == df.columns and kept.count() == len(rows) - len(got)
    assert N.near_copies(df.limit(0)).count() == 0


def found(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["id"]: r["keeper"] for r in N.near_copies(df, **how).collect()}


def test_every_appended_or_inserted_block_is_found(spark):
    rng = np.random.default_rng(5)
    texts, want = [], {}
    for d in range(150):
        base = [f"b{d}x{i}" for i in rng.permutation(int(rng.integers(60, 500)))]
        new = [f"n{d}x{i}" for i in range((len(base) - 4) // 4)]  # similarity 0.8 or a little more
        at = len(base) if d % 2 else 0
        other = base[:at] + new + base[at:]
        one, two = shingles(" ".join(base)), shingles(" ".join(other))
        assert len(one & two) >= 0.8 * len(one | two)
        want[len(texts) + 1] = len(texts)
        over = base[:at] + new + [f"m{d}x{i}" for i in range(8)] + base[at:]
        texts += [" ".join(base), " ".join(other)] + ([" ".join(over[::-1])] if d % 3 == 0 else [])
    assert found(spark, texts) == want


def test_near_copies_among_texts_of_one_vocabulary(spark):
    rng = np.random.default_rng(6)
    words, texts, want = np.array([f"w{i}" for i in range(120)]), [], {}
    for d in range(60):
        base = words[rng.permutation(120)]
        texts.append(" ".join(base))
        if d % 2:
            want[len(texts)] = len(texts) - 1
            texts.append(" ".join(np.concatenate((base[60:], base[:60]))))  # the same set of words, so the same fingerprint
    assert found(spark, texts) == want


def test_common_shingles_and_pairs_in_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "SAMPLE", 1)
    monkeypatch.setattr(N, "PAIRS", 7)
    rng = np.random.default_rng(7)
    line = [f"c{i}" for i in range(12)]
    texts = [" ".join([*line, *(f"t{d}x{i}" for i in rng.permutation(int(rng.integers(3, 30))))]) for d in range(60)]
    texts += [" ".join([*t.split(), "z"]) for t in texts[::5]] + ["c0 C1 c2", "C0 c1 c2"]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert found(spark, texts) == {i: r for i, r in enumerate(root) if i != r}


def test_bitmaps_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(2)
    h = rng.permutation(np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2)))
    for both in (500, 800, 950):
        a, b = h[:both], np.concatenate((h[:both], h[both:] + np.uint64(1)))
        far = int(np.bitwise_count(N.bitmap(a) ^ N.bitmap(b)).sum())
        assert 0 < far <= len(np.setxor1d(a, b))
        assert far <= N.differing(N.wide_bitmap(a), N.wide_bitmap(b)) <= len(np.setxor1d(a, b))
    assert not N.bitmap(np.empty(0, np.uint64)).any()
    for n in (1, 2, 31, 32, 33, 700):  # widths that are not the same
        a, b = h[:n], h[: n + n // 4]
        assert n // 8 <= N.differing(N.wide_bitmap(a), N.wide_bitmap(b)) <= n // 4


def linked(texts, least=0.8):
    """Brute force: the smallest index that chains of similar texts reach."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for b in range(len(texts)):
        for a in range(b):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.7 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if both >= least * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in range(len(texts)) if find(i) != i}


def test_large_families_lose_no_link(spark):
    texts = []
    for family, (size, changed) in enumerate([(10, 6), (100, 6), (300, 6), (300, 5), (300, 2), (400, 6)]):
        rng = np.random.default_rng(family)
        words = np.array([f"v{family}x{i}" for i in range(5000)])
        base = rng.choice(words, 300)
        texts.append(" ".join(base))
        for _ in range(size):
            other = base.copy()
            other[rng.choice(300, changed, replace=False)] = rng.choice(words, changed)
            texts.append(" ".join(other))
    order = np.random.default_rng(9).permutation(len(texts))
    texts = [texts[i] for i in order]
    want = linked(texts)
    assert len(want) >= 0.9 * len(texts)
    assert found(spark, texts) == want
    assert found(spark, texts, small_size=2) == want


def test_parts_of_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(N, "SAMPLE", 1)
    rng = np.random.default_rng(9)
    line = [f"c{i}" for i in range(40)]
    texts = [" ".join([*line[: int(rng.integers(30, 40))], *(f"t{d}x{i}" for i in range(int(rng.integers(0, 12))))]) for d in range(150)]
    want = linked(texts)
    assert len(want) > 50
    for part in (1 << 14, 3):
        assert found(spark, texts, part=part) == want
    monkeypatch.setattr(N, "PART", 2)
    assert found(spark, texts) == want


def test_rows_that_cannot_be_told_apart_and_long_texts(spark):
    long = " ".join(f"l{i % 7919}y{i}" for i in range(60000))
    rows = [(3, "same text here"), (3, "same text here"), (3, "another one of id three"), (None, "x y z"), (None, "x y z"), (None, "p q r")]
    rows += [(7, long), (8, long + " more words at its end"), (9, None), (9, None), (10, "  "), (10, "  ")]
    df = spark.createDataFrame([(d, t, i, None) for i, (d, t) in enumerate(rows)], "doc_id long, text string, t1 int, again string")
    kept = N.without_near_copies(df, N.near_copies(df))
    assert kept.columns == df.columns
    left = sorted((r["doc_id"] or -1, (r["text"] or "")[:20]) for r in kept.collect())
    assert left == [(-1, "p q r"), (-1, "x y z"), (3, "another one of id th"), (3, "same text here"), (7, long[:20]), (9, ""), (9, ""), (10, "  "), (10, "  ")]
