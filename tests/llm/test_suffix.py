from collections import defaultdict

import numpy as np

from prosegrid.llm import suffix as X


def brute(rows, size):
    where = defaultdict(set)
    for d, t in rows:
        w = t.encode().split()
        for i in range(len(w) - size + 1):
            where[tuple(w[i : i + size])].add(d)
    cover, dup = defaultdict(set), defaultdict(set)
    for d, t in rows:
        w = t.encode().split()
        for i in range(len(w) - size + 1):
            docs = where[tuple(w[i : i + size])]
            if len(docs) > 1:
                cover[d].update(range(i, i + size))
                if min(docs) < d:
                    dup[d].update(range(i, i + size))
    return cover, dup


def firsts(rows, spans, size):
    """For each span, the smallest document with one of its passages."""
    where, words = defaultdict(set), defaultdict(list)
    for d, t in rows:
        w = t.encode().split()
        if w not in words[d]:
            words[d].append(w)
        for i in range(len(w) - size + 1):
            where[tuple(w[i : i + size])].add(d)
    return {
        (r["doc"], r["start"]): min(min(where[tuple(w[i : i + size])]) for w in words[r["doc"]] for i in range(r["start"], r["start"] + r["words"] - size + 1) if len(where[tuple(w[i : i + size])]) > 1)
        for r in spans
    }


def got(spans):
    cover, dup = defaultdict(set), defaultdict(set)
    for r in spans.collect():
        new = set(range(r["start"], r["start"] + r["words"]))
        assert not new & cover[r["doc"]] and r["start"] + r["words"] not in cover[r["doc"]]
        cover[r["doc"]] |= new
        for a, b in zip(r["cuts"][::2], r["cuts"][1::2]):
            dup[r["doc"]].update(range(a, b))
        assert r["duplicate_words"] == sum(r["cuts"][1::2]) - sum(r["cuts"][::2])
    return cover, dup


def corpus(rng, n):
    words = [f"w{i}" for i in range(30)] + ["é", "ß"]
    shared = [list(rng.choice(words, rng.integers(8, 60))) for _ in range(8)]
    rows = []
    for d in range(n):
        w = list(rng.choice(words, rng.integers(0, 40)))
        for _ in range(rng.integers(0, 4)):
            s = shared[rng.integers(len(shared))]
            a = rng.integers(0, len(s))
            w += s[a : a + rng.integers(5, 40)] + list(rng.choice(words, rng.integers(0, 9)))
        if d % 9 == 0:
            w = ["same"] * 25 + w
        rows.append((d, "  ".join(w) if d % 2 else "\n".join(w)))
    return rows


def test_spans_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = corpus(rng, 120)
    rows += [(200 + i, rows[5][1]) for i in range(30)] + [(300, rows[7][1]), (300, rows[7][1])]
    extra = [(d, t, 1, "x") for d, t in rows] + [(None, rows[5][1], 1, "x"), (999, None, 1, "x"), (998, "", 1, None)]
    df = spark.createDataFrame(extra, "doc_id long, text string, h int, cuts string")
    want = brute([(d, t) for d, t in rows], 10)
    for held in (X.HELD, 5):
        spans = X.repeated_spans(df, run=5, window=6, held=held)
        whole = [r for r in spans.collect() if r["doc"] != 300]
        assert {(r["doc"], r["start"]): r["first_doc"] for r in whole} == firsts(rows, whole, 10)
        have = got(spans)
        assert {k: v for k, v in have[0].items() if v} == {k: v for k, v in want[0].items() if v}
        assert {k: v for k, v in have[1].items() if v} == {k: v for k, v in want[1].items() if v}


def test_the_first_document_has_another_context(spark):
    p = " ".join(f"p{i}" for i in range(50))
    a, b, x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "abxy")
    rows = [(1, f"{a} {p} {b}"), (2, f"{x} {p} {y}"), (3, f"{x} {p} {y}"), (4, f"{x} {p} {y}"), (5, f"{y} {p} {a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for held in (X.HELD, 1):
        spans = X.repeated_spans(df, held=held).collect()
        assert {(r["doc"], r["start"]): r["first_doc"] for r in spans} == firsts(rows, spans, 50)
        assert {r["first_doc"] for r in spans if r["doc"] == 3} == {1}


def test_long_texts(spark):
    words = [f"v{i * i % 7919}w{i}" for i in range(60000)]
    rows = [(1, " ".join(words)), (2, "head " + " ".join(words[100:59000])), (3, "x" * 3_000_000), (4, "x" * 3_000_000), (5, " " * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = sorted((r["doc"], r["start"], r["words"], r["duplicate_words"], r["first_doc"]) for r in X.repeated_spans(df).collect())
    assert spans == [(1, 100, 58900, 0, 1), (2, 1, 58900, 58900, 1)]


def test_cutting_keeps_every_passage_once(spark):
    rng = np.random.default_rng(4)
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"alpha {p} omega"), (2, p), (3, f"beta\n{p}\n gamma"), (4, "short one"), (5, None), (6, " ")]
    df = spark.createDataFrame([(d, t, len(t or ""), d) for d, t in rows], "doc_id long, text string, n_chars long, doc long")
    out = X.without_repeats(df, X.repeated_spans(df))
    assert out.columns == df.columns
    have = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert have == {
        1: (rows[0][1], len(rows[0][1])),
        3: ("beta\ngamma", 10),
        4: ("short one", 9),
        5: (None, 0),
        6: (" ", 1),
    }
    assert rng is not None


def test_empty_and_default_size(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert X.repeated_spans(df).count() == 0
    a = [f"a{i}" for i in range(49)]
    b = [f"b{i}" for i in range(50)]
    rows = [(1, " ".join(["x", *a, "y", *b])), (2, " ".join(["u", *a, "v", *b, "w"]))]
    got_ = X.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc"], r["start"], r["words"], r["duplicate_words"], r["first_doc"]) for r in got_) == [
        (1, 51, 50, 0, 1),
        (2, 51, 50, 50, 1),
    ]
