import numpy as np
from pyspark.sql import functions as F

from prosegrid.operators import calibration, documents
from prosegrid.sources import pages


def test_reading_lines(spark):
    rows = [
        ("a", 1, 0, 50.0, 700.0, 10.0, "world", False), ("a", 1, 1, 10.0, 703.0, 10.0, "Hello", False), ("a", 1, 2, 90.0, 701.0, 10.0, ", all", False),
        ("a", 1, 3, 10.0, 600.0, 10.0, "Next", False), ("a", 1, 4, 1.0, 1.0, 1.0, "  ", True),
        ("a", 2, 0, None, 1.0, 1.0, "One", False), ("a", 2, 1, 1.0, 1.0, 1.0, "two", True), ("a", 2, 2, 1.0, 9.0, 1.0, "three", False),
    ]
    df = spark.createDataFrame(rows, "book string, page int, seq long, x double, y double, height double, text string, has_eol boolean")
    got = [(r["page"], r["line"], r["y"]) for r in pages.reading_lines(df).orderBy("page", "line_no").collect()]
    assert got == [(1, "Hello world, all", 703.0), (1, "Next", 600.0), (2, "One two", None), (2, "three", None)]


def test_spans(spark):
    texts = [" ", "first page with some words of text", None, "b ", "c"]
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "book string, page int, text string")
    whole = pages.joined(df).first()["text"]
    got = pages.spans(df).orderBy("page").collect()
    assert [whole[r["start"] : r["end"]] for r in got] == ["", texts[1], "", "b", "c"]
    assert [r["quality"] for r in got] == ["image-only", "readable-text", "image-only", "sparse-text", "sparse-text"]


def test_report_text(spark):
    rows = [("a b\x01\n c",), ("word " * 200,), ("x" * 600,), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(documents.excerpt(F.col("t"))).collect()]
    assert got[0] == "a b c" and got[1] == " ".join(["word"] * 104) + "..." and got[2] == "x" * 520 + "..." and got[3:] == ["", None]
    names = spark.createDataFrame([("My: draft .PDF",), (" .docx",), ("a/b. .txt",)], "t string")
    assert [r[0] for r in names.select(documents.file_stem(F.col("t"))).collect()] == ["My- draft", "Untitled-draft", "a-b"]
    docs = spark.createDataFrame([(1, "abc\ndefgh"), (2, None), (3, "plain")], "doc_id int, text string")
    marks = spark.createDataFrame([(1, 2, 5, "high")], "doc_id int, start long, end long, band string")
    got = documents.highlighted_runs(docs, marks).orderBy("doc_id", "run").collect()
    assert [(r["doc_id"], r["text"], r["band"]) for r in got] == [(1, "ab", None), (1, "c d", "high"), (1, "efgh", None), (3, "plain", None)]


def test_threshold(spark):
    rng = np.random.default_rng(1)
    rows = [(int(d), round(float(rng.random()), 3), int(rng.integers(1, 9)), bool(d % 3)) for d in rng.integers(0, 60, 400)]
    df = spark.createDataFrame(rows, "doc_id int, p double, w int, human boolean")
    people = {d for d, _, _, h in rows if h}

    def reported(t):
        part = lambda d, low: sum(w for e, p, w, _ in rows if e == d and p >= low)
        return sum(part(d, t) >= 0.2 * part(d, 0) for d in people)

    options = sorted({0.5, 1.0, *(p for _, p, _, _ in rows if p >= 0.5)})
    want = next(t for t in options if reported(t) <= 0.1 * len(people))
    got = calibration.choose_threshold(df, "p", "w", "human", target=0.1).first()
    assert (got["threshold"], got["humans"], got["reported"]) == (want, len(people), reported(want))


def test_train(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=40) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c), 1 / 40) for (a, b), c in zip(x, y)], "a double, b double, l int, w double")
    got = calibration.train(df, ["a", "b"], "l", "w", epochs=12)
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(40)])
    theta, m, v = np.zeros(3), np.zeros(3), np.zeros(3)
    for k in range(1, 13):
        g = z.T @ ((1 / (1 + np.exp(-z @ theta)) - y) / 40) + 0.02 * np.append(theta[:2], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.035 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    assert np.allclose([*got["coefficients"], got["intercept"]], theta)


def test_prose_statistics(spark):
    sentences = [("One two two.", 3, 0, True), ("HEAD.", 1, None, False), ("Four five six Two seven.", 5, 1, False)]
    rows = [(1, sentences, 1, 3), (2, [], 0, 0)]
    kind = "doc_id int, sentences array<struct<text:string,words:int,q:int,detected:boolean>>, detected_sentences long, detected_words long"
    audited = spark.createDataFrame(rows, kind)
    got = [tuple(r) for r in documents.prose_statistics(audited).orderBy("doc_id").collect()]
    assert got == [(1, 3, 2, 8, 4.0, 25, 75, 1, 3), (2, 0, 0, 0, 0.0, 0, 0, 0, 0)]
