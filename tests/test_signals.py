from pyspark.sql import functions as F

from prosegrid.operators import revision, signals


def frame(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, i int, text string")


def test_signals(spark):
    texts = [
        "Moreover, it is important to note that the team was late.",
        "Moreover, the team ate at seven with Maya.",
        "The framework approach shows the importance of integration for development and optimization everywhere.",
        "",
    ]
    got = {r["i"]: r for r in signals.with_signals(frame(spark, texts)).collect()}
    ids = {i: {s["id"]: s["impact"] for s in r["signals"]} for i, r in got.items()}
    assert ids[0] == {"stock-phrases": 32, "repeated-transitions": 16} and ids[1] == {"repeated-transitions": 16}
    assert ids[2]["abstract-language"] == 22 and "low-specificity" in ids[2] and ids[3] == {}
    assert got[0]["pattern_score"] == 56 and got[3]["pattern_score"] == 4
    top = signals.top_signals(signals.with_signals(frame(spark, texts)))
    assert [r["id"] for r in top.orderBy("rank").limit(2).collect()] == ["repeated-transitions", "stock-phrases"]
    assert signals.coaching(top).where("priority = 'high'").count() == 1


def test_passages(spark):
    rows = [(1, i, i * 100, i * 100 + 90, 60, i not in (5,), 96, i == 3) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, i int, start int, end int, words int, detected boolean, score int, blank_before boolean")
    got = signals.passages(df).orderBy("passage").collect()
    assert [r["sentences"] for r in got] == [3, 2, 4, 2] and {r["band"] for r in got} == {"high"}
    short = df.withColumn("words", F.lit(1)).withColumn("detected", F.lit(True)).withColumn("blank_before", F.lit(False))
    assert [r["sentences"] for r in signals.passages(short).orderBy("passage").collect()] == [8, 4]


def test_revision(spark):
    texts = [
        ("It is important to note that we act in order to help.", True),
        ("We made use of a total of 40 jars.", False),
        ('He said "in order to".', True),
        ("In conclusion, all is well.", True),
    ]
    df = spark.createDataFrame(texts, "text string, stock boolean")
    got = {r["text"]: (r["revised"], r["rules"]) for r in revision.revise(df, "comprehensive").collect()}
    assert got[texts[0][0]] == ("Importantly, we act to help.", ["compress-important-note", "shorten-in-order-to"])
    assert got[texts[1][0]] == ("We used 40 jars.", ["remove-total-before-number", "simplify-use"])
    assert got[texts[2][0]] == (texts[2][0], []) and got[texts[3][0]][0] == "All is well."
    calm = {r["text"]: r["revised"] for r in revision.revise(df, "conservative").collect()}
    assert calm[texts[1][0]] == texts[1][0] and calm[texts[0][0]] == "Importantly, we act in order to help."


def test_protected_and_compose(spark):
    pairs = spark.createDataFrame([(1, "It may cost 40% or 40%, says Ann Lee.", "It costs 40%, says Ann Lee (2020).")], "k long, before string, after string")
    got = {(r["kind"], r["value"], r["change"], r["n"]) for r in revision.protected_diff(pairs, ["k"]).collect()}
    assert ("qualifier", "may", "removed", 1) in got and ("citation-or-number", "40", "removed", 1) in got and not any(k == "name" for k, *_ in got)
    texts = spark.createDataFrame([(1, "one two three"), (2, "left alone")], "doc_id long, text string")
    edits = [(1, 0, 3, "one", "1"), (1, 8, 13, "three", "3"), (1, 4, 7, "old", "2")]
    edits = spark.createDataFrame(edits, "doc_id long, start int, end int, before string, after string")
    assert {r["doc_id"]: r["text"] for r in revision.compose(texts, edits).collect()} == {1: "1 two 3", 2: "left alone"}
    states = [("exact", 40, "exact", 30), ("exact", 40, "below-reporting-threshold", 5), ("out-of-range", 1, "exact", 30)]
    both = [spark.createDataFrame([(i, *s[k : k + 2]) for i, s in enumerate(states)], "doc_id long, status string, raw_percent int") for k in (0, 2)]
    got = {r["doc_id"]: (r["direction"], r["delta"]) for r in revision.compare_audits(*both).collect()}
    assert got == {0: ("decreased", -10), 1: ("decreased", None), 2: ("unavailable", None)}
