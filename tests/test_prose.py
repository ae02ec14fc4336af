import pytest
from pyspark.sql import functions as F

from prosegrid.functions import constants as C
from prosegrid.functions import tokens as T
from prosegrid.operators import calibration, comparison, coverage, features
from prosegrid.operators import segments as S
from prosegrid.sources import pages
from prosegrid.streaming import limits

FORMULAIC = (
    "In conclusion, it is important to note that the implementation of innovative methodology plays a crucial role in "
    "the development of organizational effectiveness. Furthermore, the integration of comprehensive frameworks underscores "
    "the importance of continuous improvement. Moreover, the transformation of institutional processes demonstrates the "
    "significance of strategic adaptation. Additionally, the optimization of educational outcomes represents an essential "
    "consideration for sustainable advancement."
)
CONCRETE = (
    "At 7:40 Maya unlocked the shed and found two wet boxes. I counted 14 jars, and she wrote the number on the lid. "
    'Rain had come in under the door, "again," said Tom. We moved the shelf 30 cm and left at noon.'
)


def spans(text):
    return [(text[a:b], a, b) for a, b in S.split_sentences(text, S.assess_lines(text))]


def test_splitter_offsets_and_abbreviations():
    text = "  First sentence.\n\nSecond sentence includes an abbreviation, e.g. a short example!  Last line has no punctuation  "
    got = spans(text)
    assert len(got) == 3 and got[0][1] == 2 and got[-1][2] == len(text) - 2
    text = 'We kept tape, labels, etc. "The backup list also ended with etc." Next, Maya paid 3.5 euros to Dr. Ito of the U.S. office.'
    assert [s for s, _, _ in spans(text)] == ["We kept tape, labels, etc.", '"The backup list also ended with etc."', "Next, Maya paid 3.5 euros to Dr. Ito of the U.S. office."]


@pytest.mark.parametrize(
    "line, reason",
    [
        ("CHAPTER I", "non-prose"), ("12", "non-prose"), ("page 3 of 9", "non-prose"), ("civil", "non-prose"), ("Background ..... 4", "non-prose"),
        ("- an item of some list that goes on", "non-prose"), ("A. Smith wrote the first of these reports last year.", "non-prose"),
        ("Keywords: rain, wind", "non-prose"), ("https://example.org is where it stands now.", "non-prose"),
        ("one | two | three and more words follow here.", "non-prose"), ("const x = 4", "non-prose"),
        ("El informe de la comisión describe los resultados del estudio.", "unsupported-language"), ("雨が降る", "unsupported-language"),
        ("The rain fell on the town for most of the day.", None), ("Two were wet.", None),
        ("Results of Second Field Trial Spring Season", "non-prose"), ("Results of the Second Field Trial in Spring", None),
    ],
)
def test_lines(line, reason):
    assert S.assess_lines(line)[0][2] == reason


def test_state_of_lines():
    text = "The study began in May and ended late.\n```\nThe code is here, see it run.\n```\nAfter it prose goes on as before now.\nReferences\nAny line is one now.\n"
    assert [r for _, _, r in S.assess_lines(text)] == [None, "non-prose", "non-prose", "non-prose", None, "bibliography", "bibliography"]
    assert S.assess_lines("") == [] and len(S.assess_lines("a\r\n\rb\n")) == 3


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in coverage.coverage(df).collect()}


def test_coverage(spark):
    word = lambda n: "word " * (n - 1) + "word."
    texts = [" ".join([FORMULAIC] * 9), " ".join([CONCRETE] * 10), word(299), word(300), word(30001), "", None, "Brief note."]
    got = run(spark, texts)
    assert [got[i]["status"] for i in (2, 3, 4, 5, 6, 7)] == ["insufficient-prose", "exact", "out-of-range", *["insufficient-prose"] * 3]
    assert got[0]["qualifying_words"] >= 300 and got[0]["classification"] == "high" and got[1]["classification"] == "low"
    assert got[5]["domain"] == "not-assessed" and got[7]["qualifying_words"] == 2 and got[7]["confidence"] == "low"
    for r in got.values():
        assert (r["displayed_percent"] is None) == (r["status"] != "exact")


def test_bibliography_leaves_the_score_alone(spark):
    body = " ".join([FORMULAIC] * 9)
    refs = "\nReferences\n" + "\n".join(f"Author, A. ({1990 + i}). A title of a work that was written then." for i in range(30))
    got = run(spark, [body, body + refs])
    assert got[0]["qualifying_words"] == got[1]["qualifying_words"] and got[0]["label"] == got[1]["label"]
    assert got[1]["excluded_words"] > got[0]["excluded_words"]


def test_windows(spark):
    df = spark.range(16).select("id", T.window_ranges(F.col("id").cast("int")).alias("r"))
    got = {r["id"]: [(x["start"], x["end"]) for x in r["r"]] for r in df.collect()}
    assert got[0] == [] and got[1] == [(0, 1)] and got[7] == [(0, 7)] and got[8] == [(0, 7), (1, 8)]
    assert got[12] == [(0, 7), (3, 10), (5, 12)] and got[13] == [(0, 7), (3, 10), (6, 13)]


def test_features(spark):
    df = spark.createDataFrame([("",), (FORMULAIC,), (CONCRETE,)], "window_text string")
    rows = [r.asDict() for r in features.with_likelihood(features.with_features(df)).collect()]
    assert all(rows[0][n] == 0 for n in features.NAMES)
    assert rows[1]["probability"] > C.THRESHOLD > rows[2]["probability"]
    assert abs(rows[1]["logit"] - C.INTERCEPT - sum(rows[1][f"c_{n}"] for n in features.NAMES)) < 1e-12


def test_small_operators(spark):
    df = spark.createDataFrame([(42,)], "i long").select(calibration.fnv_bucket(F.concat(F.lit("essay:"), "i")).alias("b"))
    assert df.first()["b"] == 1121636080 % 20
    q = spark.createDataFrame([("a", i) for i in range(1, 1001)], "g string, v long")
    assert [r["v"] for r in calibration.floor_quantiles(q, "g", "v", (0.995,)).collect()] == [995]
    auc = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert calibration.roc_auc(auc, "y", "s").first()["auc"] == 0.875
    pairs = spark.createDataFrame([(1, "a b b", "B c"), (2, "same", "same"), (3, None, None)], "k long, before string, after string")
    assert {r["k"]: r["changed"] for r in comparison.changed_tokens(pairs, ["k"]).collect()} == {1: 3, 2: 0, 3: 0}


def test_limits(spark):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", m) for m in range(20)] + [(2, "2024-01-01 00:00:00", 100)]
    df = spark.createDataFrame(rows, "u long, t string, k long").withColumn("t", F.to_timestamp("t"))
    got = {r["key"]: r["accepted"] for r in limits.rate_limited(df, "u", "t", "k").collect()}
    assert [k for k in range(20) if got[k]] == [*range(6), *range(10, 16)] and got[100]
    import datetime

    last = limits.latest_unexpired(df, "u", "t", "k", datetime.datetime(2024, 1, 1, 8, 10))
    assert {r["owner"]: r["key"] for r in last.collect()} == {1: 19}


def test_pages(spark):
    rows = [(1, p, "University of Example\n" + "\n".join(f"Body line {p} {i} goes on." for i in range(20)) + f"\n{p}") for p in (1, 2)]
    df = spark.createDataFrame(rows, "b long, p long, t string")
    lines = pages.lines_of_pages(df, "b", "p", "t")
    assert [r["key"] for r in pages.repeated_artifacts(lines).collect()] == ["top:university of example"]
    assert pages.without_artifacts(lines).count() == 40  # neither the repeated header nor the page numbers
