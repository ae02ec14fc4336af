import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosegrid.functions import texts as X
from prosegrid.operators import calibration, coverage, documents, features, report, revision, signals
from prosegrid.operators import window_features as W
from prosegrid.sources import files, pages
from prosegrid.streaming import requests
from tests.test_prose import CONCRETE, FORMULAIC

PIECES = [
    "The plan was, in 3.5 days, carried out (see p. 4).", "It is evident that we may; perhaps, go: on", "- a dash - here", "However, this was written by us!",
    '"Don\'t go," she said.', "...and so on?!", "12 items", "A wide range of nations", "delve into it. Then stop", "Été à Paris — vite…", "!", "The The the.",
]


def test_windows_and_expressions_agree(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(PIECES + [FORMULAIC, CONCRETE], k=rng.randint(1, 9))) for _ in range(300)] + ["", " ", "no end", ". . .", "a.b.c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, window_text string")
    for r in features.with_features(df).collect():
        for name, a in zip(features.NAMES, W.of_text(r["window_text"])):
            assert abs(r[name] - a) < 1e-12, (r["window_text"], name)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES + ["Plain sentence number one.", "Another plain one, here.", "And a third; last!"]), max_size=16))
def test_sums_over_sentences_are_those_of_the_text(texts):
    for a, b, x in W.of_sentences(texts):
        whole = W.of_text(" ".join(texts[a:b]))
        assert all(abs(p - q) < 1e-12 for p, q in zip(x, whole))


def test_repeated_ids_and_nulls_are_rows_of_their_own(spark):
    texts = [" ".join([FORMULAIC] * 9), " ".join([CONCRETE] * 10), None, ""]
    rows = [(i % 2, t, "clash", 1) for i, t in enumerate(texts)] * 2 + [(None, texts[0], "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, status string, row int")
    got = coverage.coverage(df)
    assert got.count() == len(rows) and got.where("status = 'exact'").count() == 5
    audited = coverage.stored(df)
    assert audited.select("row").distinct().count() == len(rows)
    assert report.passage_reviews(audited).select("row").distinct().count() == 3
    assert coverage.coverage(df.limit(0)).count() == 0 and report.passage_reviews(coverage.stored(df.limit(0))).count() == 0


@pytest.fixture(scope="module")
def audited(spark):
    body = " ".join([FORMULAIC] * 9)
    texts = [body + "\n\n" + body, " ".join([CONCRETE] * 12), "Short."]
    return coverage.stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), texts


def test_reviews(audited):
    table, texts = audited
    rows = report.passage_reviews(table).orderBy("passage").collect()
    assert {r["doc_id"] for r in rows} == {0}
    for r in rows:
        assert r["text"] == texts[0][r["start"] : r["end"]] and r["sentences"] <= 8 and r["words"] <= 240
        assert (r["band"], r["label"]) in (("high", "Elevated"), ("mixed", "Review"))
        assert len(r["signals"]) == 4 and [s["impact"] for s in r["signals"]] == sorted((s["impact"] for s in r["signals"]), reverse=True)
        ways = [f["direction"] for f in r["factors"]]
        assert ways == sorted(ways, reverse=True) and ways.count("raises") <= 3 and ways.count("lowers") <= 2
    blocks = report.review_blocks(report.passage_reviews(table)).where("passage = 1").orderBy("block").collect()
    assert [b["kind"] for b in blocks[:3]] == ["heading", "score", "quote"] and blocks[0]["text"].startswith("Passage 1 - ")
    assert any(b["kind"] == "factor" and " raised the model log-odds; observed value " in b["text"] for b in blocks)
    advice = signals.coaching(signals.top_signals(report.scored_sentences(table), key="row"), key="row")
    first = advice.where("rank = 1").orderBy("row").first()
    assert first["priority"] == "high" and first["title"] == X.COACHING[first["id"]][0]
    for r in report.relevant_coaching(report.passage_reviews(table), advice).collect():
        assert 1 <= len(r["ids"]) <= 2


def test_notes(audited):
    rows = {r["doc_id"]: r for r in report.notes(audited[0]).collect()}
    assert rows[0]["summary"].endswith("not who wrote the text.") and rows[0]["confidence_label"] in ("Moderate sample", "Broad sample")
    assert rows[2]["summary"].endswith("at least 300 are required for a reportable estimate.")
    assert rows[2]["confidence_reason"].startswith("Only 1 qualifying words across 1 sentence were available")
    intensity = signals.pattern_intensity(report.scored_sentences(audited[0]), key="row")
    lines = report.summary_rows(audited[0], intensity, report.passage_reviews(audited[0])).where("doc_id = 2").orderBy("line").collect()
    assert len(lines) == 9 and lines[0]["value"] == "Not enough prose"


def test_statistical_pattern_adds_to_signals_alone(audited):
    scored = report.scored_sentences(audited[0]).where("detected").first()
    assert [s["id"] for s in scored["signals"]][-1] == "statistical-pattern" and scored["signals"][-1]["impact"] == 20
    assert "% local estimate across " in scored["signals"][-1]["evidence"][0]
    before = min(100, (8 if scored["words"] >= 4 else 4) + sum(s["impact"] for s in scored["signals"][:-1]))
    assert scored["pattern_score"] == before


def plan(spark, texts, current=None, mode="comprehensive"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    audited = coverage.stored(df)
    shown = report.reportable(audited)
    from pyspark.sql import Window

    paragraph = F.sum(F.col("paragraph_before").cast("int")).over(Window.partitionBy("row").orderBy("i"))
    place = coverage.sentences(shown).withColumn("paragraph", paragraph).select("row", "i", "paragraph")
    targets = report.scored_sentences(shown).join(place, ["row", "i"])
    edits = revision.plan_edits(report.passage_members(audited), targets, mode)
    now = df if current is None else spark.createDataFrame(list(enumerate(current)), "doc_id long, text string")
    return edits, revision.plan_status(audited, report.passage_reviews(audited), edits, now)


def test_plans(spark):
    body = " ".join([FORMULAIC] * 9)
    texts = [body, "Short.", body]
    edits, status = plan(spark, texts, [body, "Short.", body[5:]])
    got = {r["doc_id"]: r for r in status.collect()}
    assert [got[i]["status"] for i in range(3)] == ["ready", "unavailable", "stale-audit"]
    assert got[0]["edits"] > 0 and got[0]["guidance"] == sorted(got[0]["guidance"]) and got[2]["edits"] == 0
    for r in edits.where("doc_id = 0").collect():
        assert texts[0][r["start"] : r["end"]] == r["before"] and r["after"] != r["before"] and r["rules"]
    source = spark.createDataFrame([(0, "ready", "a"), (1, "unavailable", "b"), (2, "ready", "old")], "doc_id long, status string, source string")
    now = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    new = now.withColumn("text", F.concat("text", F.lit("!")))
    assert {(r["doc_id"], r["status"], r["text"]) for r in revision.applied(source, now, new).collect()} == {(0, "applied", "a!"), (1, "stale-plan", "b"), (2, "stale-plan", "c")}


def test_repeated_transitions(spark):
    rows = [(1, 0, "Moreover, a b c.", 1, True), (1, 1, 'Moreover, "q" b.', 1, True), (1, 2, "moreover, d e f.", 1, True), (1, 3, "Moreover, g.", 2, True), (1, 4, "Moreover, h.", 2, False)]
    df = spark.createDataFrame(rows, "row long, i int, text string, paragraph int, repeated boolean")
    signal = F.array(F.struct(F.lit("repeated-transitions").alias("id")))
    df = df.withColumn("signals", F.when(F.col("repeated"), signal).otherwise(F.filter(signal, lambda s: F.lit(False))))
    assert [r["drop"] for r in revision.repeated_additive(df).orderBy("i").collect()] == [False, False, True, False, False]


def test_evaluation(spark):
    rows = [(1, True, 10, 0.9), (1, True, 90, 0.1), (2, True, 30, 0.9), (2, True, 70, 0.2), (3, False, 5, 0.99), (4, False, 5, 0.2)]
    df = spark.createDataFrame(rows, "doc_id long, human boolean, words int, probability double")
    got = calibration.document_rates(df, 0.5).first()
    assert tuple(got) == (2, 0.5, 2, 0.5)
    got = calibration.balanced_accuracy(df, "human", "probability", 0.5).first()
    assert (got["true_positive_rate"], got["true_negative_rate"], got["balanced_accuracy"]) == (0.5, 0.5, 0.5)
    docs = spark.createDataFrame([("train", i / 100, i / 100) for i in range(101)] + [("validation", 0.999, 0.999), ("test", 0.0, 0.0)], "split string, long_word_ratio double, lexical_share double")
    got = calibration.domain_bounds(docs, 0.9).first()
    assert got["long_word_bound"] == 0.9 and abs(got["train_unsupported"] - 10 / 101) < 1e-12 and got["validation_unsupported"] == 1.0
    rows = spark.createDataFrame([(1.0, 5.0, 2.0), (3.0, 5.0, 6.0)], "a double, b double, w double")
    assert [(r["feature"], r["mean"], r["scale"]) for r in calibration.standardize(rows, ["a", "b"], "w").orderBy("no").collect()] == [("a", 2.5, 0.75**0.5), ("b", 5.0, 1e-6)]


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:pPr><w:tabs><w:tab w:val='left' w:pos='4'/></w:tabs></w:pPr><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_files(spark, tmp_path):
    made = {
        "a.txt": "﻿  héllo \n".encode(), "b.MD": b"# T\n\ntext", "c.docx": docx("One", "Two&amp;"), "d.docx": b"no zip", "e.pdf": b"%PDF", "f.xyz": b"x",
        "g.txt": b" \n ", "h.txt": b"x" * 2_000_001, "i.txt": b"x" * (10 * 1024 * 1024 + 1), "j": b"none", "k.docx": docx(),
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: r for r in files.import_files(spark, str(tmp_path)).collect()}
    assert {n: r["reason"] for n, r in got.items()} == {
        "a.txt": None, "b.MD": None, "c.docx": None, "d.docx": "unreadable", "e.pdf": "needs-page-items", "f.xyz": "unsupported-type", "g.txt": "no-readable-text",
        "h.txt": "too-much-text", "i.txt": "too-large", "j": "unsupported-type", "k.docx": "no-readable-text",
    }
    assert got["a.txt"]["text"] == "héllo" and got["c.docx"]["text"] == "One\n\nTwo&" and got["c.docx"]["method"] == "docx-text" and got["b.MD"]["characters"] == 9
    sizes = spark.createDataFrame([(5,), (2048,), (1572864,)], "n long")
    assert [r["s"] for r in sizes.select(files.readable_bytes(F.col("n")).alias("s")).collect()] == ["5 B", "2 KB", "1.5 MB"]
    (tmp_path / "fam").mkdir()
    (tmp_path / "fam" / "e12.txt").write_text("essay")
    r = files.labelled_corpus(spark, str(tmp_path)).first()
    assert (r["family"], r["name"], r["number"], r["text"]) == ("fam", "e12", 12, "essay")


def test_page_numbers_and_compatible_forms(spark):
    rows = [(1, p, n, line, y, 800.0) for p in (1, 2, 3) for n, (line, y) in enumerate([("Ｕniversity ﬁle", 790.0), (f"Body {p} goes on", 400.0), ("12", 400.0), (f"{p}", 10.0), ("no place", None)])]
    rows += [(1, 4, 0, "university file", 790.0, 800.0), (1, 4, 1, "It ends here.”", 10.0, 800.0), (1, 1, 9, "It ends here.”", 10.0, 800.0)]
    df = spark.createDataFrame(rows, "book long, page long, line_no int, line string, y double, height double")
    assert [r["key"] for r in pages.repeated_artifacts(df).collect()] == ["top:university file"]
    left = pages.without_artifacts(df)
    assert left.columns == [*df.columns, "key"] or set(df.columns) <= set(left.columns)
    assert sorted({r["line"] for r in left.collect()}) == ["12", "Body 1 goes on", "Body 2 goes on", "Body 3 goes on", "It ends here.”", "no place"]
    text = {r["page"]: r["text"] for r in pages.page_texts(left).collect()}
    assert text[2] == "Body 2 goes on\n12\nno place"


def test_ocr_and_lookup(spark):
    good = "enough words are on this page to read it well"
    df = spark.createDataFrame([(1, 1, good), (1, 2, ""), (1, 3, "few"), (1, 4, None), (2, 1, "")], "book long, page long, text string")
    found = spark.createDataFrame([(1, 2, " seen text ", False), (1, 3, "", False), (1, 4, None, True)], "book long, page long, text string, failed boolean")
    done = pages.with_ocr(df, found)
    got = {(r["book"], r["page"]): (r["text"], r["source"], r["outcome"]) for r in done.collect()}
    assert got[1, 1] == (good, "embedded-text", None) and got[1, 2] == ("seen text", "ocr", "recognised") and got[1, 3] == ("few", "embedded-text", "ocr-empty")
    assert got[1, 4] == ("", "none", "ocr-failed") and got[2, 1] == ("", "none", "sparse")
    notes = {r["book"]: r for r in pages.import_notes(done).collect()}
    assert notes[1]["method"] == "pdf-mixed" and notes[1]["reason"] is None and notes[2]["reason"] == "scanned"
    assert notes[1]["warnings"] == [
        "Embedded text was sparse or missing on pages 3, 4.", "Local OCR failed on page 4.", "Local OCR returned no readable text for page 3.",
    ]
    spans = pages.spans(done.select("book", "page", "text"))
    asked = spark.createDataFrame([(1, 0), (1, len(good)), (1, len(good) + 2), (1, 10_000)], "book long, start long")
    assert {r["start"]: r["page"] for r in pages.page_of(asked, spans).collect()} == {0: 1, len(good): None, len(good) + 2: 2, 10_000: None}


def test_requests(spark):
    long = "a passage of some length, as asked for"
    rows = [("GET", None, "h", 0, None, None, 200), ("PUT", "h", "h", 0, long, "clarify", 405), (None, "h", "h", 0, long, "clarify", 405), ("POST", "x", "h", 0, long, "clarify", 403)]
    rows += [("POST", "h", "h", 12001, long, "clarify", 413), ("POST", "h", "h", None, "short", "clarify", 400), ("POST", "h", "h", 5, long, "other", 400), ("POST", "h", "h", 5, long, "clarify", 200)]
    df = spark.createDataFrame(rows, "method string, origin_host string, host string, body_bytes long, passage string, intent string, want int")
    assert requests.status_of(df, ("clarify",), F.lit(True)).where("status <> want").count() == 0
    assert requests.status_of(df, ("clarify",), F.lit(False)).where("status = 503").count() == 5
    bodies = ['{"output_text":"a"}', '{"output":[{"type":"x"},{"type":"message","content":[{"type":"other"},{"type":"output_text","text":"b"}]}]}', "{}", "bad"]
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select(requests.answer_text(F.col("b")).alias("t")).collect()
    assert [r["t"] for r in got] == ["a", "b", "", ""]


def test_undo_and_minor_edits(spark):
    history = spark.createDataFrame([(1, v) for v in range(14)] + [(2, 0)], "doc_id long, v int")
    kept = revision.last_versions(history, "doc_id", "v").collect()
    assert sorted(r["v"] for r in kept if r["doc_id"] == 1) == list(range(4, 14)) and len(kept) == 11
    edits = spark.createDataFrame([(1,), (1,), (2,), (2,), (2,), (2,), (3,)], "doc_id long")
    changed = spark.createDataFrame([(1, 6), (1, 6), (2, 1), (3, 13)], "doc_id long, changed long")
    assert {r["doc_id"]: r["minor"] for r in revision.minor_edits(edits, changed).collect()} == {1: True, 2: False, 3: False}
    over = spark.createDataFrame([(1, 0, 3, "one", "1"), (1, 2, 5, "e t", "X"), (1, 4, 7, "two", "2")], "doc_id long, start int, end int, before string, after string")
    assert revision.compose(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), over).first()["text"] in ("1 2", "1 two")


def test_word_files_and_paragraphs(spark):
    rows = [(1, "One & <two>\nstill one\n\nThree\x07"), (2, " \n "), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["paragraph"], r["text"]) for r in documents.clean_paragraphs(df).collect())
    assert got == [(1, 0, "One & <two> still one"), (1, 1, "Three"), (2, 0, "No readable text."), (3, 0, "No readable text.")]
    assert documents.clean_paragraphs(df, every_line=True).where("doc_id = 1").count() == 3
    made = {r["doc_id"]: bytes(r["content"]) for r in documents.word_files(documents.clean_paragraphs(df)).collect()}
    assert files.docx_text(made[1]) == "One & <two> still one\n\nThree\n\n" and made[2] == made[3]


def test_a_profile_is_an_argument(spark):
    table = features.profile_rows(spark)
    assert features.profile_of(table) == features.PROFILE
    strict = features.Profile(threshold=0.9999999)
    df = spark.createDataFrame([(1, " ".join([FORMULAIC] * 9))], "doc_id long, text string")
    assert coverage.coverage(df, profile=strict).first()["detected_words"] < coverage.coverage(df).first()["detected_words"]


def test_compatible_forms_are_one_protected_value(spark):
    pairs = spark.createDataFrame([(1, "It says “ﬁve things”, Ann Lee.", "It says “FIVE things”, ANN LEE.")], "k long, before string, after string")
    assert [(r["kind"], r["value"]) for r in revision.protected_diff(pairs, ["k"]).collect()] == []
