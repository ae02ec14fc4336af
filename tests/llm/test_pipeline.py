import corpus_pipeline
from prosegrid.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "mix_sources", "pack_sequences"]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.store(stage(spark, docs, SF))
        counts.append(docs.count())
        if name != "pack_sequences":
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            assert docs.select("text").distinct().count() == docs.count()
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] > 0
    out = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert out.select(key).exceptAll(docs.select(key)).count() == 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_stages_bear_nulls_repeats_long_texts_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.where("length(text) > 400").orderBy("doc_id").limit(60).collect()]
    d, text, lang, source, n = rows[0]
    long = " ".join(r[1] for r in rows) * 4
    rows += [rows[1]] * 3 + [(None, *rows[2][1:])] * 2 + [(None, text + " and a few words more", lang, source, n)]
    rows += [(9001, None, lang, source, None), (9002, "", None, None, 0), (9003, " \n ", lang, None, 3), (9004, long, None, source, len(long)), (9005, long, lang, None, None)]
    rows += [(9006, rows[3][1], None, None, None), (rows[4][0], rows[5][1], lang, source, n), (9007, "单字。" * 200, None, source, 600)]
    extra = "id long, t1 string, again boolean, digest string, cuts int, copies int, c0 string, kind string"
    df = spark.createDataFrame([(*r, i, "x", None, "y", i, i, None, "z") for i, r in enumerate(rows)], f"{docs._jdf.schema().toDDL()}, {extra}")
    scratch, now = Scratch(spark, "test"), df
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, scratch.store(stage(spark, now, SF))
        if name != "pack_sequences":
            assert now.columns == df.columns
        if name in ("language_id", "simhash_near_dedup"):
            assert now.exceptAll(before).count() == 0
        if name == "simhash_near_dedup":
            # Every text once, but for the one with a few words more, which is a near copy.
            assert now.count() == now.select("text").distinct().count() == before.select("text").distinct().count() - 1
            assert now.where("text is null or trim(text) = ''").count() == 0
    assert now.count() > 0 and now.agg({"length": "max"}).first()[0] <= 1024
