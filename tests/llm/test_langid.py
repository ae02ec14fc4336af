import numpy as np
import pyarrow as pa

from prosegrid.llm import langid as L


def corpus():
    en = "the quick brown fox jumps over the lazy dog and then it was gone with the wind"
    de = "der schnelle braune fuchs springt über den faulen hund und dann war er mit dem wind weg"
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        lang, base = ("en", en) if i % 2 else ("de", de)
        rows.append((i, " ".join(rng.choice(base.split(), 30)), lang))
    return rows


def naive(model, text):
    total = dict(zip(model.langs, model.prior.tolist()))
    for n in L.ORDERS:
        for i in range(len(text) - n + 1):
            points = np.array([ord(c) for c in text[i : i + n]], np.uint32)
            grams, sizes = L._grams(points, np.array([0, n]), n)
            assert sizes.tolist() == [1]
            for k, lang in enumerate(model.langs):
                total[lang] += int(model.grams[k][grams[0]])
    best = max(total, key=lambda x: (total[x], [-ord(c) for c in x]))
    top = total[best]
    return best, 1 / sum(np.exp((v - top) / L.UNIT) for v in total.values())


def test_predictions_match_a_plain_sum_and_are_right(spark):
    rows = corpus()
    train = spark.createDataFrame(rows + [(99, None, "xx"), (98, "no label", None)], "doc_id long, text string, lang string")
    model = L.fit(train)
    assert model.langs == ["de", "en"] and model.prior.tolist()[0] == model.prior.tolist()[1]
    texts = [r[1] for r in rows] + ["a", "ß", "über", "x" * 5000, "1a", "日本語"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred long")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(df, model, keep={"doc_id": df["doc_id"]}).collect()}
    for i, t in enumerate(texts):
        want = naive(model, t)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-8
    assert [got[r[0]][0] for r in rows] == [r[2] for r in rows]


def test_undetermined_and_empty(spark):
    model = L.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 $%!\n"), (4, " "), (None, "the dog")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(df, model, keep={"doc_id": df["doc_id"]}).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), ("und", 0.0)) and got[None][0] == "en"
    kept = L.in_known_language(df.withColumn("c0", df["doc_id"]), model)
    assert kept.columns == ["doc_id", "text", "c0"] and [r["doc_id"] for r in kept.collect()] == [None]
    none = L.fit(df.selectExpr("text", "cast(null as string) as lang"))
    assert none.langs == [] and {r["lang_pred"] for r in L.identify(df, none, keep={"doc_id": df["doc_id"]}).collect()} == {"und"}
    assert L.identify(df.limit(0), model, keep={"doc_id": df["doc_id"]}).count() == 0


def test_texts_unlike_every_known_language_go(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(t.split()[: int(rng.integers(3, 31))]), x) for i, t, x in corpus() * 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    norms = L.norms(docs, model)
    noise = " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 5)) for _ in range(30))
    other = ["我们今天在北京的街上看到很多人在走路和买东西", "w szczebrzeszynie chrząszcz brzmi w trzcinie i szczebrzeszyn z tego słynie", noise]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + i, t) for i, t in enumerate(other)], "doc_id long, text string")
    assert L.in_known_language(df, model).count() == len(rows) + 3  # the probability among the labels does not tell
    kept = [r["doc_id"] for r in L.in_known_language(df, model, norms=norms).collect()]
    assert sorted(kept) == sorted(i for i, _, _ in rows)
    none = L.fit(df.selectExpr("text", "cast(null as string) as lang"))
    assert L.in_known_language(df, none, norms=L.norms(docs, none)).count() == 0


def test_blocks_of_texts_agree_with_single_texts():
    rng = np.random.default_rng(2)
    model = L.Model(["a", "b"], rng.integers(-1000, 0, (2, L.BUCKETS)).astype(np.int32), np.array([-5, -3]))
    texts = ["", "é", "ab", "abc", None, "日本" * 3, "x" * 1200000, "q"]
    together = L.scores(model, pa.array([t and t.encode() for t in texts], pa.binary()))
    for i, t in enumerate(texts):
        one = L.scores(model, pa.array([t and t.encode()], pa.binary()))
        assert one[0][0] == together[0][i] and one[1][0] == together[1][i]
