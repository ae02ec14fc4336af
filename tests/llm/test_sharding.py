import zlib
from collections import Counter, defaultdict

import pytest

from prosegrid.llm import sharding as S


@pytest.mark.parametrize("shards", [24, 5])
def test_law_and_groups(spark, shards):
    texts = [f"text {i}" for i in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, "hot") for i in range(200)] + [(2000 + i, texts[i % 40]) for i in range(160)]
    rows += [(3000, None), (3001, ""), (None, "null id"), (7, texts[7]), (7, texts[7])]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, label int, row int").repartition(6)
    out = S.shard(df, shards=shards).collect()
    assert len(out) == len(rows)
    number = Counter(r["shard"] for r in out)
    assert max(number.values()) - min(number.get(s, 0) for s in range(shards)) <= 1 and set(number) <= set(range(shards))
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in out) == want
    places = defaultdict(set)
    for r in out:
        places[r["text_crc32"]].add(r["shard"])
    # A boundary goes through one group at most; at 24 shards 42 groups of several rows could be cut.
    cut = sum(len(p) > 1 for p in places.values())
    assert cut <= shards - 1
    again = S.shard(df.repartition(3), shards=shards).collect()
    assert {(r["id"], r["shard"], r["slot"]) for r in out if r["id"] != 7} == {(r["id"], r["shard"], r["slot"]) for r in again if r["id"] != 7}


def test_small_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    assert sorted(r["slot"] for r in S.shard(df).collect()) == [0, 0]
    assert S.shard(df.limit(0)).count() == 0


def test_long_texts(spark):
    long = "wörd " * 400_000
    rows = [(1, long), (2, long), (3, long + "x"), (4, None)] + [(10 + i, f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r for r in S.shard(df, shards=4).collect()}
    assert got[1]["size"] == len(long.encode()) + 8 and got[1]["text_crc32"] == zlib.crc32(long.encode()) and got[4]["size"] == 8
    assert got[1]["shard"] == got[2]["shard"]
