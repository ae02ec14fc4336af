import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prosegrid.llm import packing as K

PATH = P.path("byte_bpe_50k.json")


def reference():
    return Tokenizer.from_file(PATH)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sreveldmtABz19.,!<|>\u00a0\u2003\u0301é日ß\u1e9e🙂\u200b"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_ids_are_the_tokenizers(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))).astype(np.int64)
    ids, bound = K.encoder(PATH).encode(data, offsets)
    t = reference()
    for i, x in enumerate(texts):
        assert ids[bound[i] : bound[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


def ids_of(encoder, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))).astype(np.int64)
    ids, bound = encoder.encode(data, offsets)
    return [ids[a:b].tolist() for a, b in zip(bound, bound[1:])]


def test_added_tokens_and_their_parts():
    texts = ["it's <|endoftext|> end", "<|endoftext|>", "", "<|endof", "text|>", "é<|endoftext|><|endoftext|>\n", "plain text", "<|endoftext|", "> x"]
    t = reference()
    assert 50256 in t.encode(texts[0], add_special_tokens=False).ids
    assert ids_of(K.encoder(PATH), texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_whose_hashes_meet(monkeypatch):
    monkeypatch.setattr(K, "mix", lambda h: h & np.uint64(15))  # sixteen hashes for all words
    texts = ["some words of several sizes, some more", "other words come here", "", "and 12 345 of it's \u00e9 ends"] * 3
    t = reference()
    assert ids_of(K.Encoder(PATH), texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_long_texts_and_a_loss_limit_that_binds(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "don't", "42"], n)) for n in [40000, *rng.integers(1, 900, 60)]]
    rows = [(i, t, int(rng.integers(0, 40)), 1) for i, t in enumerate(texts)] + [(900, None, None, 1), (901, "no prompt", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt long, sequence_id int")
    got = K.pack(df, PATH, prompt_col="prompt", loss=300, segments=12).collect()
    tokens, loss, pieces = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        tokens[r["sequence_id"]] += r["length"]
        loss[r["sequence_id"]] += r["loss_tokens"]
        pieces[r["sequence_id"]] += 1
    assert 200 < max(loss.values()) <= 300 and max(tokens.values()) < 1024 and max(pieces.values()) <= 12
    assert all(n & (n - 1) == 0 for n in tokens.values())
    t = reference()
    assert sum(tokens.values()) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _, _ in rows)


@pytest.mark.parametrize("limits", [(1024, 256, None), (1024, 8, None), (512, 64, 200), (64, 3, 10), (16, 1, None)])
def test_limits_and_lengths(limits):
    capacity, segments, loss = limits
    rng = np.random.default_rng(capacity + segments)
    packer = K.Packer(capacity, segments, loss, waiting=50)
    docs = [(i, int(n), int(rng.integers(0, n + 1))) for i, n in enumerate(rng.integers(1, 3 * capacity, 300))]
    docs += [(1000 + i, 1, 0) for i in range(200)]
    out = []
    for i, n, prompt in docs:
        out += packer.add(K.Piece(i, 0, n, prompt))
    out += packer.close()
    seen = defaultdict(list)
    for mine in out:
        total = sum(p.length for p in mine)
        assert 0 < total <= capacity and (total == capacity or total & (total - 1) == 0)
        assert len(mine) <= segments and sum(p.loss for p in mine) <= (loss or capacity)
        for p in mine:
            seen[p.doc].append((p.start, p.length))
    for i, n, _ in docs:
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_pack(spark):
    rng = np.random.default_rng(9)
    texts = [None, "", " ", "it's <|endoftext|> end", "x" * 50000] + [" ".join(rng.choice(["alpha", "bêta", "don't", "42", "\n"], rng.integers(1, 900))) for _ in range(80)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "hello", 5), (3, texts[3], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = K.pack(df, PATH).collect()
    t = reference()
    want = defaultdict(list)
    for i, x, _ in rows:
        want[i].append(t.encode(x or "", add_special_tokens=False).ids + [0])
    by_sequence, by_doc = defaultdict(list), defaultdict(int)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        full = want[r["id"]][0]
        assert ids.tolist() == full[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(full)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["id"]] += r["length"]
    assert {k: sum(map(len, v)) for k, v in want.items()} == dict(by_doc)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    assert K.pack(df.limit(0), PATH).count() == 0
    first = got[0]
    assert zlib.crc32(bytes(first["ids"])) >= 0


def test_workers_drop_encoders_for_other_work():
    from prosegrid.llm import blocks

    K.encoder(PATH)
    assert K._ENCODERS and blocks.KEPT["encoders"] is K._ENCODERS
    kept = K.encoder(PATH)
    assert list(blocks.lean(iter, keeps="encoders")([])) == [] and K.encoder(PATH) is kept
    assert list(blocks.lean(iter)([])) == [] and not K._ENCODERS
