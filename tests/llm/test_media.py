import hashlib
import struct
import zlib

import numpy as np
import pytest

from prosegrid.llm import media as M


@pytest.mark.parametrize("n", [64, 128, 1024, 4096, 4160, 64 * 66, 64 * 1000, 64 * 4099])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for payload in (rng.integers(0, 256, n, np.uint8).tobytes(), b"\xff" * n, b"\0" * n, bytes(range(256)) * (n // 256) + b"\x80" * (n % 256)):
        data = M.encode(payload)
        video = M.parse(data)
        assert M.payload_of(video) == payload and M.features(data)[3] == payload
        assert struct.unpack_from("<I", data, 4)[0] + 8 == len(data)


def test_zigzag_and_transform():
    assert M.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(M.ZIGZAG) == list(range(64))
    flat = np.zeros((1, 64), np.int64)
    flat[0, 0] = 8 * 20
    assert (M.samples(flat) == 148).all()
    rng = np.random.default_rng(0)
    px = rng.integers(0, 256, (8, 8))
    c = np.array([[np.cos((2 * x + 1) * k * np.pi / 16) * (np.sqrt(0.125) if k == 0 else 0.5) for x in range(8)] for k in range(8)])
    coefficients = (c @ (px - 128.0) @ c.T).reshape(64)[M.ZIGZAG]
    assert np.abs(M.samples(np.rint(coefficients)[None]).reshape(8, 8).astype(int) - px).max() <= 2


def general(blocks, across, tables, restart=0, comps=1):
    """A frame by plain Huffman coding, with fixed 8-bit codes; ``comps`` 3 has 2x2 sampling."""
    symbols = list(range(0, 251))
    code = {s: format(i, "08b") for i, s in enumerate(symbols)}
    bits = ""

    def put(v, run):
        nonlocal bits
        size = abs(v).bit_length()
        bits += code[run << 4 | size] + (format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else "")

    out, last = b"", [0] * comps

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""
        return data

    units = blocks if comps == 1 else [b for m in blocks for b in m]
    per = 1 if comps == 1 else 6
    for i, b in enumerate(units):
        if restart and i and i % (restart * per) == 0:
            out += flush() + bytes([0xFF, 0xD0 + (i // (restart * per) - 1) % 8])
            last = [0] * comps
        c = 0 if comps == 1 or i % 6 < 4 else i % 6 - 3
        put(int(b[0]) - last[c], 0)
        last[c] = int(b[0])
        run, end = 0, max([0, *np.flatnonzero(b).tolist()])
        for v in b[1 : end + 1].tolist():
            if v == 0:
                run += 1
                if run == 16:
                    put(0, 15)
                    run = 0
            else:
                put(v, run)
                run = 0
        if end < 63:
            put(0, 0)
    out += flush()
    n = len(blocks)
    scale = 8 if comps == 1 else 16
    table = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    parts = b"\x01\x11\x00" if comps == 1 else b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    sof = struct.pack(">BHHB", 8, scale * (n // across) - 3, scale * across - 2, comps) + parts
    sos = bytes([comps]) + b"".join(bytes([i + 1, 0]) for i in range(comps)) + b"\0\x3f\0"
    q = b"\0" + bytes([2] * 64)
    return (
        b"\xff\xd8" + M._segment(0xE0, b"JFIF\0") + M._segment(0xDB, q) + M._segment(0xC0, sof) + M._segment(0xC4, b"\0" + table)
        + M._segment(0xC4, b"\x10" + table) + (M._segment(0xDD, struct.pack(">H", restart)) if restart else b"") + M._segment(0xDA, sos) + out + b"\xff\xd9"
    )


def test_general_frames():
    rng = np.random.default_rng(3)
    for restart in (0, 2):
        b = rng.integers(-90, 90, (6, 64)) * (rng.random((6, 64)) < 0.2)
        got = M.decode_frame(general(b, 3, None, restart))
        want = M.samples(b * 2).reshape(2, 3, 8, 8).transpose(0, 2, 1, 3).reshape(16, 24)[:13, :22]
        assert (got == want).all()
        m = rng.integers(-60, 60, (4, 6, 64)) * (rng.random((4, 6, 64)) < 0.1)
        got = M.decode_frame(general(m, 2, None, restart, 3))
        px = M.samples((m[:, :4] * 2).reshape(-1, 64)).reshape(2, 2, 2, 2, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(32, 32)
        assert got.shape == (29, 30) and (got == px[:29, :30]).all()


def test_fast_and_general_decoders_agree():
    data = M.encode(np.random.default_rng(4).integers(0, 256, 64 * 12, np.uint8).tobytes())
    frame = M.parse(data).frames[0]
    quick = M.decode_frame(frame)
    original, M._fast = M._fast, lambda f: None
    try:
        assert (M.decode_frame(frame) == quick).all()
    finally:
        M._fast = original


def test_shots():
    a, b = np.array([100, 0, 0]), np.array([0, 0, 100])
    assert M.shots(np.array([a, a, a, b, b, a])) == [(0, 3), (3, 5), (5, 6)]
    assert M.shots(np.array([a])) == [(0, 1)] and M.shots(np.empty((0, 3))) == []
    drift = np.array([[100 - 8 * i, 8 * i, 0] for i in range(10)])
    assert M.shots(drift) == [(0, 10)]


def test_frames(spark):
    texts = ["", None, "x", "é" * 32, "a" * 64, "b" * 5000, "c" * 300000, "x"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, media int")
    media = M.with_media(df)
    rows = {r["id"]: r for r in M.read_media(media).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        raw_padded = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(raw_padded))
        assert r["payload_sha256"] == hashlib.sha256(raw_padded).hexdigest() and r["tail_crc32"] == zlib.crc32(raw_padded[-64:])
        stored = M.encode(raw_padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[2]["feature"] == rows[7]["feature"] == rows[None]["feature"]
    clips = M.clips(M.read_media(media)).where("id = 6").orderBy("clip").collect()
    assert clips[0]["first"] == 0 and all(a["end"] == b["first"] for a, b in zip(clips, clips[1:]))
    assert clips[-1]["end_s"] == round(clips[-1]["end"] / M.FPS, 6)
    bad = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"RIFFxxxx")), (3, 0, bytearray(b""))], "id long, n_bytes long, media binary")
    assert [(r["feature"], r["clips"]) for r in M.read_media(bad).collect()] == [(None, [])] * 3
    assert M.read_media(M.with_media(df.limit(0))).count() == 0


def test_index_from_the_file_start_and_no_index():
    data = M.encode(b"\x07" * 9000 + b"\0" * 24)
    movie = data.find(b"movi")
    at = data.rfind(b"idx1")
    moved = bytearray(data)
    for i in range(at + 8, len(data), 16):
        moved[i + 8 : i + 12] = struct.pack("<I", struct.unpack_from("<I", data, i + 8)[0] + movie)
    assert M.payload_of(M.parse(bytes(moved))) == M.payload_of(M.parse(data)) == M.payload_of(M.parse(data[:at]))


def test_reading_bits_does_not_depend_on_what_follows():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 256, 2_000_000, np.uint8).tobytes()
    whole, bits = "".join(f"{b:08b}" for b in data[:4000]), M._Bits(data)
    at = 0
    while at < 31000:
        n = int(rng.integers(1, 17))
        assert bits.take(n) == int(whole[at : at + n], 2)
        at += n
    end = M._Bits(b"\xa5")
    assert end.take(8) == 0xA5
    with pytest.raises(ValueError):
        end.take(1)


def test_long_and_odd_texts(spark):
    long = "lång text " * 300_000
    rows = [(1, long, "x"), (2, long, "y"), (3, None, "z"), (None, "", "z"), (3, "a", "z")]
    df = spark.createDataFrame(rows, "id long, text string, media string").withColumnRenamed("id", "doc_id")
    got = M.read_media(M.with_media(df)).collect()
    assert sorted((r["id"] or 0, r["n_bytes"], r["payload_bytes"]) for r in got) == [(0, 0, 64), (1, 3300000, 3300032), (2, 3300000, 3300032), (3, 0, 64), (3, 1, 64)]
    raw = long.encode()
    for r in got:
        if r["n_bytes"] == len(raw):
            assert r["payload_sha256"] == hashlib.sha256(raw + b"\0" * 32).hexdigest() and r["feature"] and r["clips"]
    assert M.read_media(M.with_media(df.limit(0))).count() == 0
