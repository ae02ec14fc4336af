import gzip
import itertools

from prosegrid.llm import warc as W


def test_records(spark):
    http = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\nX: y: z\r\n\r\nbody\r\n\r\nmore"
    one = W.format_record({"WARC-Type": "response", "WARC-Record-ID": "<urn:1>", "WARC-Target-URI": "http://a/", "WARC-Date": "2024-01-02T03:04:05Z"}, http)
    two = W.format_record({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:2>", "WARC-Date": "bad"}, b"HTTP/1.1 304 Not Modified\r\ndate: now\r\n\r\n")
    df = spark.createDataFrame([(bytearray(one + two),), (bytearray(gzip.compress(one)),), (None,), (bytearray(b"junk"),), (bytearray(b""),)], "content binary")
    rows = W.read_warc(df).collect()
    assert len(rows) == 3
    r = [x for x in rows if x["type"] == "response"][0]
    assert (r["status"], r["url"], r["ts"], bytes(r["body"])) == (200, "http://a/", 1704164645, b"body\r\n\r\nmore")
    assert [x["ts"] for x in rows if x["type"] == "revisit"] == [None]


def record(i, block=b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"):
    return W.format_record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:{i}>"}, block)


def ids(data):
    return [r["headers"].get("warc-record-id") for r in itertools.islice(W.parse_records(data), 1000)]


def test_damaged_files():
    a, b, c = record(1), record(2), record(3)
    for bad in (b"-5", b"-100000", b"x", b"", b"1e3", b"9" * 40, "٣".encode()):
        head = b"WARC/1.1\r\nWARC-Record-ID: <urn:bad>\r\nContent-Length: " + bad + b"\r\n\r\n"
        assert ids(a + head + b + c) == ["<urn:1>", "<urn:2>", "<urn:3>"]
    assert ids(a + b[:-20] + b"") == ["<urn:1>"] and ids(a + b"WARC/1.1\r\nno end") == ["<urn:1>"] and ids(b"WARC/" * 50) == []
    whole = gzip.compress(a) + gzip.compress(b) + gzip.compress(c)
    assert ids(whole) == ["<urn:1>", "<urn:2>", "<urn:3>"] and ids(gzip.compress(a + b + c)) == ids(whole)
    assert ids(whole[: len(gzip.compress(a)) + 20]) == ["<urn:1>"]
    hurt = bytearray(whole)
    hurt[len(gzip.compress(a)) + 15] ^= 0xFF
    assert ids(bytes(hurt)) == ["<urn:1>"] and ids(b"\x1f\x8b") == [] and ids(whole + b"tail") == ids(whole)
    long = bytes(range(256)) * 20000
    for data in (record(9, long) + a, gzip.compress(record(9, long)) + gzip.compress(a)):
        first, second = W.parse_records(data)
        assert first["block"] == long and second["headers"]["warc-record-id"] == "<urn:1>"


def test_statuses_that_are_no_numbers(spark):
    lines = [b"HTTP/1.1 99999999999 X", b"HTTP/1.1 20", b"HTTP/1.1", b"HTTP/1.1 404 Not"]
    data = b"".join(record(i, x + b"\r\n\r\nb") for i, x in enumerate(lines))
    df = spark.createDataFrame([(bytearray(data), 7), (bytearray(gzip.compress(data)[:-9]), 7)], "content binary, status int")
    got = W.read_warc(df).collect()
    assert [r["status"] for r in got[:4]] == [None, None, None, 404] and len(got) >= 4
    assert W.read_warc(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(1, "http://a/", 10, 200, 'etag: "x"', "a1"), (1, "http://b/", 10, 200, 'etag: "y"', "b1"), (2, "http://a/", 20, 304, 'etag: "x"', None)]
    rows += [(2, "http://b/", 20, 304, 'etag: "z"', None), (2, "http://c/", 20, 304, 'etag: "x"', None), (2, "http://b/", 30, 304, 'etag: "y"', None)]
    rows += [(2, "http://b/", 30, 304, 'etag: "y"', None), (None, "http://a/", 40, 304, 'etag: "x"', None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "record_id long, url string, ts long, status int, headers string, payload string, target string, row int")
    got = sorted((r["record_id"] or 0, r["canonical"], r["outcome"], r["target_id"] or 0, r["payload"] or "") for r in W.resolve_revisits(df).collect())
    assert got == [
        (0, "http://a", "no-earlier-response", 0, ""),
        (2, "http://a", "resolved", 1, "a1"),
        (2, "http://b", "resolved", 1, "b1"),
        (2, "http://b", "resolved", 1, "b1"),
        (2, "http://b", "validator-mismatch", 0, ""),
        (2, "http://c", "no-earlier-response", 0, ""),
    ]


def brute(rows):
    out = []
    for r in rows:
        if r[3] != 304:
            continue
        best = max((x for x in rows if x[3] == 200 and None not in (x[0], x[1], x[2], r[1], r[2]) and x[1] == r[1] and x[2] < r[2]), key=lambda x: (x[2], x[0]), default=None)
        if best is None:
            out.append((r[0], "no-earlier-response", None, None))
            continue
        a, b = r[4], best[4]
        same = a["etag"].removeprefix("W/") == b["etag"].removeprefix("W/") if "etag" in a and "etag" in b else a.get("last-modified") is not None and a.get("last-modified") == b.get("last-modified")
        merged = {**b, **{k: v for k, v in a.items() if k in W.PERMITTED}}
        lines = "\n".join(f"{k}: {merged[k]}" for k in sorted(merged))
        out.append((r[0], "resolved", best[0], lines) if same else (r[0], "validator-mismatch", None, None))
    return sorted(out, key=repr)


def test_resolution_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        url = ["http://a/x", "http://b/y", "http://c/z", None][min(3, int(rng.integers(0, 12)))] if i % 3 else "http://hot/p"
        h = {}
        if rng.random() < 0.7:
            h["etag"] = ("W/" if rng.random() < 0.3 else "") + f'"{rng.integers(0, 3)}"'
        if rng.random() < 0.5:
            h["last-modified"] = f"day {rng.integers(0, 2)}"
        h["content-type"] = f"t{i}"
        if rng.random() < 0.5:
            h["vary"] = f"v{i}"
        rows.append((i, url, int(rng.integers(0, 300)) if i % 50 else None, 200 if rng.random() < 0.5 else 304, h))
    rows.append((None, "http://a/x", 5, 200, {}))
    frame = [(i, u, t, s, "\r\n".join(f"{k.title()}:  {v}" for k, v in h.items()), f"p{i}", "clash") for i, u, t, s, h in rows]
    df = spark.createDataFrame(frame, "record_id long, url string, ts long, status int, headers string, payload string, canonical string")
    for seconds in (7, 86400):
        got = W.resolve_revisits(df, seconds).collect()
        assert sorted(((r["record_id"], r["outcome"], r["target_id"], r["headers"]) for r in got), key=repr) == brute(rows)
        assert all((r["payload"] is None) == (r["target_id"] is None) for r in got)
    assert W.resolve_revisits(df.limit(0)).count() == 0


def test_canonical(spark):
    urls = {
        "HTTP://Ex.Com:80/A/?utm_source=x#f": "http://ex.com/A",
        "https://e.com:443?b=1&utm_medium=q&c=2": "https://e.com?b=1&c=2",
        "https://e.com/p?utm_a=1&z=2": "https://e.com/p?z=2",
        "no scheme/": "no scheme",
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["c"] for r in df.select("u", W.canonical_url(df["u"]).alias("c")).collect()} == urls


def test_long_headers_and_urls(spark):
    lines = "\r\n".join(f"x-{i}: {'v' * 50}" for i in range(400)) + '\r\netag: "e"'
    url = "http://a/" + "p" * 200_000
    rows = [(1, url, 1, 200, lines, "body"), (2, url + "#f", 2, 304, 'ETag: W/"e"\r\nnonsense\r\n: none', None), (3, "", 3, 304, None, None), (4, url, None, 304, "", None), (5, url, 9, None, "", None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers string, payload string")
    got = {r["record_id"]: r for r in W.resolve_revisits(df).collect()}
    assert got[2]["outcome"] == "resolved" and got[2]["payload"] == "body" and got[2]["headers"].count("\n") == 400
    assert got[3]["outcome"] == got[4]["outcome"] == "no-earlier-response" and set(got) == {2, 3, 4}
