from collections import Counter, defaultdict

from prosegrid.llm import urls as U


def brute(pages, rounds=U.ROUNDS):
    import re

    judged, edges, seeds = [], set(), {"t": Counter(), "d": Counter()}
    for i, url, html in pages:
        m = re.match(U.URL, url or "")
        host, path = (m[1].lower() if m else ""), (m[2] if m else "")
        fits = [r for r in U.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        judged.append((i, host, path, rule))
        if rule:
            seeds["t" if rule[0] == "allow" else "d"][host] += 1
        for to in re.findall(U.LINK, html or ""):
            if host and to.lower() != host:
                edges.add((host, to.lower()))
    rank = {}
    for kind, seed in seeds.items():
        start = {h: n * U.MASS // sum(seed.values()) for h, n in seed.items()}
        out = defaultdict(list)
        for a, b in edges:
            out[a if kind == "t" else b].append(b if kind == "t" else a)
        now = dict(start) if edges else {h: m * 15 // 100 for h, m in start.items()}
        for _ in range(rounds if edges else 0):
            new = Counter({h: m * (100 - U.DAMPING) // 100 for h, m in start.items()})
            for h, m in now.items():
                for to in out[h]:
                    new[to] += m * U.DAMPING // (100 * len(out[h]))
            now = new
        rank[kind] = now
    return sorted(
        ((i, h, p, r and r[1] + r[2], r[0] if r else "block" if rank["d"].get(h, 0) > rank["t"].get(h, 0) else "allow") for i, h, p, r in judged),
        key=repr,
    )


PAGES = [
    (1, "https://Bad.COM/en/1?x", '<a href="http://mid.org/">'),
    (2, "http://mid.org/fr/2#t", "<a HREF='//bad.com/en/x'> <a href=https://lone.io>"),
    (3, "http://good.net/de/3", '<a href="http://friend.io/a">x</a><a href="/local">'),
    (4, "http://friend.io/", '<a href="http://far.io:80/">'),
    (5, "http://far.io:80/en/1", None),
    (6, "http://www.example.com/en/77", ""),
    (7, "http://www.example.com/en/6", ""),
    (8, "http://a.example.net/de/81/", ""),
    (9, "http://a.example.net/fr", ""),
    (10, "no scheme", '<a href="http://x.io">'),
    (11, None, None),
    (12, "https://com/en/", ""),
    (13, "https://xexample.com/es/7?a://b", ""),
    (14, "file:///x/y", ""),
    (15, "http://x.org?q/es/", ""),
    (16, "http://linker.io/", '<a href="http://bad.com/">'),
    (None, "http://x.org/es/1\nz", ""),
    (1, "https://Bad.COM/en/1?x", '<a href="http://mid.org/">'),
]


def test_matches_brute_force(spark):
    for pages in (PAGES, [(i, u, "") for i, u, _ in PAGES]):
        df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
        got = sorted(((r["id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(df).collect()), key=repr)
        assert got == brute(pages)
    by_id = {r[0]: r[4] for r in brute(PAGES)}
    assert by_id[16] == "block" and by_id[4] == by_id[5] == "allow"


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert U.judge_urls(df).count() == 0


def test_evidence_reaches_far_whatever_the_seeds(spark):
    chain = [(i, f"http://h{i}.io/", f'<a href="http://{"bad.com" if i == 0 else f"h{i - 1}.io"}/">') for i in range(20)]
    df = spark.createDataFrame([(99, "http://bad.com/en/1", ""), *chain], "page_id long, url string, html string")
    assert {r["verdict"] for r in U.judge_urls(df).collect()} == {"block"}
    seeds = spark.createDataFrame([("d", "a", 1), ("d", "z", 5_000_000)], "kind string, host string, n long")
    edges = [(f"b{i}", "a") for i in range(100)] + [(f"c{i}", "b0") for i in range(100)] + [(f"d{i}", "c0") for i in range(100)]
    ranks = U.propagate(seeds, spark.createDataFrame([*edges, ("e", "d0")], "src string, dst string"), U.Scratch(spark, "test"))
    found = {r["host"]: r["distrust"] for r in ranks.collect()}
    assert found["a"] > found["b0"] > found["c0"] > found["d0"] > found["e"] > 0


def test_long_and_odd_pages(spark):
    html = "<p>text</p>" * 200_000 + '<a href="//far.example/x">l</a>' + "".join(f'<a href="http://h{i}.info/">' for i in range(3000))
    rows = [(1, "http://EXAMPLE.com/en/7/" + "a" * 300_000, html, "x"), (1, "http://far.example/", None, "y"), (None, None, "", "z"), (2, "no scheme", html, "z"), (2, "http://a.org/es/1", "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted(((r["id"] or 0), r["host"], len(r["path"]), r["rule"], r["verdict"], r["trust"] > 0) for r in U.judge_urls(df).collect())
    assert got == [
        (0, "", 0, None, "allow", False),
        (1, "example.com", 300_006, "example.com/en/7", "allow", True),
        (1, "far.example", 1, None, "allow", True),
        (2, "", 0, None, "allow", False),
        (2, "a.org", 5, "org/es/", "block", False),
    ]
    assert U.judge_urls(df.limit(0)).count() == 0
