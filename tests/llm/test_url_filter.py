import random

from gazeframe.llm.url_filter import judge_urls


def _brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    seen = {}
    for h, p, v in rules:
        if h:
            k = (h.lower(), p or "")
            seen[k] = min(v, seen.get(k, v))
    for (h, p), v in seen.items():
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), h, p, v)
            if best is None or key > best:
                best = key
    return host, path, best[2] + best[3] if best else None, best[4] if best else default


def _cases(seed):
    rng = random.Random(seed)
    labels = ["com", "net", "a", "b", "ab", "x-y", "ünï", "😀"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, n)))
    path = lambda: "".join(rng.choice(["/", "a", "b/", "7"]) for _ in range(rng.randrange(0, 4)))
    rules = [(host(4), path(), rng.choice(["allow", "block"])) for _ in range(40)] + [("com", "", "block"), ("com", "", "allow"), ("COM", "/a", "block"), (None, "/", "block"), ("", "/", "block"), ("b.com", None, "block")]
    urls = [f"{rng.choice(['http', 'ftp'])}://{host(6).upper() if rng.random() < 0.3 else host(6)}{path()}{rng.choice(['', '?q=/a', '#/b', ':80/a'])}" for _ in range(300)]
    return [*urls, None, "", "no scheme", "://", "x://com", "http://a.com/a://b.net/", "http://.com/", "http://com./a", urls[0], urls[0]], rules


def test_against_brute_force(spark):
    for seed in range(3):
        urls, rules = _cases(seed)
        df = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, Host int").repartition(5)
        rs = spark.createDataFrame(rules, "host string, path string, verdict string")
        for kw in ({"salts": 3, "buckets": 4}, {}):
            got = {r.page_id: r for r in judge_urls(df, rs, **kw).collect()}
            assert len(got) == len(urls)
            for i, u in enumerate(urls):
                r = got[i]
                assert (r.host, r.path, r.rule, r.verdict) == _brute(u, rules), u


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rs = spark.createDataFrame([], "host string, path string, verdict string")
    assert judge_urls(df, rs, default="block").first().verdict == "block"
    assert judge_urls(df.limit(0), rs).count() == 0


def test_very_long_urls(spark):
    host, path = ".".join(["a"] * 3000) + ".example.com", "/en/" + "x/" * 50_000
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/x/x/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, f"https://{host}{path}?q"), (2, f"https://{host}/{'y' * 100_000}"), (3, "https://x.com" + path)], "page_id long, url string")
    got = {r.page_id: r for r in judge_urls(pages, rules).collect()}
    assert (got[1].verdict, got[1].rule, len(got[1].path)) == ("allow", "example.com/en/x/x/", len(path))
    assert got[2].rule is None and got[3].rule == "com/en/"
