import random

from veldra.llm import urls


def brute(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = [None, "", "no scheme", "http://", "https://ORG/", "https://x.org", "https://x.org/", "http://a.example.org/es/1?x=/en/", "https://example.org/en/123#a", "https://example.org/en/2", "http://notexample.org/es/", "a://b.com/fr/x://c", "https://x.com/de/", "https://x.com/de", "https://É.Com/fr/", "https://com/fr/", "http://x\n.org/\n/y", "http://.org/", "http://x.org./"]


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)] + [(None, URLS[7], "r"), (7, URLS[7], "r")], "page_id long, url string, rule string")
    for limit in (None, 0):
        if limit == 0:
            urls.BROADCAST_BYTES = 0
        try:
            got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
            assert urls.judge(pages).count() == len(URLS) + 2
        finally:
            urls.BROADCAST_BYTES = 64 << 20
        assert got == {(i, *brute(u, urls.RULES)) for i, u in enumerate(URLS)} | {(None, *brute(URLS[7], urls.RULES))}
    assert urls.judge(pages.limit(0)).count() == 0


def test_many_rules():
    r = random.Random(0)
    label = lambda: r.choice(["a", "b", "c", ""])
    for _ in range(300):
        rules = [(r.choice(["allow", "block"]), ".".join(label() for _ in range(r.randint(1, 3))), "/" + "/".join(label() for _ in range(r.randint(0, 3)))) for _ in range(8)]
        trie = urls.Trie(rules)
        for _ in range(20):
            host, path = ".".join(label() for _ in range(r.randint(1, 4))), r.choice(["", "/", "/"]) + "/".join(label() for _ in range(r.randint(0, 4)))
            if path and path[0] != "/":
                path = "/" + path
            want = brute(f"s://{host}{path}", rules)
            assert (trie.longest(host, path)[0], trie.longest(host, path)[1] or "allow") == want[2:]
