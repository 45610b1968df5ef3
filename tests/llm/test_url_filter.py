import re

from tidewire.llm.url_filter import HOST_RULES, PATTERN_RULES, PatternRule, judge_urls, literal_tokens

URLS = [
    None, "", "no scheme", "http://", "HTTP://Sub.EXAMPLE.net/en/x?utm_source=1", "http://example.net/en", "https://net", "https://net/", "http://xnet/", "http://a.net/EN/#x", "ftp://example.com/de/1",
    "http://EXAMPLE.com/de/1", "http://notexample.com/de/", "http://b.example.com:80/de/", "http://w.org/fr/", "http://w.org/fr", "http://x.com/ads/1", "http://x.com/ads", "http://x.com/a?ref=1", "http://x.com/a?xref=1",
    "http://x.com/?UTM_Medium=2", "http://x.com/article/7", "http://x.com/article/7?ref=", "http://x.com/print/77", "http://x.com/print/y", "http://a?b://c/d", "http://x.com/a\nb/ads/", "x://y?z#w/ads/",
]


def brute(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    rest = after[len(host) + len(path) :]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    whole = (host + path + rest).lower()
    hits = sorted((r.action, r.name) for r in PATTERN_RULES if re.search(r.pattern, whole))
    verdict = best.action if best else hits[-1][0] if hits else "allow"
    return host, path, best and best.host + best.path, None if best else hits[-1][1] if hits else None, verdict


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    rows = judge_urls(pages).orderBy("page_id").collect()
    assert len(rows) == 2 * len(URLS)
    for r, u in zip(rows, URLS * 2, strict=True):
        assert (r.host, r.path, r.rule, r.pattern_rule, r.verdict) == brute(u), u


def test_literal_tokens():
    assert literal_tokens(r"[?&]utm_(source|medium)=") == [["utm"], ["source", "medium"]]
    assert literal_tokens(r"/article/\d+") == [["article"]]
    assert literal_tokens(r"/ads?/") == []
    assert literal_tokens(r"ads/") == []
    assert literal_tokens(r"/a/|/b/") == []


def test_rules_without_literals(spark):
    pages = spark.createDataFrame([(1, "http://x/aaa"), (2, "http://x/b")], "page_id long, url string")
    rows = judge_urls(pages, hosts=(), patterns=(PatternRule("block", "run", r"a{3}"),)).orderBy("page_id").collect()
    assert [(r.pattern_rule, r.verdict) for r in rows] == [("run", "block"), (None, "allow")]
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
