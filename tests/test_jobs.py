import datetime as dt

from pyspark.sql import functions as F

from tidewire.plans import jobs
from tidewire.sources.discovery import READERS

AT = dt.datetime(2024, 1, 10)
BODY = "x" * 100


def test_ingest(spark):
    feed = "<rss><channel><item><title>T</title><link>https://a.com/1?utm_source=x</link></item></channel></rss>"
    docs = spark.createDataFrame(
        [("c1", "rss", "https://a.com/f", feed, None), ("c2", "rss", "https://a.com/g", feed, None), ("c3", "rss", "https://b.com", None, "HTTP 500"), ("c4", "rss", "x", feed, None)],
        "channel string, kind string, url string, content string, error string",
    )
    allowed = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "channel string")
    items, failures = jobs.discovered(allowed, docs, READERS)
    assert items.count() == 2 and [r.channel for r in failures.collect()] == ["c3"]
    channels = spark.createDataFrame([("c1", "p", "ar"), ("c2", "p", "ar")], "channel string, publisher string, language string")
    rows = jobs.article_candidates(items, channels).collect()
    assert [(r.channel, r.canonical_url) for r in rows] == [("c1", "https://a.com/1")]


def test_fetch_transition(spark):
    kind = "article_id int, title string, body string, published_at timestamp, version int, content_hash string"
    articles = spark.createDataFrame([(1, "a", None, AT, 1, "h"), (2, "b", "", AT, 1, "h"), (3, "c", BODY, AT, 1, "h"), (4, "d", None, None, 1, "h"), (5, "e", None, dt.datetime(2023, 1, 1), 1, "h")], kind)
    pages = spark.createDataFrame([(1, BODY, None, "new"), (2, BODY, dt.datetime(2020, 1, 1), None), (3, BODY + "y", AT, None), (5, BODY, None, None)], "article_id int, body string, published_at timestamp, title string")
    rows = jobs.fetch_transition(articles, pages, F.lit("2024-01-05").cast("timestamp"), 3).orderBy("article_id").collect()
    assert [(r.state, r.version) for r in rows] == [("fetched", 2), ("stale", 1), ("not_asked", 1), ("not_asked", 1), ("stale", 1)]
    assert rows[0].title == "new" and rows[0].body == BODY and rows[0].content_hash != "h"


def test_payloads_and_api(spark):
    page = '<script id="__NEXT_DATA__">{"a": [{"id": 7, "slug": "s", "title": "T"}, {"b": {"id": 8, "slug": "z"}}]}</script>'
    docs = spark.createDataFrame([("c", "https://a.com/x", page), ("c", "https://a.com/y", "none")], "channel string, url string, content string")
    rows = jobs.payload_items(docs, "{base}/article/{id}/{slug}").orderBy("position").collect()
    assert [r.source_url for r in rows] == ["https://a.com/article/7/s", "https://a.com/article/8/z"]
    api = spark.createDataFrame([(1, '{"data": {"result": {"title": " t ", "content": "<p>a</p><p>b</p>", "date": "2024-01-02"}}}'), (2, "{}")], "article_id int, content string")
    rows = jobs.api_article(api).orderBy("article_id").collect()
    assert (rows[0].title, rows[0].body, rows[0].body_source) == ("t", "a\nb", "site_api") and rows[1].body_source is None


def test_sources(spark):
    kind = "publisher string, channel string, disposition string, enabled boolean, connector_type string"
    channels = spark.createDataFrame([("p", "a", None, True, "rss"), ("p", "b", "awaiting_licensing", True, "rss"), ("p", "c", "blocked", True, "rss"), ("p", "d", None, True, "licensed_api"), ("p", "e", "awaiting_licensing", True, "rss")], kind)
    overrides = spark.createDataFrame([("p", "e", "epaper")], "publisher string, channel string, connector_type string")
    skipped = spark.createDataFrame([("p", "a")], "publisher string, channel string")
    rows = jobs.enablement(channels, overrides, skipped).orderBy("channel").collect()
    assert [r.reason for r in rows] == ["explicitly_skipped", "awaiting_licensing", "blocked", "connector_not_scrapeable", "enabled"]
    matrix = jobs.closure_rows(spark, "channels:\n- {publisher: p, channel: a, disposition: active, enabled: false}\n")
    rows = jobs.apply_closure(channels, matrix).orderBy("channel").collect()
    assert (rows[0].disposition, rows[0].enabled, rows[1].enabled) == ("active", False, True)
    runs = spark.createDataFrame([("a", 1, AT, "ok"), ("a", 2, AT + dt.timedelta(1), "failed")], "channel string, run_id int, at timestamp, status string")
    health = jobs.source_health(channels.select("channel"), runs, spark.createDataFrame([("a",)] * 7, "channel string")).orderBy("channel").collect()
    assert tuple(health[0]) == ("a", 2, "failed", 5) and health[1].recent_failure_count == 0
    assert jobs.seed(channels, channels.limit(2), ["publisher", "channel"]).count() == 5


def test_proposals(spark):
    terms = spark.createDataFrame([(1, 0, "Harbour Line", "en", False, "canonical")], "entity_id long, pos int, surface string, language string, exact_only boolean, source string")
    none = spark.createDataFrame([], "entity_id long, phrase string")
    kind = "page_id long, title string, body string, blocks array<struct<text:string,x:double,y:double,w:double,h:double>>"
    pages = spark.createDataFrame([(1, "News", "x\nharbour line", [("x", 0.1, 0.1, 0.1, 0.1), ("harbour line", 0.2, 0.2, 0.2, 0.2)]), (2, "News", "none", [])], kind)
    found = jobs.cuttings(pages, terms, none)
    assert [(r.page_id, r.box.x) for r in found.collect()] == [(1, 0.2)]
    posts = spark.createDataFrame([(i, AT + dt.timedelta(i), "Harbour Line" if i % 2 else "z") for i in range(10)], "post_id long, posted_at timestamp, text string")
    assert sorted(r.post_id for r in jobs.social_matches(posts, terms, none, 4).collect()) == [7, 9]
    old = spark.createDataFrame([(1, "included", 0.1), (2, "adjusted", 0.1)], "k int, status string, score double")
    new = spark.createDataFrame([(1, "x", 0.9), (2, "x", 0.9), (3, "x", 0.9)], "k int, status string, score double")
    assert [tuple(r)[:3] for r in jobs.propose(old, new, ["k"]).orderBy("k").collect()] == [(1, "included", 0.1), (2, "adjusted", 0.9), (3, "proposed", 0.9)]
    inbox = spark.createDataFrame([(1, 1, 1, "exact", 1.0, "pending_review")], "tenant int, entity int, article int, match_type string, score double, status string")
    more = spark.createDataFrame([(1, 1, 1, 0.0, 0.5), (1, 1, 2, None, 0.6)], "tenant int, entity int, article int, lexical double, similarity double")
    rows = jobs.mirrored(inbox, more).orderBy("article").collect()
    assert [r.match_type for r in rows] == ["exact", "semantic_assisted"]


def test_reading(spark):
    kind = "article_id int, body string, published_at timestamp, discovered_at timestamp"
    articles = spark.createDataFrame([(1, "a  b", AT, AT), (2, "c", None, AT), (3, "d", dt.datetime(2020, 1, 1), AT)], kind)
    images = spark.createDataFrame([(1, AT, "late"), (1, dt.datetime(2020, 1, 1), "first")], "article_id int, created_at timestamp, image_url string")
    rows = jobs.dashboard(articles, images, F.lit("2024-01-11").cast("timestamp")).collect()
    assert [(r.article_id, r.image_url, r.snippet) for r in rows] == [(1, "first", "a b")]
    rows = spark.createDataFrame([(1, 7, "proposed", AT), (2, 7, "included", AT), (3, 8, "proposed", AT)], "id int, tenant_id int, status string, created_at timestamp")
    assert [r.id for r in jobs.listed(rows, 7).collect()] == [1, 2] and [r.id for r in jobs.listed(rows, 7, "included").collect()] == [2]
    tree = jobs.edition_tree(spark.createDataFrame([(1,)], "edition_id int"), spark.createDataFrame([(1, 2, 20), (1, 1, 10)], "edition_id int, page_number int, page_id int"), spark.createDataFrame([(10, 1, "b"), (10, 0, "a")], "page_id int, block_no int, text string")).first()
    assert [p.page_id for p in tree.pages] == [10, 20] and [b.text for b in tree.pages[0].blocks] == ["a", "b"]
