import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tidewire.operators.extraction import extract_articles
from tidewire.sources import discovery
from tidewire.streaming import pipeline as streams

FEED = """<rss version="2.0"><channel><title>x</title>
<item><title> One </title><link>https://a.com/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>
<item><title>Two</title><link>https://a.com/2</link></item>
<item><title>Again</title><link>https://a.com/1</link></item>
<item><title>Old</title><link>https://a.com/3</link><pubDate>Tue, 02 Jan 2001 03:04:05 GMT</pubDate></item></channel></rss>"""
ATOM = '<feed><entry><title>E</title><link href="https://a.com/e" rel="alternate"/><updated>2024-01-05T00:00:00Z</updated></entry></feed>'
SITEMAP = "<urlset><url><loc>https://a.com/1</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://a.com/more.xml</loc></url><url><loc>https://a.com/2</loc></url></urlset>"
LISTING = '<a href="/news/1#x">A long enough title</a><a href="https://other.com/2">off site</a><a class="k" href="news/3?a=1"><b>Short</b></a><a href="#x">x</a><a href="/news/1">Again again</a>'


def fetched(spark, content, url="https://a.com/d/"):
    return spark.createDataFrame([("c", url, content)], "channel string, url string, content string")


def test_feeds(spark):
    cutoff = F.lit("2023-01-01").cast("timestamp")
    rows = discovery.rss(fetched(spark, FEED), cutoff).orderBy("position").collect()
    assert [(r.source_url, r.title) for r in rows] == [("https://a.com/1", "One"), ("https://a.com/2", "Two")]
    assert rows[0].published_at == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert [r.source_url for r in discovery.rss(fetched(spark, ATOM)).collect()] == ["https://a.com/e"]
    assert [r.source_url for r in discovery.sitemap(fetched(spark, SITEMAP)).orderBy("position").collect()] == ["https://a.com/1", "https://a.com/2"]
    index = "<sitemapindex><sitemap><loc>https://a.com/s.xml</loc></sitemap></sitemapindex>"
    assert [r.location for r in discovery.nested_sitemaps(fetched(spark, index)).collect()] == ["https://a.com/s.xml"]
    with pytest.raises(ValueError):
        discovery.reader("odd")


def test_listing(spark):
    rows = discovery.listing(fetched(spark, LISTING)).orderBy("position").collect()
    assert [(r.source_url, r.title) for r in rows] == [("https://a.com/news/1", "A long enough title"), ("https://a.com/d/news/3?a=1", None)]
    assert [r.source_url for r in discovery.listing(fetched(spark, LISTING), prefixes=("/d/",)).collect()] == ["https://a.com/d/news/3?a=1"]
    assert discovery.listing(fetched(spark, LISTING), include=r"/\d+$", exclude="news").count() == 0
    assert discovery.listing(fetched(spark, LISTING), allowed_hosts=("other.com",)).count() == 3


BODY = "This paragraph is long enough to be taken as a part of the body of an article."


def page(head="", body=""):
    return f"<html><head><title>Page title</title>{head}</head><body><nav><p>{BODY}</p></nav>{body}</body></html>"


@pytest.fixture
def extract(spark):
    def run(html, url, year):
        return extract_articles(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string"), year).first().asDict()

    return run


def test_extract_dom(extract):
    r = extract(page(body=f"<article><h1>H</h1><p>{BODY}</p><p>short</p><p>{BODY} &amp; more</p></article>"), "https://a.com/2026-03-04/x", 2026)
    assert r["title"] == "Page title" and r["body"] == f"{BODY}\n\n{BODY} & more" and r["body_source"] == "dom"
    assert r["published_at"] == dt.datetime(2026, 3, 4) and not r["date_unknown"]
    assert extract("", "", 2026)["body"] == "" and extract("<p>عدد اليوم</p>", "", 2026)["body_source"] is None


def test_extract_payloads(extract):
    ld = '<script type="application/ld+json">{"@graph": [{"@type": ["NewsArticle"], "headline": "L", "articleBody": "%s", "datePublished": "2026-01-02T00:00:00Z", "image": [{"url": "/c.jpg"}]}]}</script>' % (BODY * 2)
    r = extract(page(ld, f"<article><p>{BODY}</p></article>"), "https://a.com/x", 2026)
    assert (r["title"], r["body"], r["body_source"], r["image_url"]) == ("L", BODY * 2, "json_ld", "https://a.com/c.jpg")
    nxt = '<script id="__NEXT_DATA__" type="x">{"props": {"pageProps": {"article": {"title": "N", "content": "<p>%s</p>", "date": "2026-01-05", "paidArticle": true}}}}</script>' % (BODY * 2)
    r = extract(page(ld + nxt), "https://a.com/x", 2026)
    assert (r["title"], r["body_source"], r["paid_article"], r["used_next_data"]) == ("N", "next_data", True, True)
    info = 'var article_info = {"article_title": "I", "article_body": "%s", "publish_time": "2026-07-01 21:35:00"};' % (BODY * 2)
    r = extract(page(f"<script>{info}</script>"), "https://a.com/x", 2026)
    assert (r["title"], r["body_source"], r["published_at"].hour) == ("I", "article_info", 18)


def test_extract_dates_and_images(extract):
    meta = '<meta property="og:image" content="https://i.com/o.png"><meta property="article:published_time" content="2024-01-01">'
    r = extract(page(meta, '<span id="x_lblDate">22/07/2026 09:28</span>'), "https://a.com/", 2026)
    assert r["published_at"] == dt.datetime(2026, 7, 22, 9, 28) and r["image_url"] == "https://i.com/o.png"
    r = extract(page(body='<font class="WriterLink">2026/07/20</font><font class="WriterLink">5:10 م</font>'), "", 2026)
    assert r["published_at"] == dt.datetime(2026, 7, 20, 17, 10)
    r = extract(page(body='<span id="lblGrogerianDate">01/02/2026</span>'), "", 2026)
    assert r["date_unknown"]


def test_extract_old_and_shown_dates(extract):
    meta = '<meta name="pubdate" content="2019-01-01T10:00:00+02:00">'
    assert extract(page(meta), "https://a.com/", 2026)["published_at"] is None
    assert extract(page(meta), "https://a.com/", 2020)["published_at"] == dt.datetime(2019, 1, 1, 8)
    r = extract(page(meta, "<p>99/99/2026 then 3.2.2026</p>"), "https://a.com/", 2026)
    assert r["published_at"] == dt.datetime(2026, 2, 3)
    r = extract(page('<script id="__NEXT_DATA__">{"props": 3}</script><script type="application/ld+json">{broken</script>', "<main>tiny</main>"), "u", 2026)
    assert r["body"] == "tiny" and r["body_source"] == "dom"
    box = f'<div class="Story-Body x"><p>{BODY}</p></div><div id="article1"><p>other {BODY}</p></div>'
    assert extract(page(body=box), "u", 2026)["body"] == BODY


def test_extract_frame(spark):
    pages = spark.createDataFrame([(1, "https://a.com/2026-03-04/x", page()), (2, None, None)], "page_id long, url string, html string")
    rows = extract_articles(pages, 2026).orderBy("page_id").collect()
    assert rows[0].published_at == dt.datetime(2026, 3, 4) and rows[1].body == ""


def test_breaker_stream(spark, tmp_path):
    base = 1_700_000_000
    rows = [("h", dt.datetime.fromtimestamp(base + i, dt.UTC), False) for i in range(7)] + [("h", dt.datetime.fromtimestamp(base + 400, dt.UTC), True), ("k", dt.datetime.fromtimestamp(base, dt.UTC), True)]
    spark.createDataFrame(rows, "host string, at timestamp, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("host string, at timestamp, ok boolean").parquet(str(tmp_path / "in"))
    q = streams.breaker(stream).writeStream.format("memory").queryName("breaker").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [r.allowed for r in spark.sql("select * from breaker where host = 'h' order by at").collect()]
    assert got == [True] * 5 + [False] * 2 + [True]


def test_upsert_and_dedupe_streams(spark, tmp_path):
    kind = "external_id string, posted_at timestamp, text string"
    at = dt.datetime(2024, 1, 1)
    for i, rows in enumerate(([("a", at, "1"), ("a", at, "1"), ("b", at, "1")], [("a", at + dt.timedelta(hours=1), "2")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        time.sleep(0.01)
    source = spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write = streams.upsert_to(str(tmp_path / "out"), ["external_id"], "posted_at")
    q = source.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = max(os.listdir(tmp_path / "out"))
    assert sorted((r.external_id, r.text) for r in spark.read.parquet(str(tmp_path / "out" / last)).collect()) == [("a", "2"), ("b", "1")]
    q = streams.dedupe(source).writeStream.format("memory").queryName("posts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from posts").count() == 2
