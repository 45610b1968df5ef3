"""Functions of a line or two, each by example."""

import datetime as dt

from pyspark.sql import functions as F

from tidewire.operators import desk, extraction, media
from tidewire.plans import jobs
from tidewire.sources import discovery
from tidewire.streaming import pipeline as streams

AT = dt.datetime(2024, 1, 1)


def test_sniffers(spark):
    rows = spark.createDataFrame([("application/rss+xml", ""), ("text/xml", "\n<RSS version"), ("text/html", "<html><feed"), ("text/html", "<html>"), ("", "<urlset x"), ("", "<?xml?><sitemapindex"), (None, "<rss")], "kind string, head string")
    got = rows.select(discovery.is_feed(F.coalesce("kind", F.lit("")), F.col("head")).alias("feed"), discovery.is_sitemap(F.col("head")).alias("map")).collect()
    assert [r.feed for r in got] == [True, True, True, False, False, False, True] and [r.map for r in got] == [False] * 4 + [True, True, False]


def test_timeline(spark):
    posts = spark.createDataFrame([(i, "Press" if i % 2 else "other", AT + dt.timedelta(hours=i % 7)) for i in range(60)], "post_id int, handle string, posted_at timestamp")
    assert discovery.timeline(posts, "PRESS", 1).count() == 5 and discovery.timeline(posts, "press", 1000).count() == 30
    assert [r.post_id for r in discovery.timeline(posts, "press", 5).collect()] == [13, 27, 41, 55, 5]


def test_backfills_and_invalidation(spark):
    articles = spark.createDataFrame([(1, None, "b1", "m"), (2, AT, "junk", "m"), (3, None, "b3", "m")], "article_id int, published_at timestamp, body string, metadata string")
    found = spark.createDataFrame([(1, AT, "i1"), (2, AT + dt.timedelta(1), "i2"), (3, None, None)], "article_id int, published_at timestamp, image_url string")
    have = spark.createDataFrame([(2,)], "article_id int")
    assert [(r.article_id, r.image_url) for r in jobs.backfill_images(articles, have, found).collect()] == [(1, "i1")]
    assert {r.article_id: r.published_at for r in jobs.backfill_dates(articles, found).collect()} == {1: AT, 2: AT, 3: None}
    gone = {r.article_id: (r.body, r.metadata) for r in extraction.invalidated(articles, F.col("body") == "junk").collect()}
    assert gone == {1: ("b1", "m"), 2: (None, None), 3: ("b3", "m")}


def test_cuttings_and_verified_logos(spark):
    rows = spark.createDataFrame([("proposed", True), ("proposed", False), ("included", True)], "status string, moved boolean")
    assert [r[0] for r in rows.select(media.decide_cutting(F.col("status"), F.when(F.col("moved"), 1))).collect()] == ["adjusted", "proposed", "included"]
    logos = spark.createDataFrame([(1, 0.97), (2, 0.54), (5, 0.6), (6, 0.9)], "rank int, confidence double")
    assert [(r["rank"], round(r.confidence, 2)) for r in media.verified(logos).collect()] == [(1, 0.99), (5, 0.65)]


def test_accounts(spark):
    rows = spark.createDataFrame([(1, "x", "b", True, True), (2, "x", "a", False, True), (3, "x", "c", True, False), (4, "y", "d", True, True)], "account_id int, platform string, handle string, is_approved boolean, is_active boolean")
    assert [r.handle for r in desk.accounts(rows).collect()] == ["a", "b", "c"] and [r.handle for r in desk.accounts(rows, approved_only=True).collect()] == ["b"]
    asked = spark.createDataFrame([(2, True, "u", AT), (1, True, None, AT), (1, False, "u", AT + dt.timedelta(1)), (9, True, "u", AT)], "account_id int, approved boolean, actor_id string, decided_at timestamp")
    after, audit, missing = desk.approve_accounts(rows, asked)
    assert [r.handle for r in desk.accounts(after, approved_only=True).collect()] == ["a"]
    assert sorted((r.resource_id, r.actor_type) for r in audit.collect()) == [("1", "system"), ("1", "user"), ("2", "user")] and [r.account_id for r in missing.collect()] == [9]
    assert audit.where("resource_id = '2'").first().details == '{"approved":true,"handle":"a"}'


def test_budget_and_freshness_of_streams(spark, tmp_path):
    rows = [("h", AT + dt.timedelta(seconds=4 * i)) for i in range(12)] + [("k", AT), ("h", None)]
    spark.createDataFrame(rows, "host string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("host string, at timestamp").parquet(str(tmp_path / "in"))
    dated, undated = streams.fresh(source, "at", "1 minute")
    for name, stream, mode in (("over", streams.over_budget(source), "complete"), ("dated", dated, "append"), ("undated", undated, "append")):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    over = spark.table("over").collect()
    assert {r.host for r in over} == {"h"} and max(r.n for r in over) == 12 and all(r.n > 10 for r in over)
    assert spark.table("dated").count() == 13 and spark.table("undated").count() == 1


def test_numbering_of_a_large_report(spark):
    from tidewire.operators.ranking import number_sections, reordered

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "small").when(F.col("id") % 1000 != 1, "large").alias("report_id"), F.col("id").alias("item_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("k"))
    sections = [rows.where("item_id % 2 = 0"), rows.where("item_id % 2 = 1")]
    got = number_sections(sections, ["k", "item_id"]).collect()
    for report in ("small", "large", None):
        mine = sorted((r for r in got if r.report_id == report), key=lambda r: r.sort_order)
        assert [r.sort_order for r in mine] == list(range(len(mine))) and mine
        order = [(r.item_id % 2, r.k is not None, r.k, r.item_id) for r in mine]
        assert order == sorted(order, key=lambda x: (x[0], x[1], x[2] or 0, x[3]))
    items = rows.select("item_id")
    turned = items.select("item_id", (2999 - F.col("item_id")).alias("position"))
    assert reordered(items, turned).count() == 3000
    for bad in (turned.where("item_id > 0"), turned.union(turned.limit(1)), turned.where("item_id > 0").union(spark.createDataFrame([(9999, 0)], "item_id long, position long"))):
        assert reordered(items, bad).count() == 0
