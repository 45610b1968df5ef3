"""The connector source against the plain readers, with its filters, and as a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_sources import ATOM, FEED, LISTING, SITEMAP
from tidewire.sources import connector, discovery

COLUMNS = ["channel", "url", "position", "source_url", "title", "published_at"]
DOCS = [
    ("rss", "a/b", "https://a.com/f", FEED), ("rss", "a/b", "https://a.com/g", FEED.replace("/2<", "/9<")), ("rss", "c=1", "https://c.com/f", ATOM), ("rss", "c=1", "https://c.com/bad", "<rss><broken"),
    ("rss", "empty", None, None), ("sitemap", "a/b", "https://a.com/s", SITEMAP), ("sitemap", "a/b", "https://a.com/t", SITEMAP), ("html", "a/b", "https://a.com/d/", LISTING), ("html", "w", "https://www.a.com/d/x", LISTING),
]


@pytest.fixture
def stored(spark, tmp_path):
    connector.register(spark)
    documents = spark.createDataFrame(DOCS, "connector string, channel string, url string, content string")
    assert connector.store_documents(documents, str(tmp_path / "sets")) == 1
    return documents, str(tmp_path / "sets")


def read(spark, root, kind, **options):
    return spark.read.format(connector.FORMAT).options(connector=kind, **options).load(root)


def rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_rows_are_those_of_the_plain_readers(spark, stored):
    documents, root = stored
    cutoff = F.lit("2023-01-01").cast("timestamp")
    of = lambda kind: documents.where(F.col("connector") == kind)
    assert rows(read(spark, root, "rss")) == rows(discovery.rss(of("rss"))) and read(spark, root, "rss").count() == 5
    assert rows(read(spark, root, "rss", cutoff="2023-01-01", most="2")) == rows(discovery.rss(of("rss"), cutoff, 2))
    assert rows(read(spark, root, "sitemap")) == rows(discovery.sitemap(of("sitemap")))
    assert rows(read(spark, root, "sitemap", most="3")) == rows(discovery.sitemap(of("sitemap"), most=3))
    assert rows(read(spark, root, "html")) == rows(discovery.listing(of("html")))
    options = {"allowed_hosts": ("other.com",), "prefixes": ("/d/", "/2"), "include": r"\d", "exclude": "zzz"}
    found = read(spark, root, "html", **{k: ",".join(v) if isinstance(v, tuple) else v for k, v in options.items()})
    assert rows(found) == rows(discovery.listing(of("html"), **options)) and found.count() == 4
    with pytest.raises(Exception, match="unknown connector type"):
        read(spark, root, "odd").collect()


def test_pages(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    documents = pages.select(F.lit("html").alias("connector"), F.pmod("page_id", F.lit(3)).cast("string").alias("channel"), "url", F.col("html").cast("string").alias("content"))
    connector.register(spark)
    connector.store_documents(documents, str(tmp_path / "sets"))
    plain = rows(discovery.listing(documents, most=10_000))
    assert plain and rows(read(spark, str(tmp_path / "sets"), "html", most="10000")) == plain


def test_filters_are_taken_over(spark, stored):
    documents, root = stored
    connector.store_documents(documents.where("channel = 'c=1'"), root)
    one = read(spark, root, "rss").where("channel = 'c=1' and arrival = 2")
    assert [r.source_url for r in one.collect()] == ["https://a.com/e"] and one.rdd.getNumPartitions() == 1
    recent = read(spark, root, "rss").where("published_at >= '2024-01-02 03:04:05' and published_at < '2024-01-03'")
    assert [r.source_url for r in recent.collect()] == ["https://a.com/1"]
    kept = recent._jdf.queryExecution().executedPlan().toString()
    assert "2024" not in kept.partition("BatchScan")[0]  # no filter on days above the scan
    assert read(spark, root, "rss").where("channel in ('a/b', 'empty')").count() == 4 and read(spark, root, "rss").where("channel = 'none'").count() == 0
    assert read(spark, root, "rss").where("published_at is null").count() == 2


def test_rules_of_bounds():
    at = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    rules = connector.Rules("rss", bounds=[(">", at), ("<=", at + dt.timedelta(days=1))])
    assert [rules.meets(at + dt.timedelta(hours=h)) for h in (0, 1, 24, 25)] == [False, True, True, False] and not rules.meets(None)


def test_stream_goes_on_where_it_stopped(spark, stored, tmp_path):
    documents, root = stored

    def run():
        stream = spark.readStream.format(connector.FORMAT).option("connector", "rss").load(root)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        return rows(spark.read.schema(connector.ITEM).parquet(str(tmp_path / "out")))

    first = run()
    assert first == rows(read(spark, root, "rss")) and len(first) == 5
    assert run() == first
    more = spark.createDataFrame([("rss", "d", "https://d.com/f", FEED)], documents.schema)
    assert connector.store_documents(more, root) == 2
    second = run()
    assert len(second) == 8 and second == rows(read(spark, root, "rss"))


def test_small_sets_share_a_task(spark, tmp_path):
    """Starting a task costs more than to read a small set."""
    connector.register(spark)
    documents = spark.createDataFrame([("rss", f"c{i}", f"https://c{i}.com/f", FEED) for i in range(150)], "connector string, channel string, url string, content string")
    connector.store_documents(documents, str(tmp_path / "sets"))
    found = read(spark, str(tmp_path / "sets"), "rss")
    assert found.rdd.getNumPartitions() == 3 and rows(found) == rows(discovery.rss(documents))
    assert found.where("channel = 'c7'").rdd.getNumPartitions() == 1
