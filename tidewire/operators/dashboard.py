"""The dashboard's whole payload as rows: (section, position, key, payload), a JSON object each.

One object for all would put every publisher into one row; a reader that wants one nests the rows of a section in the order of
``position``. Articles are read for their counts once, by publisher: the totals are sums of these. The sections that
list something are cut by an ordered limit, which each task applies to its own rows first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as tx
from tidewire.operators import desk, stats

#: The job whose last run is shown, how many editions are, and what an article without a title is called.
INGEST, EDITIONS, UNTITLED = "ingest", 12, "(untitled)"
COUNTS = ("total", "with_body", "with_date", "confirmed_in_lookback", "date_unknown_with_body")
WHOLE = {"ignoreNullFields": "false"}


def _at(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss").alias(column)


def _rows(df: DataFrame, section: str, position: Column | str, key: Column | str, *fields: Column | str) -> DataFrame:
    place = position.cast("int") if isinstance(position, Column) else F.col(position).cast("int")
    name = key.cast("string") if isinstance(key, Column) else F.col(key).cast("string")
    return df.select(F.lit(section).alias("section"), place.alias("position"), name.alias("key"), F.to_json(F.struct(*fields), WHOLE).alias("payload"))


def newest_articles(articles: DataFrame, images: DataFrame, publishers: DataFrame, since: Column, limit: int = 40) -> DataFrame:
    """The newest dated articles since a time that have a body, with their place, first image, publisher and enrichment.

    ``articles`` has article_id, story_cluster_id, title, url, published_at, discovered_at, language, body, publisher and ai (struct of summary,
    topics, sentiment, importance, model, or null).
    """
    order = [F.desc("published_at"), F.desc_nulls_last("discovered_at"), F.col("article_id")]
    top = articles.where(F.col("body").isNotNull() & (F.col("published_at") >= since)).join(F.broadcast(publishers.select("publisher").distinct()), "publisher", "left_semi").orderBy(*order).limit(limit)
    top = top.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)  # of ``limit`` rows
    few = top.select("article_id")
    cover = images.join(F.broadcast(few), "article_id", "left_semi").groupBy("article_id").agg(F.min(F.struct("created_at", "image_url"))["image_url"].alias("cover_image_url"))
    names = publishers.select("publisher", "name_en", "name_ar")
    return top.join(cover, "article_id", "left").join(names, "publisher")


def payload(
    articles: DataFrame, images: DataFrame, publishers: DataFrame, channels: DataFrame, editions: DataFrame, runs: DataFrame, embeddings: DataFrame, candidates: DataFrame,
    asof: Column, lookback_days: int = 5, limit: int = 40,
) -> DataFrame:
    """All sections: stats, articles, publishers, editions, ingestion (absent without a run) and ai_status.

    ``publishers`` (publisher, name_en, name_ar, homepage_url) is broadcast: it is the list of monitored houses, not of their output. Articles of
    none of them count in the totals and are not listed. ``runs`` has run_id, task, status, attempt_count, error, created_at, started_at,
    finished_at and result (struct), ``candidates`` status.
    """
    since = asof - F.make_dt_interval(F.lit(lookback_days))
    measures = [*stats.article_measures(asof, lookback_days), F.count("ai").alias("enriched")]
    by_publisher = articles.groupBy("publisher").agg(*measures)
    whole = by_publisher.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTS, "enriched")])
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS]

    first = F.lit(0)
    totals = _rows(whole, "stats", first, F.lit(""), *COUNTS)
    ai = [F.col(f"ai.{c}").alias(f"ai_{c}") for c in ("summary", "sentiment", "importance", "model")]
    topics = F.coalesce("ai.topics", F.array().cast("array<string>")).alias("ai_topics")
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)).alias("title")
    listed = _rows(
        newest_articles(articles, images, publishers, since, limit), "articles", "position", "article_id",
        F.col("article_id").cast("string").alias("id"), F.col("story_cluster_id").cast("string").alias("story_cluster_id"), title, "url", _at("published_at"), _at("discovered_at"), "language",
        (F.col("body") != "").alias("has_body"), tx.snippet("body").alias("snippet"), "cover_image_url", topics, *ai, "publisher", "name_en", "name_ar",
    )

    counted = stats.channels_per_publisher(publishers.withColumn("publisher_id", F.col("publisher")), channels.select(F.col("publisher").alias("publisher_id"), F.col("channel").alias("channel_id")))
    houses = publishers.join(counted, publishers["publisher"] == counted["publisher_id"]).drop("publisher_id").join(by_publisher, "publisher", "left")
    houses = _rows(
        houses.withColumn("position", F.row_number().over(Window.orderBy("publisher")) - 1), "publishers", "position", "publisher",
        F.col("publisher").alias("code"), "name_en", "name_ar", "homepage_url", F.col("n_channels").alias("channel_count"), F.struct(*zero).alias("article_stats"),
    )

    named = publishers.select("publisher", "name_en", "name_ar")
    newest = desk.newest_editions(editions.join(F.broadcast(named), "publisher"), EDITIONS)
    newest = newest.withColumn("position", F.row_number().over(Window.orderBy(F.desc("edition_date"), "edition_id")) - 1)  # of twelve rows
    papers = _rows(newest, "editions", "position", "edition_id", F.col("edition_id").cast("string").alias("id"), F.col("edition_date").cast("string").alias("edition_date"), "title", "status", "source_url", "page_count", "publisher", "name_en", "name_ar")

    fields = ("run_id", "status", "attempt_count", "error", "created_at", "started_at", "finished_at", "result")
    last = runs.where(F.col("task") == INGEST).agg(F.max(F.struct("created_at", *[c for c in fields if c != "created_at"])).alias("r")).where("r is not null").select("r.*")
    run = _rows(last, "ingestion", first, "run_id", F.col("run_id").cast("string").alias("id"), "status", "attempt_count", "error", _at("created_at"), _at("started_at"), _at("finished_at"), "result")

    state = (
        whole.select("enriched", "with_body")
        .join(embeddings.agg(F.count("*").alias("embedded")))  # three rows side by side
        .join(candidates.agg(F.count("*").alias("semantic_candidates"), F.count_if(F.col("status") == "pending_review").alias("pending_review")))
        .withColumn("index_coverage", stats.index_coverage(F.col("embedded"), F.col("with_body")))
    )
    status = _rows(state, "ai_status", first, F.lit(""), "enriched", "embedded", "semantic_candidates", "pending_review", "index_coverage")
    out = totals
    for part in (listed, houses, papers, run, status):
        out = out.unionByName(part)
    return out
