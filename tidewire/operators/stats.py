"""Aggregates: article statistics, coverage, discovery and matching totals, insights, confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def article_measures(asof: Column, lookback_days: int, body: str = "body", published: str = "published_at") -> list[Column]:
    """The five counts, of one pass."""
    with_body = F.coalesce(F.col(body) != "", F.lit(False))
    dated = F.col(published).isNotNull()
    recent = F.coalesce(F.col(published) >= asof - F.make_dt_interval(F.lit(lookback_days)), F.lit(False))
    return [
        F.count("*").alias("total"),
        F.count_if(with_body).alias("with_body"),
        F.count_if(dated).alias("with_date"),
        F.count_if(with_body & recent).alias("confirmed_in_lookback"),
        F.count_if(with_body & ~dated).alias("date_unknown_with_body"),
    ]


def article_stats(articles: DataFrame, asof: Column, lookback_days: int = 5, by: str | None = None) -> DataFrame:
    measures = article_measures(asof, lookback_days)
    return (articles.groupBy(by) if by else articles).agg(*measures)


def channels_per_publisher(publishers: DataFrame, channels: DataFrame) -> DataFrame:
    """Publishers without channels count 0."""
    return publishers.join(channels.select("publisher_id", "channel_id"), "publisher_id", "left").groupBy("publisher_id").agg(F.count("channel_id").alias("n_channels"))


def index_coverage(embedded: Column, with_body: Column) -> Column:
    return F.least(F.lit(1.0), F.bround(embedded / F.greatest(with_body, F.lit(1)), 3))


def next_version(versions: DataFrame, parent: str) -> DataFrame:
    return versions.groupBy(parent).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def discovery_totals(runs: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    return runs.agg(F.count_if(ok).alias("channels_ok"), F.count_if(~ok).alias("channels_failed"), *[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in ("discovered", "created")])


def matching_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.countDistinct("doc_id").alias("documents"), F.count_if(~F.col("excluded")).alias("matches"), F.count_if("excluded").alias("excluded"))


def recent_failures(failures: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Failures per key, counted up to ``most``."""
    return failures.groupBy(key).agg(F.least(F.lit(most), F.count("*")).cast("long").alias("recent_failure_count"))


def tone_shares(articles: DataFrame) -> DataFrame:
    """(tone, n, percent, dominant): percent half up; the dominant tone is the most frequent, then the first by name."""
    counted = articles.where(F.coalesce(F.col("summary"), F.lit("")) != "").groupBy(F.coalesce("sentiment", F.lit("neutral")).alias("tone")).agg(F.count("*").alias("n"))
    totals = counted.agg(F.sum("n").alias("_all"), F.min(F.struct(-F.col("n"), "tone"))["tone"].alias("_top"))
    joined = counted.join(F.broadcast(totals))  # one row
    return joined.select("tone", "n", F.floor(F.col("n") * 100 / F.col("_all") + 0.5).cast("long").alias("percent"), (F.col("tone") == F.col("_top")).alias("dominant"))


def top_topics(articles: DataFrame, k: int = 5) -> DataFrame:
    each = articles.select(F.explode("topics").alias("topic"))
    return each.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(k)


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    return rows.agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn")
    )
