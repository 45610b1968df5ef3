"""Structured Streaming forms: deduplicated ingest, windows, budgets, and a breaker per host."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedupe(stream: DataFrame, id_col: str = "external_id", at: str = "posted_at", delay: str = "5 days") -> DataFrame:
    """One row an id within the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([id_col])


def fresh(stream: DataFrame, at: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """(dated rows under a watermark, undated rows): rows without a date are never late."""
    return stream.where(F.col(at).isNotNull()).withWatermark(at, delay), stream.where(F.col(at).isNull())


def windowed_counts(stream: DataFrame, at: str, keys: list[str | Column], width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    window = F.window(at, width, slide) if slide else F.window(at, width)
    counted = stream.withWatermark(at, delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select("w.start", "w.end", *[c for c in counted.columns if c not in ("w", "n")], "n")


def over_budget(requests: DataFrame, per_minute: int = 10) -> DataFrame:
    """Hosts and minutes (sliding by 10 seconds) with more requests than the budget."""
    return windowed_counts(requests, "at", ["host"], "60 seconds", "10 seconds", "1 minute").where(F.col("n") > per_minute)


def breaker(outcomes: DataFrame, failures: int = 5, open_seconds: int = 300) -> DataFrame:
    """(host, at, allowed, failures): a host's requests are refused for a while after failures in a row.

    Stateful: outcomes (host, at, ok) of each host in order of time within a batch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row, until = state.get if state.exists else (0, 0.0)
        events = pd.concat(list(frames)).sort_values("at")
        out = []
        for at, ok in zip(events["at"], events["ok"], strict=True):
            now = at.timestamp()
            allowed = now >= until
            if allowed:
                row = 0 if ok else row + 1
                if row >= failures:
                    until = now + open_seconds
            out.append((key[0], at, allowed, row))
        state.update((row, until))
        yield pd.DataFrame(out, columns=["host", "at", "allowed", "failures"])

    return outcomes.groupBy("host").applyInPandasWithState(
        step, "host string, at timestamp, allowed boolean, failures int", "failures int, until double", "append", GroupStateTimeout.NoTimeout
    )


def upsert_to(path: str, keys: list[str], order: str):
    """A foreachBatch function that keeps the latest row of each key in numbered snapshots below ``path``.

    A batch that is delivered again writes the same snapshot, so the sink is idempotent.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch:
            rows = rows.unionByName(spark.read.parquet(f"{path}/snapshot={epoch - 1}"))
        latest = rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in batch.columns if c not in (*keys, order)])).alias("r"))
        latest.select(*keys, "r.*").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/snapshot={epoch}")

    return write
