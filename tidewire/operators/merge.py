"""Upserts as new snapshots: existing rows full-outer-joined with candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Review states that a re-run may overwrite.
OPEN_STATES = ("pending_review", "proposed")


def merge_snapshot(existing: DataFrame, candidates: DataFrame, keys: list[str], overwrite: Column, set_new: dict[str, Column] | None = None) -> DataFrame:
    """Rows of both: new keys are inserted, existing rows take the candidate's values where ``overwrite``
    (a condition on e.* columns) holds, all else stays. ``action`` says insert, update or keep."""
    e, c = existing.alias("e"), candidates.alias("c")
    joined = e.withColumn("_e", F.lit(True)).alias("e").join(c.withColumn("_c", F.lit(True)).alias("c"), [F.col(f"e.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "full_outer")
    new = F.col("_e").isNull()
    take = new | (F.col("_c").isNotNull() & F.coalesce(overwrite, F.lit(False)))
    values = []
    for name in existing.columns:
        if name in keys:
            values.append(F.coalesce(f"e.{name}", f"c.{name}").alias(name))
        elif set_new and name in set_new:
            values.append(F.when(take, set_new[name]).otherwise(F.col(f"e.{name}")).alias(name))
        elif name in candidates.columns:
            values.append(F.when(take, F.col(f"c.{name}")).otherwise(F.col(f"e.{name}")).alias(name))
        else:
            values.append(F.col(f"e.{name}").alias(name))
    return joined.select(*values, F.when(new, "insert").when(take, "update").otherwise("keep").alias("action"))


def upsert_matches(existing: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Matches are inserted or overwritten and go back to review; what a person decided stays."""
    return merge_snapshot(existing, candidates, keys, F.col("e.status").isin(*OPEN_STATES), {"status": F.lit("pending_review")})


def upsert_articles(existing: DataFrame, found: DataFrame) -> DataFrame:
    """By (publisher, canonical_url): the title is the new one if there is one, the hash is overwritten, metadata maps are merged."""
    title = F.coalesce("c.title", "e.title")
    meta = F.map_concat(F.map_filter(F.coalesce("e.metadata", F.create_map()), lambda k, v: ~F.map_contains_key(F.coalesce("c.metadata", F.create_map().cast("map<string,string>")), k)), F.coalesce("c.metadata", F.create_map().cast("map<string,string>")))
    return merge_snapshot(existing, found, ["publisher", "canonical_url"], F.lit(True), {"title": title, "metadata": meta})


def decide(rows: DataFrame, decisions: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """Applies (key, new_status, reviewer, decided_at) where the status is allowed; the latest decision wins."""
    last = decisions.where(F.col("new_status").isin(*allowed)).groupBy(key).agg(F.max(F.struct("decided_at", "new_status", "reviewer")).alias("d"))
    joined = rows.join(last, key, "left")
    return joined.select(
        *[F.coalesce("d.new_status", "status").alias("status") if c == "status" else F.col(c) for c in rows.columns], F.col("d.reviewer").alias("reviewer"), F.col("d.decided_at").alias("reviewed_at")
    )


def mirror_type(old: Column, new: Column) -> Column:
    """A semantic match never takes the place of a lexical type."""
    return F.when(old.isin("exact", "case_insensitive_en", "arabic_normalized", "alias"), old).otherwise(new)


def audit(events: DataFrame) -> DataFrame:
    """Audit rows: the actor is a user if there is an actor id, else the system."""
    return events.withColumn("actor_type", F.when(F.col("actor_id").isNotNull(), "user").otherwise("system"))
