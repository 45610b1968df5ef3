"""Rules over sources and jobs: ordered cases on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reason(*cases: tuple[Column, str], otherwise: str = "ok") -> Column:
    """The name of the first case that holds."""
    out = None
    for when, name in cases:
        out = F.when(when, name) if out is None else out.when(when, name)
    return out.otherwise(otherwise)


def recommendation(status: Column, paywall: Column, robots_ok: Column, has_rss: Column, has_sitemap: Column, has_html: Column) -> Column:
    return reason((status >= 500, "pending"), (paywall, "blocked"), (~robots_ok, "blocked"), (has_rss, "rss"), (has_sitemap, "sitemap"), (has_html, "html"), otherwise="pending")


def ingestion_gate(legal_gate: Column, enabled: Column, connector_type: Column) -> Column:
    """Why a channel may not be ingested, else ok. A null legal gate: there is no assessment."""
    return reason(
        (legal_gate.isNull(), "missing_assessment"),
        (legal_gate != "approved", "legal_gate_pending"),
        (~F.coalesce(enabled, F.lit(False)), "connector_disabled"),
        (connector_type.isin("pending", "blocked"), "connector_not_configured"),
    )


def epaper_gate(legal_gate: Column, enabled: Column, connector_type: Column) -> Column:
    base = ingestion_gate(legal_gate, enabled, connector_type)
    return F.when((base == "ok") & (connector_type != "epaper"), "connector_not_epaper").otherwise(base)


#: What a live social feed needs, in the order in which it is reported.
SOCIAL_FLAGS = ("pricing_reviewed", "endpoints_confirmed", "terms_documented", "cost_approved", "live_enabled")


def social_missing(gate: dict[str, Column], has_token: Column, env_live: Column) -> Column:
    """The flags that are missing; empty when live reading is allowed."""
    no = lambda c, name: F.when(~F.coalesce(c, F.lit(False)), name)
    items = [no(gate["credentials_available"] | has_token, "credentials"), *[no(gate[f], f) for f in SOCIAL_FLAGS]]
    return F.array_compact(F.array(*items, no(env_live, "X_API_LIVE_ENABLED"), no(has_token, "X_API_BEARER_TOKEN")))


def enablement(has_rows: Column, skipped: Column, disposition: Column, epaper_override: Column, include_broken: bool, scrapeable: Column) -> Column:
    kind = F.coalesce(disposition, F.lit("active"))
    return reason(
        (~has_rows, "missing_assessment_or_connector"),
        (skipped, "explicitly_skipped"),
        ((kind == "awaiting_licensing") & ~epaper_override, "awaiting_licensing"),
        (kind == "blocked", "blocked"),
        ((kind == "temporarily_broken") & F.lit(not include_broken), "temporarily_broken_excluded"),
        (~scrapeable, "connector_not_scrapeable"),
        otherwise="enabled",
    )


def with_overrides(channels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Channels with their keyed configuration, where there is one (few rows; Spark broadcasts them by size)."""
    return channels.join(overrides, ["publisher", "channel"], "left")


def micros_between(since: Column, until: Column) -> Column:
    """Microseconds from one time to another; whole seconds would call a job a second older than it is."""
    return F.unix_micros(until.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))


def job_interrupted(status: Column, state: Column, started: Column, created: Column, task_id: Column, asof: Column, pending_min: int = 5, legacy_min: int = 15, hard_min: int = 40) -> Column:
    """Whether a job that claims to run has been lost."""
    age = micros_between(F.coalesce(started, created), asof) / 60_000_000
    lost = (
        F.coalesce(state.isin("FAILURE", "REVOKED"), F.lit(False))
        | (age >= hard_min)
        | (F.coalesce(state == "PENDING", F.lit(False)) & started.isNotNull() & (age >= pending_min))
        | (task_id.isNull() & (age >= legacy_min))
    )
    return status.isin("queued", "running") & lost


def refresh_suppressed(status: Column, finished: Column, asof: Column, minutes: int = 15) -> Column:
    """Whether a new ingest request does nothing: one runs, or one succeeded just now."""
    return status.isin("queued", "running") | ((status == "succeeded") & (micros_between(finished, asof) < minutes * 60_000_000))


#: The types a monitored entity may have.
ENTITY_TYPES = ("brand", "company", "competitor", "product", "executive", "campaign", "industry_topic", "project", "government_entity")


def valid_entity(entity_type: Column, name_en: Column, name_ar: Column) -> Column:
    named = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return entity_type.isin(*ENTITY_TYPES) & (named(name_en) | named(name_ar))


def closure_summary(rows: DataFrame) -> DataFrame:
    """closed, open, enabled, and whether all are closed."""
    closed = F.col("disposition").isNotNull()
    return rows.agg(F.count_if(closed).alias("closed"), F.count_if(~closed).alias("open"), F.count_if(F.col("enabled")).alias("enabled"), F.coalesce(F.bool_and(closed), F.lit(True)).alias("complete"))


def disposition_histogram(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """(disposition, n) for every known kind, also those with none, and 'unset'."""
    named = rows.select(F.coalesce("disposition", F.lit("unset")).alias("disposition"))
    return kinds.join(named.groupBy("disposition").agg(F.count("*").alias("n")), "disposition", "left").select("disposition", F.coalesce("n", F.lit(0)).alias("n"))
