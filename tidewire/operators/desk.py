"""The desk's own tables: pipeline and inventory counts, assessments, logo templates, provider choice, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.gates import SOCIAL_FLAGS, social_missing
from tidewire.operators.merge import merge_snapshot

#: Points of an assessment, by what it recommends, by its status, and for being allowed by robots.txt.
CONNECTOR_POINTS = {"rss": 100, "sitemap": 70, "html": 40}
STATUS_POINTS = {"approved_for_rss": 10, "approved_for_html_fetch": 10, "blocked_by_paywall": -100, "disabled": -100, "temporarily_broken": -100}
ROBOTS_POINTS = 20
#: What a logo template may be.
IMAGE_TYPES, TRACK_ROLES, TEMPLATE_MAX = ("image/png", "image/jpeg", "image/webp"), ("own", "competitor", "other"), 2 << 20


def pipeline_counts(articles: DataFrame, embeddings: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: embedded, enriched (metadata has ai), semantic and pending; three counts side by side."""
    return (
        embeddings.agg(F.count("*").alias("embedded"))
        .join(articles.agg(F.count_if(F.coalesce(F.array_contains(F.json_object_keys("metadata"), "ai"), F.lit(False))).alias("enriched")))
        .join(candidates.agg(F.count("*").alias("semantic"), F.count_if(F.col("status") == "pending_review").alias("pending")))
    )


def not_enriched_by(articles: DataFrame, model: str) -> DataFrame:
    """Articles whose enrichment, if any, is by another model."""
    return articles.where(~F.get_json_object("metadata", "$.ai.model").eqNullSafe(F.lit(model)))


def of_publishers(rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, code: str = "publisher") -> DataFrame:
    """Rows of the publishers included (all, if none are named) and not excluded; a null code is in neither list."""
    out = rows.where(F.col(code).isin(include)) if include else rows
    return out.where(~F.coalesce(F.col(code).isin(exclude), F.lit(False))) if exclude else out


def with_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.where(F.startswith(F.col(column), F.lit(prefix)))


def inventory(publishers: DataFrame, channels: DataFrame, assessments: DataFrame) -> DataFrame:
    """One row: publishers, channels, those enabled, and assessments still pending."""
    return (
        publishers.agg(F.count("*").alias("publishers"))
        .join(channels.agg(F.count("*").alias("channels"), F.count_if("enabled").alias("enabled")))
        .join(assessments.agg(F.count_if(F.col("status") == "pending_assessment").alias("pending")))
    )


def edition_totals(editions: DataFrame) -> DataFrame:
    """One row: editions, those that can be searched, and their pages."""
    return editions.agg(F.count("*").alias("editions"), F.count_if(F.col("status") == "ocr_done").alias("searchable"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))


def newest_editions(editions: DataFrame, n: int = 12) -> DataFrame:
    return editions.orderBy(F.desc("edition_date"), "edition_id").limit(n)


def _points(value: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, points in table.items():
        out = F.when(value == name, points).otherwise(out)
    return out


def shortlist(assessments: DataFrame, n: int = 4) -> DataFrame:
    """The assessments with most points, ties by place; none without points."""
    robots = F.when(F.col("robots_allows_fetch") == "yes", ROBOTS_POINTS).otherwise(0)
    points = _points(F.col("recommended_connector"), CONNECTOR_POINTS) + robots + _points(F.col("status"), STATUS_POINTS)
    return assessments.withColumn("points", points).where("points > 0").orderBy(F.desc("points"), "position").limit(n)


def assessed(existing: DataFrame, probes: DataFrame) -> DataFrame:
    """Assessments after a run, one for each channel; the legal gate of a channel is what it was, and pending for a new one."""
    return merge_snapshot(existing, probes.drop("legal_gate"), ["channel"], F.lit(True), {"legal_gate": F.coalesce("e.legal_gate", F.lit("pending"))})


def assessment_document(assessments: DataFrame) -> DataFrame:
    """(channel, document): a YAML mapping of each channel's assessment, keys in order of the columns."""
    line = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6), F.lit("null")))
    return assessments.select("channel", F.concat_ws("\n", *[F.when(F.col(c).isNull(), F.lit(f"{c}: null")).otherwise(line(c)) for c in assessments.columns]).alias("document"))


def template_fault(content_type: Column, n_bytes: Column, role: Column) -> Column:
    """Why a logo template is refused; null if it is not."""
    sized = F.coalesce((n_bytes >= 1) & (n_bytes <= TEMPLATE_MAX), F.lit(False))
    known = lambda c, names: F.coalesce(c.isin(*names), F.lit(False))
    return F.when(~known(content_type, IMAGE_TYPES), "content_type").when(~sized, "size").when(~known(role, TRACK_ROLES), "track_role")


def new_templates(existing: DataFrame, offered: DataFrame) -> DataFrame:
    """Offered templates that are accepted and not there yet: of a tenant's equal images the first offered."""
    fine = offered.where(template_fault(F.col("content_type"), F.col("n_bytes"), F.col("track_role")).isNull())
    unseen = fine.join(existing.select("tenant_id", "content_hash"), ["tenant_id", "content_hash"], "left_anti")
    rest = [c for c in offered.columns if c not in ("tenant_id", "content_hash", "position")]
    first = unseen.groupBy("tenant_id", "content_hash").agg(F.min(F.struct("position", *rest)).alias("t"))
    return first.select("tenant_id", "content_hash", "t.*")


def scan_source(render: Column, pdf: Column, image: Column, address: Column) -> Column:
    """Which bytes a logo scan reads: a page's render, its edition's PDF, an article's image, or its address in their stead."""
    return F.when(render.isNotNull(), "page_render").when(pdf.isNotNull(), "edition_pdf").when(image.isNotNull(), "article_image").when(address.isNotNull(), "article_image_url_stub")


def social_gate_view(gates: DataFrame, env_live: Column, has_token: Column) -> DataFrame:
    """The gate of each platform with what is missing and whether live reading is allowed."""
    flags = {c: F.col(c) for c in ("credentials_available", *SOCIAL_FLAGS)}
    missing = social_missing(flags, has_token, env_live)
    return gates.withColumns({"missing": missing, "live_ready": F.size(missing) == 0, "scrape_forbidden": F.lit(True)})


def update_social_gate(gates: DataFrame, changes: DataFrame, has_token: Column) -> DataFrame:
    """Gates with the flags that changes (null: leave) set; ``refused`` where going live is asked for before all else is true."""
    names = ("credentials_available", *SOCIAL_FLAGS)
    c = changes.select("platform", *[F.col(n).alias(f"_{n}") for n in names])
    joined = gates.join(c, "platform", "left")
    after = {n: F.coalesce(f"_{n}", n) for n in names}
    ready = (after["credentials_available"] | has_token) & after["pricing_reviewed"] & after["endpoints_confirmed"] & after["terms_documented"] & after["cost_approved"]
    refused = F.coalesce(F.col("_live_enabled"), F.lit(False)) & ~ready
    values = {n: F.when(refused, F.col(n)).otherwise(after[n]).alias(n) for n in names}
    return joined.select(*[values.get(n, F.col(n)) for n in gates.columns], refused.alias("refused"))


def embedding_provider(wanted: Column, has_key: Column, local_fallback: Column) -> Column:
    """remote, local, or null where there is none."""
    return F.when((wanted != "local") & has_key, "remote").when(local_fallback | (wanted == "local"), "local")


def put_thresholds(existing: DataFrame, new: DataFrame) -> DataFrame:
    """A tenant's thresholds as last put."""
    return merge_snapshot(existing, new, ["tenant_id"], F.lit(True))


def decision_log(existing: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """A log row for each candidate that the upsert lets through: those whose match a person has decided log nothing."""
    settled = existing.where(F.col("status").isin("included", "excluded")).select(*keys)
    return candidates.join(settled, keys, "left_anti").select(*keys, "label", "confidence", F.lit("system").alias("actor_type"))


def accounts(rows: DataFrame, platform: str = "x", approved_only: bool = False) -> DataFrame:
    """A platform's accounts by handle; on demand only those approved and active."""
    mine = rows.where(F.col("platform") == platform)
    return (mine.where("is_approved and is_active") if approved_only else mine).orderBy("handle", "account_id")


def approve_accounts(rows: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accounts, audit rows, decisions on accounts that are not there) after decisions (account_id, approved, actor_id, decided_at).

    All decisions are audited, the last of an account holds; of decisions at one time that of the greater actor.
    """
    asked = F.struct("decided_at", "actor_id", "approved")
    last = decisions.groupBy("account_id").agg(F.max(asked).alias("d"))
    changed = rows.join(last, "account_id", "left").withColumn("is_approved", F.coalesce("d.approved", "is_approved")).select(*rows.columns)
    known = decisions.join(rows.select("account_id", "handle"), "account_id")
    details = F.to_json(F.struct("approved", "handle"))
    audit = known.select(
        F.lit("social.account_approval").alias("action"), F.lit("social_account").alias("resource_type"), F.col("account_id").cast("string").alias("resource_id"),
        "actor_id", F.when(F.col("actor_id").isNotNull(), "user").otherwise("system").alias("actor_type"), F.col("decided_at").alias("at"), details.alias("details"),
    )
    return changed, audit, decisions.join(rows, "account_id", "left_anti")
