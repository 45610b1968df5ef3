"""Jobs composed of operators: ingest, semantic matching, source health, closure, editions, posts, dashboard."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as tx
from tidewire.functions.dates import iso
from tidewire.functions.urls import canonical_url
from tidewire.operators import gates, matching, media, merge, ranking, semantic, stats

# sources


def discovered(gate_ok: DataFrame, documents: DataFrame, readers: dict) -> tuple[DataFrame, DataFrame]:
    """(items, failures): fetched documents (channel, kind, url, content, error) through the reader of their kind.

    Channels must be in ``gate_ok``. A failed fetch is a row of failures and stops nothing else.
    """
    allowed = documents.join(gate_ok.select("channel"), "channel", "left_semi")
    good, out = allowed.where("error is null"), None
    for kind, read in readers.items():
        part = read(good.where(F.col("kind") == kind).select("channel", "url", "content"))
        part = part.select("channel", "source_url", "title", "published_at")
        out = part if out is None else out.unionByName(part)
    return out, allowed.where("error is not null").select("channel", "url", "error")


def article_candidates(items: DataFrame, channels: DataFrame) -> DataFrame:
    """Discovered items as rows to upsert: one for each publisher and canonical address, the first by address as found."""
    rows = items.join(channels.select("channel", "publisher", "language"), "channel")
    rows = rows.withColumn("canonical_url", canonical_url("source_url"))
    first = ranking.first_seen(rows, F.struct("publisher", "canonical_url"), [F.col("source_url"), F.col("channel")])
    return first.withColumns({"title_fingerprint": tx.title_fingerprint("title"), "content_hash": F.sha2("canonical_url", 256)})


def fetch_transition(articles: DataFrame, pages: DataFrame, cutoff: Column, limit: int) -> DataFrame:
    """What fetched and extracted pages do to articles that lack a body: new body, version and state.

    The newest ``limit`` are taken before stale ones are marked. A page's body takes the place of the
    old one only if ``should_replace``; then the version goes up by one.
    """
    lacking = articles.where("body is null or body = ''").orderBy(F.desc_nulls_last("published_at"), "article_id").limit(limit).select("article_id").withColumn("_asked", F.lit(True))
    p = pages.select("article_id", F.col("body").alias("_body"), F.col("published_at").alias("_at"), F.col("title").alias("_title"))
    joined = articles.join(lacking, "article_id", "left").join(p, "article_id", "left")
    at = F.coalesce("_at", "published_at")
    stale = F.coalesce(F.col("_asked") & (at < cutoff), F.lit(False))
    replace = F.coalesce(F.col("_asked"), F.lit(False)) & F.col("_body").isNotNull() & ~stale & tx.should_replace("_body", "body") & (F.col("_body") != "")
    return joined.select(
        "article_id",
        F.coalesce(F.when(F.col("_asked"), F.nullif("_title", F.lit(""))), "title").alias("title"),
        F.when(replace, F.col("_body")).otherwise(F.col("body")).alias("body"),
        F.when(F.col("_asked"), at).otherwise(F.col("published_at")).alias("published_at"),
        (F.col("version") + replace.cast("int")).alias("version"),
        F.when(stale, "stale").when(replace, "fetched").when(F.col("_asked"), "unchanged").otherwise("not_asked").alias("state"),
        F.when(replace, tx.content_hash(F.col("title"), F.col("_body"))).otherwise(F.col("content_hash")).alias("content_hash"),
    )


def backfill_images(articles: DataFrame, images: DataFrame, extracted: DataFrame) -> DataFrame:
    """Covers for articles that have none, where the page has one."""
    bare = articles.join(images.select("article_id"), "article_id", "left_anti")
    return bare.join(extracted.where("image_url is not null").select("article_id", "image_url"), "article_id").select("article_id", "image_url")


def backfill_dates(articles: DataFrame, extracted: DataFrame) -> DataFrame:
    found = extracted.select("article_id", F.col("published_at").alias("_at"))
    return articles.join(found, "article_id", "left").withColumn("published_at", F.coalesce("published_at", "_at")).drop("_at")


def api_article(responses: DataFrame) -> DataFrame:
    """(article_id, title, body, published_at, paid_article, body_source) from a site's JSON."""
    r = F.from_json("content", "data struct<result:struct<title:string,content:string,publishDate:string,date:string,paidArticle:boolean>>")["data"]["result"]
    body = tx.strip(F.regexp_replace(F.regexp_replace(F.coalesce(r["content"], F.lit("")), "<[^>]+>", "\n"), r"\s*\n\s*", "\n"))
    return responses.select(
        "article_id", F.nullif(F.trim(r["title"]), F.lit("")).alias("title"), body.alias("body"), iso(F.coalesce(r["publishDate"], r["date"])).alias("published_at"),
        F.coalesce(r["paidArticle"], F.lit(False)).alias("paid_article"), F.when(body != "", "site_api").alias("body_source"),
    )


def payload_items(documents: DataFrame, template: str) -> DataFrame:
    """Items of a page's data script that have an id and a slug, at any depth: (channel, url, source_url, title, position)."""
    import json
    import re

    def walk(x: object) -> Iterator[dict]:
        if isinstance(x, dict):
            if x.get("id") and x.get("slug"):
                yield x
            x = list(x.values())
        for y in x if isinstance(x, list) else ():
            yield from walk(y)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for channel, url, content in zip(frame["channel"], frame["url"], frame["content"], strict=True):
                m = re.search(r'<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', content or "", re.S)
                try:
                    found = walk(json.loads(m[1]) if m else {})
                    base = re.match(r"^[a-z]+://[^/]+", url)[0]
                    rows += [(channel, url, template.format(base=base, id=x["id"], slug=x["slug"]), x.get("title"), i) for i, x in enumerate(found)]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["channel", "url", "source_url", "title", "position"])

    return documents.select("channel", "url", "content").mapInPandas(run, "channel string, url string, source_url string, title string, position int")


def closure_rows(spark: SparkSession, text: str) -> DataFrame:
    """A closure matrix in YAML as rows: (publisher, channel, disposition, enabled)."""
    import yaml

    listed = yaml.safe_load(text).get("channels", [])
    for row in listed:
        if not row.get("publisher") or not row.get("channel"):
            raise ValueError("a row needs publisher and channel")
    return spark.createDataFrame([(r["publisher"], r["channel"], r.get("disposition"), bool(r.get("enabled"))) for r in listed], "publisher string, channel string, disposition string, enabled boolean")


def apply_closure(channels: DataFrame, matrix: DataFrame) -> DataFrame:
    """Channels with the matrix's disposition; those that it does not enable are disabled."""
    m = matrix.select("publisher", "channel", F.col("disposition").alias("_d"), F.col("enabled").alias("_e"))
    joined = channels.join(m, ["publisher", "channel"], "left")
    return joined.withColumns({"disposition": F.coalesce("_d", "disposition"), "enabled": F.when(F.col("_e").isNotNull(), F.col("enabled") & F.col("_e")).otherwise(F.col("enabled"))}).drop("_d", "_e")


def enablement(channels: DataFrame, overrides: DataFrame, skipped: DataFrame, include_broken: bool = True, scrapeable: tuple[str, ...] = ("rss", "sitemap", "html", "browser", "epaper")) -> DataFrame:
    """Channels with ``reason`` (enabled, or why not) and their connector type after overrides."""
    o = overrides.select("publisher", "channel", F.col("connector_type").alias("_type"))
    s = skipped.select("publisher", "channel").withColumn("_skip", F.lit(True))
    joined = gates.with_overrides(channels, o).join(s, ["publisher", "channel"], "left")
    kind = F.coalesce("_type", "connector_type")
    why = gates.enablement(kind.isNotNull(), F.coalesce("_skip", F.lit(False)), F.col("disposition"), F.coalesce(F.col("_type") == "epaper", F.lit(False)), include_broken, kind.isin(*scrapeable))
    return joined.withColumns({"reason": why, "connector_type": kind}).drop("_type", "_skip")


def source_health(channels: DataFrame, runs: DataFrame, failures: DataFrame) -> DataFrame:
    """Each channel with its latest run and how many of its five newest failures there are."""
    latest = ranking.latest_by(runs, ["channel"], F.col("at"), ["run_id", "status"]).withColumnsRenamed({"run_id": "last_run", "status": "last_status"})
    recent = stats.recent_failures(failures, "channel")
    return channels.join(latest, "channel", "left").join(recent, "channel", "left").withColumn("recent_failure_count", F.coalesce("recent_failure_count", F.lit(0).cast("long")))


def seed(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those of the seed that are not there yet."""
    return existing.unionByName(rows.join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)


# matching


def semantic_matching(entities: DataFrame, items: DataFrame, lexical: DataFrame, k: int = semantic.TOP_K, least: float = semantic.MIN_COSINE) -> DataFrame:
    """Candidates of entities (query_id, q, embedding) in items (item_id, t, embedding) with their decisions."""
    top = semantic.cosine_top_k(entities, items, k, least)
    texts = top.join(entities.select("query_id", "q"), "query_id").join(items.select("item_id", "t"), "item_id")
    return semantic.semantic_candidates(semantic.rerank(texts, "q", "t"), lexical)


def cuttings(pages: DataFrame, terms: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Proposals for pages (page_id, title, body, blocks): best match of each entity, and where it stands."""
    found = matching.match_documents(pages, terms, exclusions, id_col="page_id").where("not excluded")
    joined = found.join(pages.select("page_id", "blocks"), "page_id")
    return joined.withColumn("box", media.anchor_box(F.col("blocks"), F.get("evidence", F.lit(0))["matched"])).drop("blocks")


def social_matches(posts: DataFrame, terms: DataFrame, exclusions: DataFrame, newest: int = 500) -> DataFrame:
    """Matches in the newest posts, which have no title."""
    docs = media.newest_posts(posts, newest).select("post_id", F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))
    return matching.match_documents(docs, terms, exclusions, id_col="post_id").where("not excluded")


def propose(existing: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Cuttings, logos and posts: new ones are proposed, those still proposed are brought up to date."""
    return merge.merge_snapshot(existing, candidates, keys, F.col("e.status").isin("proposed", "adjusted"), {"status": F.coalesce("e.status", F.lit("proposed"))})


def mirrored(inbox: DataFrame, candidates: DataFrame) -> DataFrame:
    """The lexical inbox with semantic candidates (tenant, entity, article, lexical, similarity)."""
    new = candidates.select(
        "tenant", "entity", "article", semantic.inbox_type(F.col("lexical")).alias("match_type"), F.greatest(F.coalesce("lexical", F.lit(0.0)), "similarity").alias("score"), F.lit("pending_review").alias("status")
    )
    return merge.merge_snapshot(inbox, new, ["tenant", "entity", "article"], F.col("e.status") == "pending_review", {"match_type": F.coalesce(merge.mirror_type(F.col("e.match_type"), F.col("c.match_type")), "c.match_type")})


# reading


def dashboard(articles: DataFrame, images: DataFrame, asof: Column, lookback_days: int = 5, limit: int = 40) -> DataFrame:
    """The newest articles of the lookback with body, their first image and a snippet."""
    recent = articles.where(F.col("body").isNotNull() & (F.col("published_at") >= asof - F.make_dt_interval(F.lit(lookback_days))))
    first = images.groupBy("article_id").agg(F.min(F.struct("created_at", "image_url"))["image_url"].alias("image_url"))
    top = recent.orderBy(F.desc_nulls_last("published_at"), F.desc("discovered_at"), "article_id").limit(limit)
    return top.join(first, "article_id", "left").withColumn("snippet", tx.snippet("body"))


def edition_tree(editions: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Editions with their pages and these with their blocks, nested and in order."""
    b = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("blocks"))
    p = pages.join(b, "page_id", "left").groupBy("edition_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "blocks"))).alias("pages"))
    return editions.join(p, "edition_id", "left")


def listed(rows: DataFrame, tenant: object, status: str | None = None, order: str = "created_at") -> DataFrame:
    """A tenant's rows, of one status if given, newest first. Every read by tenant goes through here."""
    out = rows.where(F.col("tenant_id") == F.lit(tenant))
    out = out.where(F.col("status") == status) if status else out
    return out.orderBy(F.desc_nulls_last(order), "id")
