"""Logos, printed editions and social posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.vectors import fingerprint_similarity

SCREEN, SIMILAR, LOGO_TOP = 0.35, 0.55, 20


def logo_cascade(templates: DataFrame, images: DataFrame, top: int = LOGO_TOP) -> DataFrame:
    """Candidates of templates (template_id, fingerprint, min_confidence) in images (image_id, fingerprint, n_bytes).

    Templates are a tenant's short list; every image is screened against all of them, which is
    the operator's definition, and Spark sends the list by size.
    """
    t = templates.select("template_id", F.col("fingerprint").alias("_t"), "min_confidence")
    pairs = images.where("n_bytes >= 32").join(t, F.length("_t") == F.length("fingerprint"))
    pairs = pairs.withColumn("similarity", fingerprint_similarity("fingerprint", "_t")).where(F.col("similarity") >= SCREEN)
    confidence = F.least(F.lit(0.99), 0.40 + 0.60 * F.col("similarity"))
    digest = F.sha2(F.concat_ws(":", "template_id", "fingerprint"), 256)
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / 255 * 0.7
    pairs = pairs.withColumn("confidence", confidence)
    stage = F.when(F.col("confidence") < F.col("min_confidence"), "local_screen_below_threshold").when(F.col("similarity") >= SIMILAR, "embedding_similarity").otherwise("local_screen")
    best = Window.partitionBy("image_id").orderBy(F.desc("confidence"), "template_id")
    out = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return out.select(
        "image_id", "template_id", "similarity", "confidence", stage.alias("stage"), F.bround(byte(0), 4).alias("bbox_x"), F.bround(byte(1), 4).alias("bbox_y"), F.lit(0.12).alias("bbox_w"), F.lit(0.08).alias("bbox_h"), "rank",
        template_score(F.col("confidence"), F.col("similarity"), F.col("min_confidence")).alias("score"),
    )


def template_score(confidence: Column, similarity: Column, least: Column) -> Column:
    raw = 0.6 * confidence + 0.4 * similarity
    return F.least(F.lit(0.99), F.greatest(F.lit(0.0), F.when(confidence < least, raw * 0.85).otherwise(raw)))


def verified(candidates: DataFrame, top: int = 5, least: float = 0.55) -> DataFrame:
    """The external check's stand-in: the best few, a little surer."""
    return candidates.where((F.col("rank") <= top) & (F.col("confidence") >= least)).withColumn("confidence", F.least(F.lit(0.99), F.col("confidence") + 0.05))


def text_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, text, bbox_y, bbox_h): a block for each line with text of a page's text layer."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda t: F.trim(t)), lambda t: t != "")
    each = pages.select("page_id", F.size(lines).alias("_n"), F.posexplode(lines).alias("block_no", "text"))
    return each.select("page_id", "block_no", "text", F.least(F.lit(0.95), F.col("block_no") / F.col("_n")).alias("bbox_y"), F.greatest(F.lit(0.02), 0.9 / F.col("_n")).alias("bbox_h"))


def weak_text_layer(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < 40


def page_text(layer: Column, remote: Column, stub: Column) -> Column:
    """struct(text, provider): the text layer unless weak, then remote recognition, then the stub."""
    strong = ~weak_text_layer(layer)
    return F.when(strong, F.struct(layer.alias("text"), F.lit("text_layer").alias("provider"))).when(remote.isNotNull(), F.struct(remote.alias("text"), F.lit("remote").alias("provider"))).otherwise(
        F.struct(stub.alias("text"), F.lit("local_stub").alias("provider"))
    )


def anchor_box(blocks: Column, term: Column) -> Column:
    """The box of the first block with the term, else of the first block, else the default box."""
    has = F.filter(blocks, lambda b: F.contains(F.lower(b["text"]), F.lower(term)))
    box = lambda b: F.struct(*[b[c].cast("double").alias(c) for c in ("x", "y", "w", "h")])
    default = F.struct(F.lit(0.05).alias("x"), F.lit(0.05).alias("y"), F.lit(0.9).alias("w"), F.lit(0.2).alias("h"))
    return F.when(F.size(has) > 0, box(F.get(has, 0))).when(F.size(blocks) > 0, box(F.get(blocks, 0))).otherwise(default)


def edition_changed(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Editions to ingest: no edition of that channel and date has the same content and finished recognition."""
    done = existing.where("ocr_done").select("channel", "edition_date", "sha256")
    return new.join(done, ["channel", "edition_date", "sha256"], "left_anti")


def decide_cutting(status: Column, new_box: Column) -> Column:
    return F.when(new_box.isNotNull() & (status == "proposed"), "adjusted").otherwise(status)


def newest_posts(posts: DataFrame, n: int = 500) -> DataFrame:
    return posts.orderBy(F.desc_nulls_last("posted_at"), F.desc("post_id")).limit(n)


def dedupe_posts(posts: DataFrame) -> DataFrame:
    """One row for each external id, the first by time."""
    first = Window.partitionBy("platform", "external_id").orderBy("posted_at", "post_id")
    return posts.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
