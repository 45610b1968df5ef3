"""Vectors: cosine, hash embeddings, image fingerprints."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.text import col


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length; 1 for a zero vector."""
    length = F.sqrt(dot(a, a))
    return F.when(length == 0, 1.0).otherwise(length)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null if the lengths differ."""
    a, b = col(a), col(b)
    return F.when(F.size(a) == F.size(b), dot(a, b) / (norm(a) * norm(b)))


def l2_normalize(a: Column | str) -> Column:
    a = col(a)
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def blend(vector: Column, rerank: Column) -> Column:
    return F.when(rerank.isNull(), vector).otherwise(0.55 * vector + 0.45 * rerank)


def hash_slots(df: DataFrame, id_col: str, text_col: str, dim: int = 1024) -> DataFrame:
    """(id, slot, value): sparse hash embeddings. A word's slot is the number in the first four bytes of its
    SHA-256 modulo ``dim``, its sign comes from the fifth; a text without words has the word 'empty'."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = F.when(F.size(words) == 0, F.array(F.lit("empty"))).otherwise(words)
    digest = F.sha2("word", 256)
    slot = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    each = df.select(id_col, F.explode(words).alias("word")).select(id_col, slot.alias("slot"), sign.alias("v"))
    return each.groupBy(id_col, "slot").agg(F.sum("v").alias("value")).where("value != 0")


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = 1024) -> DataFrame:
    """(id, embedding): hash embeddings of unit length."""
    slots = hash_slots(df, id_col, text_col, dim)
    packed = slots.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("len"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("len"))
    every = df.select(id_col).distinct().join(packed, id_col, "left")
    return every.select(id_col, F.coalesce(dense, F.array_repeat(F.lit(0.0), dim)).alias("embedding"))


@F.pandas_udf(T.StringType())
def image_fingerprint(images: pd.Series) -> pd.Series:
    """SHA-256 of about 64 bytes spread over the image, and of its length."""

    def one(data: bytes | None) -> str:
        if not data:
            return hashlib.sha256(b"empty").hexdigest()
        spread = bytes(data)[:: max(1, len(data) // 64)]
        return hashlib.sha256(spread + len(data).to_bytes(8, "big")).hexdigest()

    return images.map(one)


def fingerprint_similarity(a: Column | str, b: Column | str) -> Column:
    """The share of places at which two fingerprints agree; 0 if lengths differ or are zero."""
    a, b = F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit(""))
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e))
    return F.when((F.length(a) != F.length(b)) | (F.length(a) == 0), 0.0).otherwise(same / F.length(a))
