"""Semantic candidates: cosine top-k, overlap rerank, pruning, and the rule classifier."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.functions.text import normalize_text

#: Similarities that a task computes at once (32 MB, and about as much again to pick from them), however many queries a block has.
CELLS = 1 << 22
TOP_K, RERANK_K, MIN_COSINE, MIN_RERANK, MIN_CONFIDENCE = 20, 10, 0.45, 0.10, 0.6


def cosine_top_k(
    queries: DataFrame, items: DataFrame, k: int = TOP_K, least: float = MIN_COSINE, query_col: str = "query_id", item_col: str = "item_id", vector: str = "embedding", block_bytes: int = 32 << 20
) -> DataFrame:
    """(query, item, similarity, rank): for each query the k most similar items, ties by item; vectors of other lengths, null or with nulls have none.

    Queries are a stated set (monitored entities). They are dealt into blocks of at most about ``block_bytes``
    by their counted size, and one block after another is broadcast against all items; a task multiplies
    batches, some queries at a time (``CELLS``), and gives out what is among the k best of a query that it has seen so far.
    """
    spark = queries.sparkSession
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    q = queries.where(whole).select(query_col, F.transform(vector, lambda x: x.cast("double")).alias("_q"))
    i = items.where(whole).select(item_col, F.transform(vector, lambda x: x.cast("double")).alias("_i"))
    blocks = max(1, -(-(q.agg(F.sum(F.size("_q") * 8 + 64)).first()[0] or 0) // block_bytes))
    schema = T.StructType([q.schema[query_col], i.schema[item_col], T.StructField("similarity", T.DoubleType())])
    kind, out = to_arrow_type(q.schema[query_col].dataType), None
    for block in range(blocks):
        mine = q if blocks == 1 else q.where(F.pmod(F.xxhash64(query_col), F.lit(blocks)) == block)
        by_size: dict[int, tuple[list, list]] = {}
        for r in mine.collect():  # at most about block_bytes
            ids, rows = by_size.setdefault(len(r[1]), ([], []))
            ids.append(r[0])
            rows.append(r[1])
        shared = spark.sparkContext.broadcast({n: (ids, _unit(np.array(rows).reshape(len(ids), n))) for n, (ids, rows) in by_size.items()})

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            # the k greatest similarities of each query so far
            top = {n: np.full((k, len(ids)), -np.inf) for n, (ids, _) in shared.value.items()}
            for batch in batches:
                lists = batch.column(1)
                sizes = lists.value_lengths().to_numpy()
                for n, (ids, matrix) in shared.value.items():
                    rows = np.flatnonzero(sizes == n)
                    if not len(rows) or not n:
                        continue
                    mine, step = _unit(lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), n)), max(1, CELLS // len(rows))
                    for lo in range(0, len(ids), step):
                        part = slice(lo, lo + step)
                        found = mine @ matrix[part].T
                        found[np.isnan(found)] = -np.inf
                        best = np.partition(found, -k, axis=0)[-k:] if len(rows) > k else found
                        top[n][:, part] = np.partition(np.concatenate((top[n][:, part], best)), -k, axis=0)[-k:]
                        at, of = np.nonzero((found >= least) & (found >= top[n][0, part]))  # ties with the k-th stay
                        yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in (of + lo).tolist()], kind), batch.column(0).take(pa.array(rows[at])), pa.array(found[at, of])], names=schema.names)

        part = i.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy(query_col).orderBy(F.col("similarity").desc(), item_col)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    length = np.sqrt((rows * rows).sum(1))
    return rows / np.where(length == 0, 1.0, length)[:, None]


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has; both normalised."""
    q, t = F.array_distinct(F.split(normalize_text(query), " ")), F.split(normalize_text(text), " ")
    return F.when(normalize_text(query) == "", 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def rerank(candidates: DataFrame, query: str, text: str, query_col: str = "query_id", item_col: str = "item_id", k: int = RERANK_K) -> DataFrame:
    """Adds ``rerank``: the overlap of the k best candidates of each query, null for the others."""
    scored = candidates.withColumn("_o", overlap(F.col(query), F.col(text)))
    order = Window.partitionBy(query_col).orderBy(F.col("_o").desc(), "rank", item_col)
    return scored.withColumn("_r", F.row_number().over(order)).withColumn("rerank", F.when(F.col("_r") <= k, F.col("_o"))).drop("_o", "_r")


def pruned(similarity: Column, rerank: Column, min_rerank: float = MIN_RERANK, min_cosine: float = MIN_COSINE) -> Column:
    return rerank.isNotNull() & (rerank < min_rerank) & (similarity < min_cosine + 0.15)


def relevance(similarity: Column, rerank: Column, lexical: Column, min_confidence: Column | float = MIN_CONFIDENCE) -> Column:
    """struct(label, confidence, score) by ordered rules."""
    bar = F.lit(min_confidence) if isinstance(min_confidence, float) else min_confidence
    lex = F.coalesce(lexical, F.lit(0.0))
    score = 0.35 * similarity + 0.25 * F.coalesce(rerank, F.lit(0.0)) + 0.40 * F.least(lex, F.lit(1.0))
    strong = (lex >= 0.96) & (similarity >= 0.4)
    fair = (score >= F.greatest(bar, F.lit(0.75))) & (lex >= 0.5)
    weak = (score < 0.35) & (lex < 0.2)
    label = F.when(strong | fair, "relevant").when(weak, "not_relevant").otherwise("needs_review")
    confidence = F.when(strong, F.least(F.lit(0.99), 0.85 + 0.1 * lex)).when(weak, 1 - score).otherwise(score)
    return F.struct(label.alias("label"), confidence.alias("confidence"), score.alias("score"))


def stale_embeddings(items: DataFrame, cache: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Items whose text has no embedding with its hash in the cache (of one provider and model)."""
    return items.join(cache.select(id_col, "content_hash"), [id_col, "content_hash"], "left_anti")


def thresholds(tenants: DataFrame, own: DataFrame) -> DataFrame:
    """Each tenant's thresholds, with the defaults where it has none."""
    d = {"min_cosine": MIN_COSINE, "min_rerank": MIN_RERANK, "min_confidence": MIN_CONFIDENCE}
    joined = tenants.join(own, "tenant_id", "left")
    return joined.select("tenant_id", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in d.items()])


def semantic_candidates(candidates: DataFrame, lexical: DataFrame, query_col: str = "query_id", item_col: str = "item_id") -> DataFrame:
    """Reranked candidates after pruning, with lexical scores (``lexical``, excluded pairs drop) and the rule's decision."""
    joined = candidates.where(~pruned(F.col("similarity"), F.col("rerank"))).join(lexical, [query_col, item_col], "left").where(~F.coalesce("excluded", F.lit(False)))
    return joined.withColumn("decision", relevance(F.col("similarity"), F.col("rerank"), F.col("lexical"))).where(F.col("decision.label") != "not_relevant")


def inbox_type(lexical: Column) -> Column:
    """How a semantic candidate shows in the lexical inbox."""
    return F.when(F.coalesce(lexical, F.lit(0.0)) < 0.9, "semantic_assisted").otherwise("semantic_with_lexical")
