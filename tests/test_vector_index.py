"""The cell index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import vector_index as vi
from tidewire.operators.semantic import cosine_top_k

VECTOR = "array<double>"


def rows(df):
    return sorted((r.query_id, r.item_id, round(r.similarity, 9), r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    data = centres[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    data[:400] = data[0]  # a large group of equal vectors
    made = [(i, v.tolist()) for i, v in enumerate(data)] + [(5000, None), (5001, [1.0, None]), (5002, [1.0, 2.0]), (5003, [0.0] * 16)]
    return spark.createDataFrame(made, f"item_id long, embedding {VECTOR}")


def test_all_cells_are_exact(spark, items):
    queries = items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    exact = rows(cosine_top_k(queries.where(F.size("embedding") == 16), items.where(F.size("embedding") == 16)))
    centroids = vi.fit(items, 20)
    assert centroids.matrix.shape == (20, 16)
    for cell_rows in (20_000, 50):
        assert rows(vi.indexed_top_k(queries, items, centroids, 20, cell_rows=cell_rows)) == exact


def test_recall_with_few_probes(spark, items):
    queries = items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    found = vi.indexed_top_k(queries, items, vi.fit(items, 20), 5)
    assert vi.recall(found, cosine_top_k(queries, items)) >= 0.9
    # each row is in one cell
    cells = vi.assigned(items, vi.fit(items, 20), "item_id", "embedding")
    assert cells.count() == cells.select("id").distinct().count() == 1501 and cells.select("cell").distinct().count() > 10


def test_embeddings_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")
    queries = e.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    found = vi.indexed_top_k(queries, e, vi.fit(e, 32), 16)
    assert vi.recall(found, cosine_top_k(queries, e)) >= 0.9


def test_query(spark):
    from tidewire import catalog

    root = "/root/testdata/sf0.01"
    assert vi.recall(catalog.QUERIES["indexed_top_k"](spark, root), catalog.QUERIES["cosine_top_k"](spark, root)) >= 0.9


def test_empty(spark, items):
    none = items.limit(0)
    assert vi.indexed_top_k(none.withColumnRenamed("item_id", "query_id"), items, vi.fit(items, 4), 2).collect() == []
    assert vi.indexed_top_k(items.withColumnRenamed("item_id", "query_id"), none, vi.fit(none, 4), 2).collect() == []
