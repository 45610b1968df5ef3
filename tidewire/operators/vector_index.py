"""Nearest vectors by a partitioned index: cells around centroids, every row in one, exact ranking inside the cells that a query visits.

Centroids are fitted on a bounded sample; all rows are then assigned in one pass and shuffled once, to their cells. A cell with
more rows than ``CELL_ROWS`` is dealt to several tasks, and queries go to each of them, so equal vectors by the million are no
hot key. What an index misses is only what lies in cells that a query does not visit: more ``probes`` find more, and all
cells find everything.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.semantic import MIN_COSINE, TOP_K, _unit

#: Rows that centroids are fitted on, at most; those with the least hashes of their ids.
SAMPLE_ROWS = 50_000
#: Rows of a cell that one task holds, about.
CELL_ROWS = 20_000


@dataclass(frozen=True)
class Centroids:
    """Unit vectors, one a row; of one length."""

    matrix: np.ndarray

    def nearest(self, vectors: np.ndarray, many: int) -> np.ndarray:
        """The numbers of the ``many`` nearest centroids of each row, in no order."""
        many = min(many, len(self.matrix))
        return np.argpartition(-(_unit(vectors) @ self.matrix.T), many - 1, axis=1)[:, :many]


def fit(items: DataFrame, cells: int, item_col: str = "item_id", vector: str = "embedding", rounds: int = 8, sample_rows: int = SAMPLE_ROWS) -> Centroids:
    """Spherical k-means on at most ``sample_rows`` rows; a cell that runs empty takes the row that fits its own worst."""
    rows = _whole(items, vector).select(F.xxhash64(item_col).alias("h"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    sample = rows.orderBy("h", "v").limit(sample_rows).toArrow()  # a bounded sample
    if not sample.num_rows:
        return Centroids(np.zeros((1, 1)))
    sizes = np.array([len(v) for v in sample.column("v")])
    n = int(np.bincount(sizes).argmax())
    data = _unit(np.array([v.as_py() for v, size in zip(sample.column("v"), sizes, strict=True) if size == n]))
    centres = data[np.linspace(0, len(data) - 1, min(cells, len(data))).astype(int)].copy()
    for _ in range(rounds):
        near = data @ centres.T
        cell = near.argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, data)
        worst = iter(np.argsort(near[np.arange(len(data)), cell]).tolist())
        for empty in np.flatnonzero(np.bincount(cell, minlength=len(centres)) == 0):
            total[empty] = data[next(worst)]
        centres = _unit(total)
    return Centroids(centres)


def _whole(rows: DataFrame, vector: str) -> DataFrame:
    return rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))


def assigned(rows: DataFrame, centroids: Centroids, id_col: str, vector: str, many: int = 1) -> DataFrame:
    """(id, v, cell): each row in its ``many`` nearest cells. Vectors of another length than the centroids are in none."""
    shared, n = rows.sparkSession.sparkContext.broadcast(centroids), centroids.matrix.shape[1]
    picked = _whole(rows, vector).where(F.size(vector) == n).select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    schema = T.StructType([picked.schema["id"], picked.schema["v"], T.StructField("cell", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = shared.value.nearest(batch.column(1).flatten().to_numpy().reshape(-1, n), many)
                row = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(cells.ravel(), pa.int32())], names=["id", "v", "cell"])

    return picked.mapInArrow(run, schema)


def indexed_top_k(
    queries: DataFrame,
    items: DataFrame,
    centroids: Centroids,
    probes: int,
    k: int = TOP_K,
    least: float = MIN_COSINE,
    query_col: str = "query_id",
    item_col: str = "item_id",
    vector: str = "embedding",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(query, item, similarity, rank) as ``semantic.cosine_top_k`` gives them, of the items in the ``probes`` nearest cells of each query."""
    held, asked = assigned(items, centroids, item_col, vector), assigned(queries, centroids, query_col, vector, probes)
    sizes = held.groupBy("cell").count().select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts"))
    # a row for each cell: no more than there are centroids
    held = held.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    asked = asked.join(F.broadcast(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    asked = asked.withColumnsRenamed({"cell": "c", "part": "p"})
    schema = T.StructType([T.StructField(query_col, queries.schema[query_col].dataType), T.StructField(item_col, items.schema[item_col].dataType), T.StructField("similarity", T.DoubleType())])

    def best(own: pa.Table, theirs: pa.Table) -> pa.Table:
        empty = pa.table([theirs.column("id").slice(0, 0), own.column("id").slice(0, 0), pa.array([], pa.float64())], names=schema.names)
        if not own.num_rows or not theirs.num_rows:
            return empty
        matrix = lambda t: _unit(t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1))
        base, out = matrix(own), []
        for lo in range(0, theirs.num_rows, 1024):
            part = theirs.slice(lo, 1024)
            near = matrix(part) @ base.T
            if near.shape[1] > k:  # ties with the k-th stay
                near[near < np.partition(near, -k, axis=1)[:, -k, None]] = -2
            q, i = np.nonzero(near >= least)
            out.append(pa.table([part.column("id").take(pa.array(q)), own.column("id").take(pa.array(i)), pa.array(near[q, i])], names=schema.names))
        return pa.concat_tables(out)

    found = held.groupBy("cell", "part").cogroup(asked.groupBy("c", "p")).applyInArrow(best, schema)
    order = Window.partitionBy(query_col).orderBy(F.col("similarity").desc(), item_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, query_col: str = "query_id", item_col: str = "item_id") -> float:
    """The share of the exact answers that are among those found; 1 if there are none."""
    both = exact.join(found.select(query_col, item_col, F.lit(1).alias("_hit")), [query_col, item_col], "left")
    total, hits = both.agg(F.count("*"), F.count("_hit")).first()
    return hits / total if total else 1.0
