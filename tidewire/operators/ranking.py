"""Latest, best and first of groups, percentile picks, numbering, ordered limits, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import checkpointed


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int = 1, name: str = "rank") -> DataFrame:
    """The first k rows of each group; ``order`` must break ties. Partitions keep k rows a group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def latest_by(df: DataFrame, group: list[str], order: Column, columns: list[str]) -> DataFrame:
    """One row a group, with partial aggregation instead of a sort."""
    best = df.groupBy(*group).agg(F.max(F.struct(order.alias("_o"), *columns)).alias("_b"))
    return best.select(*group, *[F.col(f"_b.{c}").alias(c) for c in columns])


def first_seen(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Order-preserving distinct: of each key the first row."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def percentile_pick(df: DataFrame, group: str, value: str, share: float = 0.72) -> DataFrame:
    """(group, threshold): of n values in ascending order the one at index max(0, floor(share * n) - 1).

    Equal values are counted first. What is left is dealt by ranges of (group, value), which come from a sample and so follow the values
    however they lie; counts by range tell which range holds a group's pick, and only that one is ordered.
    """
    each = df.select(F.col(group).alias("_g"), F.col(value).alias("_v")).where("_v is not null").groupBy("_g", "_v").agg(F.count("*").alias("_c"))
    # written once, as another sample would cut the ranges elsewhere
    ranged = checkpointed(each.repartitionByRange("_g", "_v").withColumn("_range", F.spark_partition_id()), "percentiles")
    counts = ranged.groupBy("_g", "_range").agg(F.sum("_c").alias("_n"))
    of = Window.partitionBy("_g")  # one row a range
    placed = counts.withColumns({"_upto": F.sum("_n").over(of.orderBy("_range")), "_all": F.sum("_n").over(of)})
    pick = F.greatest(F.lit(0), F.floor(F.col("_all") * share) - 1) + 1
    chosen = placed.where((F.col("_upto") >= pick) & (F.col("_upto") - F.col("_n") < pick)).select(F.col("_g").alias("_h"), F.col("_range").alias("_r"), (pick - (F.col("_upto") - F.col("_n"))).alias("_k"))
    inside = ranged.join(chosen, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_range") == F.col("_r")))
    upto = inside.withColumn("_upto", F.sum("_c").over(of.orderBy("_v")))
    return upto.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k"))).select(F.col("_g").alias(group), F.col("_v").alias("threshold"))


def number_sections(sections: list[DataFrame], order: list[str]) -> DataFrame:
    """Sections one after another, with ``section`` and 0-based ``sort_order`` over all of a parent's items.

    Numbered in two steps: rows are dealt by ranges of (report_id, section, order), counted by report and range, and numbered
    inside their range after what lies before it; so a report with a third of all items is numbered by many tasks.
    """
    out = None
    for i, s in enumerate(sections):
        s = s.withColumn("section", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    # written once, as the ranges come from a sample and must be the same for counts and numbers
    ranged = checkpointed(out.repartitionByRange("report_id", "section", *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("report_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("report_id", "_range").agg(F.count("*").alias("_n"))
    starts = counts.select(F.col("report_id").alias("_report"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ranged.join(starts, F.col("report_id").eqNullSafe(F.col("_report")) & (F.col("_range") == F.col("_of")))
    inside = Window.partitionBy("report_id", "_range").orderBy("section", *order)
    return placed.withColumn("sort_order", (F.col("_before") + F.row_number().over(inside) - 1).cast("int")).drop("_range", "_report", "_of", "_before")


def number_versions(new: DataFrame, existing: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """Numbers new versions of each parent after those that exist."""
    top = existing.groupBy(parent).agg(F.max("version").alias("_top"))
    joined = new.join(top, parent, "left")
    return joined.withColumn("version", F.coalesce("_top", F.lit(0)) + F.row_number().over(Window.partitionBy(parent).orderBy(*order))).drop("_top")


def limited_then_filtered(df: DataFrame, order: list[Column], first: int, keep: Column, then: int) -> DataFrame:
    """The best ``first`` rows, of those the ones that ``keep``, of those ``then``: the limit comes before the filter."""
    return df.orderBy(*order).limit(first).where(keep).orderBy(*order).limit(then)


def reordered(items: DataFrame, order: DataFrame) -> DataFrame:
    """Items with positions from (item_id, position); empty unless it is a permutation of them.

    It is one if every item is asked for, once, and nothing else is; counted by id, so no list of all ids is made.
    """
    have = items.select("item_id", F.lit(1).alias("_have")).distinct()
    asked = order.groupBy("item_id").agg(F.count("*").alias("_times"))
    wrong = F.col("_have").isNull() | F.col("_times").isNull() | (F.col("_times") > 1)
    valid = have.join(asked, "item_id", "full_outer").agg(F.count(F.when(wrong, 1)).alias("_wrong")).where("_wrong = 0")
    return items.join(order, "item_id").join(F.broadcast(valid)).drop("_wrong")


def story_clusters(articles: DataFrame, title_hash: Column, id_col: str, title: str) -> DataFrame:
    """(fingerprint, representative title, size, first id): equal titles are one story."""
    return articles.groupBy(title_hash.alias("fingerprint")).agg(F.min(F.struct(F.col(id_col).alias("i"), F.col(title).alias("t"))).alias("m"), F.count("*").alias("size")).select(
        "fingerprint", F.substring("m.t", 1, 512).alias("representative"), "size", F.col("m.i").alias("first_id")
    )


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): missing from the right, and extra on the right."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))
