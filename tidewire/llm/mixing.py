"""Mixing sources to target weights, in DataFrame functions only.

Capped water-filling: every source wants words in proportion to its weight, and
stops at ``max_epochs`` times its size; what is cut off goes to the others by
weight until none is above. The level at which this settles is found in one pass
over the sources, ordered by the level at which each stops. Documents are taken
whole times, and a seeded order of each source's documents decides which of them
give one repetition more; the document at the brink gives part of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, quoted

#: A document's words: runs of anything but space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: Column, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (source_size, weight) rows, one a source.

    ``total`` is what the targets add up to, if the caps allow it. The sources are a small
    dimension (a row each), so ordering them in one task is fine.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_level = Window.orderBy("_level", "_cap", "_weight")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    out = sources.withColumn("_cap", cap).withColumn("_weight", F.col("weight").cast("double"))
    out = out.withColumn("_level", F.col("_cap") / F.col("_weight")).withColumn("_total", total)
    # the level if this source and all that stop later are below their caps
    open_level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("_open", open_level)
    out = out.withColumn("_fill", F.max(F.when(F.col("_open") <= F.col("_level"), F.col("_open"))).over(whole))
    target = F.when(F.col("_fill").isNull() | (F.col("_level") < F.col("_fill")), F.col("_cap")).otherwise(F.col("_fill") * F.col("_weight"))
    return out.withColumn("target", target).drop("_cap", "_weight", "_level", "_total", "_open", "_fill")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    bucket_digits: int = 3,
) -> DataFrame:
    """One row for each document: its id and source, ``size``, ``source_size``, ``target``, ``copies``
    (whole repetitions), ``part_words`` (words of one repetition more) and ``taken``.

    Sources in code point order, null last, get the weights in turn; together they get
    ``share`` of all words. Null texts have size 0 and are taken 0 times beyond the whole
    repetitions of their source. Rows that are equal in id, source and size are
    interchangeable, so reruns agree as multisets. The seeded order is that of a hash's hex
    digits; the first ``bucket_digits`` of them deal each source into 16 ** digits runs, so
    that a source with a third of all rows is ordered by many tasks.
    """
    sized = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(source_col)).alias("_source"), word_count(F.col(quoted(text_col))).alias("size"))
    name = F.concat_ws(":", F.lit(str(seed)), F.col("_id").cast("string"), F.col("size").cast("string"))
    sized = sized.withColumn("_order", F.md5(name.cast("binary")))
    sized = materialize(sized.withColumn("_bucket", F.substr("_order", F.lit(1), F.lit(bucket_digits))), "sizes")
    by_bucket = sized.groupBy("_source", "_bucket").agg(F.sum("size").alias("_here"))
    by_source = by_bucket.groupBy("_source").agg(F.sum("_here").alias("source_size"))
    turn = Window.orderBy(F.col("_source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn("weight", F.get(listed, F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights)))))
    targets = water_fill(ranked, F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)), max_epochs)
    whole = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    targets = targets.withColumn("_whole", whole.cast("long"))
    extra = F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long")
    targets = targets.withColumn("_extra", extra)
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.withColumn("_start", F.coalesce(F.sum("_here").over(ahead), F.lit(0))).drop("_here")
    starts = starts.withColumnsRenamed({"_source": "_s", "_bucket": "_b"})
    dealt = sized.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    dealt = dealt.join(targets.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    more = F.least(F.greatest(F.col("_extra") - F.col("_before"), F.lit(0)), F.col("size"))
    full = (more == F.col("size")) & (F.col("size") > 0)
    return dealt.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("_whole") + full.cast("long")).alias("copies"),
        F.when(full, F.lit(0)).otherwise(more).cast("long").alias("part_words"),
        (F.col("_whole") * F.col("size") + more).alias("taken"),
    )
