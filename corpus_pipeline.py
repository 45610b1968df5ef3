"""A training-data pipeline: quality, near duplicates, contamination, mixing, shards.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import new_folder, text_key
from tidewire.llm.decontaminate import find_contamination
from tidewire.llm.jaccard_join import jaccard_groups, with_nodes
from tidewire.llm.kneser_ney import classify
from tidewire.llm.mixing import mix
from tidewire.llm.sharding import shard

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of 0.8 or more join: that with the least id.

    Documents without words link to nothing and stay; rows that repeat both id and words count as one.
    """
    key = F.concat_ws(":", F.hex("node"), F.col("doc_id").cast("string"))
    groups = jaccard_groups(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("s")
    stays = groups.where("node is not null").groupBy("class_node").agg(least).select("s.doc_id", "s.node")
    stays = stays.unionByName(groups.where("node is null").select("doc_id", "node"))
    keyed = with_nodes(docs, COLUMNS).withColumn("_key", key)
    kept = keyed.join(stays.select(key.alias("_key")).distinct(), "_key", "left_semi")
    # of rows with one key the first; tasks pick theirs before the shuffle, as very many may have it
    first = F.min(F.struct("text", "lang", "source", "n_chars", "doc_id")).alias("row")
    return kept.groupBy("_key").agg(first).select("row.*").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages cover a twentieth of the words or more."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.where("not contaminated").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; half a repetition or more counts as one.

    Documents are told apart by id, text and source, so those without an id, or with a shared one, are each taken by
    their own lot. Rows that repeat all three share what the mix takes of them evenly.
    """
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_key(F.col("text")).cast("string"))
    named = docs.select(*COLUMNS).withColumn("_name", name)
    times = F.col("copies") + (F.col("part_words") * 2 > F.col("size")).cast("long")
    taken = mix(named, id_col="_name").groupBy("_name", "source").agg(F.sum(times).alias("_times"), F.count("*").alias("_rows")).where("_times > 0")
    taken = taken.withColumnsRenamed({"_name": "_of", "source": "_from"})
    joined = named.join(taken, (F.col("_name") == F.col("_of")) & F.col("source").eqNullSafe(F.col("_from")))
    place = F.row_number().over(Window.partitionBy("_name", "source").orderBy("lang", "n_chars"))
    mine = F.floor(F.col("_times") / F.col("_rows")) + (place <= F.col("_times") % F.col("_rows")).cast("long")
    return joined.withColumn("_mine", mine).where("_mine > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_mine")))).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stores what is left in shards, and returns it as read back, with each row's shard."""
    return shard(docs, new_folder(spark, "shards"), grace_seconds=0)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: The classifier and the joins' samples are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows after all stages, each stage written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
