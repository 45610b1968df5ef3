"""Sessions and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidewire", **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC, AQE); others stay the cluster's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir, which all executors share; a temporary one only in local mode where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = by_hand.get() if by_hand.isDefined() else None
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tidewire-')}"
        spark.sparkContext.setCheckpointDir(shared)
        shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """df written to a table in the shared folder and read back, which cuts its lineage."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
