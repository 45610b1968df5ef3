"""Runs that go on where they stopped: a ledger of stages done, by publisher and input.

A stage is a function of rows with a ``publisher`` column. It runs once over all publishers that have not yet been through it with
the rows that they now have; if that fails, each publisher runs alone, so that one's failure stays its own and the others go on.
What a publisher's stage gave is kept in a folder that the ledger names, so a later run, of all or of one publisher, reads it instead of
working again. The ledger grows by numbered folders; of a publisher's entries for one stage and input the last counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.sources import numbered

ENTRY = "run string, stage string, publisher string, input_digest string, status string, folder string, rows long, error string"
SUCCEEDED, FAILED = "succeeded", "failed"


@dataclass(frozen=True)
class Stage:
    name: str
    work: Callable[[DataFrame], DataFrame]


@dataclass
class Outcome:
    """What a run did: rows of its last stage, its entries, and how many publishers each stage worked on."""

    rows: DataFrame
    entries: DataFrame
    worked: dict[str, int] = field(default_factory=dict)


class RunLedger:
    """Opens or begins the ledger in ``root``, a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def entries(self) -> DataFrame:
        """All entries with ``no``, the number of the step that made them."""
        steps = numbered.numbers(self.spark, self.root, "step")
        out = self.spark.createDataFrame([], f"{ENTRY}, no long")
        if steps:
            found = self.spark.read.schema(ENTRY).parquet(*[f"{self.root}/{numbered.name_of(n, 'step')}" for n in steps])
            out = found.withColumn("no", F.regexp_extract(F.col("_metadata.file_path"), r"/step=(\d+)/", 1).cast("long"))
        return out

    def add(self, entries: list[tuple]) -> None:
        written = numbered.aside(self.root)
        self.spark.createDataFrame(entries, ENTRY).coalesce(1).write.parquet(written)
        while not numbered.commit(self.spark, written, self.root, "step", max(numbered.numbers(self.spark, self.root, "step"), default=0) + 1):
            continue

    def standing(self, stage: str, digests: DataFrame) -> DataFrame:
        """(publisher, input_digest) with the status and folder of its last entry for the stage; null if there is none."""
        last = F.max(F.struct("no", "status", "folder")).alias("e")
        known = self.entries().where(F.col("stage") == stage).groupBy("publisher", "input_digest").agg(last).select("publisher", "input_digest", "e.status", "e.folder")
        return digests.join(known, ["publisher", "input_digest"], "left")


def input_digests(rows: DataFrame) -> DataFrame:
    """(publisher, input_digest) of what each publisher's rows hold, in whatever order; rows without a publisher are no one's."""
    whole = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).cast("decimal(38,0)")
    again = F.xxhash64(F.lit(1), *[F.col(c) for c in sorted(rows.columns)]).cast("decimal(38,0)")
    sums = rows.where(F.col("publisher").isNotNull()).groupBy("publisher").agg(F.count("*").alias("n"), F.sum(whole).alias("a"), F.sum(again).alias("b"))
    return sums.select(F.col("publisher").cast("string").alias("publisher"), F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("input_digest"))


def _of(publishers: list[str]) -> Column:
    return F.col("publisher").cast("string").isin(publishers)


def run_stage(ledger: RunLedger, run: str, stage: Stage, rows: DataFrame) -> tuple[DataFrame | None, int]:
    """(what the stage gives for all publishers that came through it, how many it worked on). Publishers are a list of sources, a few
    thousand at most: their digests and folders pass through the driver, their rows do not."""
    spark = ledger.spark
    standing = [tuple(r) for r in ledger.standing(stage.name, input_digests(rows)).select("publisher", "input_digest", "status", "folder").collect()]
    digest = {p: d for p, d, _, _ in standing}
    folders = {p: f for p, _, status, f in standing if status == SUCCEEDED}
    pending = sorted(p for p in digest if p not in folders)

    def attempt(publishers: list[str]) -> list[tuple]:
        folder = f"{ledger.root}/output/{stage.name}-{uuid.uuid4().hex}"
        done = stage.work(rows.where(_of(publishers)))
        done.write.partitionBy("publisher").parquet(folder)
        made = {str(r[0]): r[1] for r in spark.read.schema(done.schema).parquet(folder).groupBy("publisher").count().collect()}
        return [(run, stage.name, p, digest[p], SUCCEEDED, folder, made.get(p, 0), None) for p in publishers]

    entries: list[tuple] = []
    if pending:
        try:
            entries = attempt(pending)
        except (PySparkException, ValueError, KeyError):
            for p in pending:
                try:
                    entries += attempt([p])
                except (PySparkException, ValueError, KeyError) as e:
                    entries.append((run, stage.name, p, digest[p], FAILED, None, None, str(e).partition("\n")[0][:500]))
        ledger.add(entries)
    folders |= {e[2]: e[5] for e in entries if e[4] == SUCCEEDED}
    if not folders:
        return None, len(pending)
    schema = stage.work(rows.limit(0)).schema
    out, by_folder = None, {}
    for p, folder in folders.items():
        by_folder.setdefault(folder, []).append(p)
    for folder, publishers in sorted(by_folder.items()):
        part = spark.read.schema(schema).parquet(folder).where(_of(publishers))
        out = part if out is None else out.unionByName(part)
    return out, len(pending)


def run_all(ledger: RunLedger, run: str, stages: list[Stage], rows: DataFrame, publishers: list[str] | None = None) -> Outcome:
    """Runs the stages one after another, each on what the one before gives; of some publishers only, if named (recovery)."""
    now: DataFrame | None = rows if publishers is None else rows.where(_of(publishers))
    worked = {}
    for stage in stages:
        if now is None:
            break
        now, worked[stage.name] = run_stage(ledger, run, stage, now)
    end = now if now is not None else rows.limit(0)
    return Outcome(end, ledger.entries().where(F.col("run") == run), worked)


def totals(entries: DataFrame) -> DataFrame:
    """(stage, succeeded, failed, rows) of a run's entries."""
    count = lambda status: F.count(F.when(F.col("status") == status, 1)).alias(status)
    return entries.groupBy("stage").agg(count(SUCCEEDED), count(FAILED), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
