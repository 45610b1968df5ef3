"""Tables that are upserted: versions of buckets, of which a run rewrites only those that it touches.

A version is a numbered folder with a manifest, which names for each table the folder of each bucket, and a log of the rows that
the version changed. A run reads the buckets of its candidates' keys, writes them anew aside, and commits by renaming the version
into place; several tables change in one commit. Buckets that no candidate falls into keep their folders, so what is written
grows with the changes. A run that dies leaves the version before it as it was; one that another overtakes starts over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.media import edition_changed
from tidewire.sources import numbered

ACTION = "action"
KEEP = "keep"


@dataclass(frozen=True)
class Change:
    """What a run does to a table: ``combine(existing, candidates)`` gives the rows of the touched buckets. They lie in the buckets of the
    columns ``by``, which both have. An ``action`` column of the result says what happened to a row; all but "keep" is logged."""

    table: str
    by: tuple[str, ...]
    candidates: DataFrame
    combine: Callable[[DataFrame, DataFrame], DataFrame]


class SnapshotStore:
    """Opens or begins the store in ``root``. ``buckets`` is fixed when a table is first written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def versions(self) -> list[int]:
        return numbered.numbers(self.spark, self.root, "version")

    def manifest(self, version: int | None = None) -> tuple[int, dict]:
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, {}
        return version, json.loads(numbered.read_text(self.spark, f"{self.root}/{numbered.name_of(version, 'version')}/manifest.json"))

    def _rows(self, held: dict, buckets: set[str] | None = None) -> DataFrame:
        kind = T.StructType.fromJson(held["schema"])
        folders = [f"{self.root}/{f}" for b, f in held["folders"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        held = self.manifest(version)[1]
        if table not in held:
            raise KeyError(f"no table {table}")
        return self._rows(held[table])

    def log(self, table: str, version: int) -> DataFrame:
        """The rows that a version inserted, updated or deleted, with ``action``."""
        kind = T.StructType.fromJson(self.manifest(version)[1][table]["schema"]).add(ACTION, "string")
        folder = f"{self.root}/{numbered.name_of(version, 'version')}/log/table={table}"
        return self.spark.read.schema(kind).parquet(folder)

    def write(self, changes: list[Change], tries: int = 20) -> int:
        """Commits all changes as one version and returns its number."""
        for _ in range(tries):
            version, tables = self.manifest()
            aside, data = numbered.aside(self.root), f"data/{uuid.uuid4().hex}"
            for change in changes:
                tables[change.table] = self._changed(change, tables.get(change.table), f"{data}/{change.table}", f"{aside}/log/table={change.table}")
            numbered.write_text(self.spark, f"{aside}/manifest.json", json.dumps(tables))
            if numbered.commit(self.spark, aside, self.root, "version", version + 1):
                return version + 1
            for folder in (aside, f"{self.root}/{data}"):
                numbered.remove(self.spark, folder)
        raise RuntimeError("too many writers")

    def _changed(self, change: Change, held: dict | None, data: str, log: str) -> dict:
        count = held["buckets"] if held else self.buckets
        bucket = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in change.by]), F.lit(count)).cast("string")
        touched = {r[0] for r in change.candidates.select(bucket.alias("b")).distinct().collect()}  # no more than there are buckets
        candidates = change.candidates
        existing = self._rows(held, touched) if held else candidates.limit(0)
        combined = change.combine(existing, candidates)
        if ACTION not in combined.columns:
            combined = combined.withColumn(ACTION, F.lit("update"))
        written = f"{self.root}/{data}"
        # rows that go are written for the log only
        combined.withColumn("_bucket", bucket).withColumn("_gone", F.col(ACTION) == "delete").repartition("_bucket").write.partitionBy("_gone", "_bucket").parquet(written)
        kind = combined.drop(ACTION).schema
        back = self.spark.read.schema(T.StructType([*combined.schema.fields, T.StructField("_gone", T.StringType()), T.StructField("_bucket", T.StringType())])).parquet(written)
        back.where(F.col(ACTION) != KEEP).select(*combined.columns).write.parquet(log)
        there = {r[0] for r in back.where("_gone = 'false'").select("_bucket").distinct().collect()}
        folders = {b: f for b, f in (held["folders"] if held else {}).items() if b not in touched}
        folders |= {b: f"{data}/_gone=false/_bucket={b}" for b in there}
        return {"schema": json.loads(kind.json()), "by": list(change.by), "buckets": count, "folders": folders}

    def vacuum(self, keep: int = 2) -> None:
        """Drops all but the last ``keep`` versions' manifests, and data that those do not name. No run may be going on, and no reader of an older version."""
        versions = self.versions()
        live = {f.split("/_gone=")[0] for v in versions[-keep:] for t in self.manifest(v)[1].values() for f in t["folders"].values()}
        for v in versions[:-keep]:
            numbered.remove(self.spark, f"{self.root}/{numbered.name_of(v, 'version')}")
        for name in numbered.listed(self.spark, f"{self.root}/data"):
            for table in numbered.listed(self.spark, f"{self.root}/data/{name}"):
                if f"data/{name}/{table}" not in live:
                    numbered.remove(self.spark, f"{self.root}/data/{name}/{table}")


def ingest_editions(store: SnapshotStore, editions: DataFrame, pages: DataFrame) -> int:
    """Stores printed editions (channel, edition_date, sha256, ocr_done, ...) and their pages (channel, edition_date, ...) in one version.

    An edition that is there with the same file and recognised text stays as it is, pages included; any other takes the place of the
    one of its channel and day together with all its pages. Of several candidates for one day the greatest by its other columns wins.
    """
    key = ("channel", "edition_date")
    have = store.read("editions") if "editions" in store.manifest()[1] else editions.limit(0)
    one = editions.groupBy(*key).agg(F.max(F.struct(*[c for c in editions.columns if c not in key])).alias("e")).select(*key, "e.*")
    changed = edition_changed(have, one).select(*editions.columns)
    days = changed.select(*key)
    new_pages = pages.join(days, list(key), "left_semi")

    def replace(existing: DataFrame, new: DataFrame) -> DataFrame:
        gone = existing.join(days, list(key), "left_semi").withColumn(ACTION, F.lit("delete"))
        stays = existing.join(days, list(key), "left_anti").withColumn(ACTION, F.lit(KEEP))
        return stays.unionByName(gone).unionByName(new.withColumn(ACTION, F.lit("insert")))

    # pages lie in the buckets of their editions, and an edition without new pages still loses its old ones
    both = days.join(new_pages, list(key), "left").select(*pages.columns)
    real = [c for c in pages.columns if c not in key]
    has_page = F.coalesce(*[F.col(c).cast("string") for c in real]).isNotNull()
    return store.write([Change("editions", key, changed, replace), Change("pages", key, both, lambda old, new: replace(old, new.where(has_page)))])
