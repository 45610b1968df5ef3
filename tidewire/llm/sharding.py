"""Sharding by size-tiered compaction.

A store is a folder: ``data/`` holds immutable Parquet shards, ``manifests/`` the
versions, each a list of the shards that are in it. An arrival is appended as
small shards, one a task, and committed as the next version. Compaction merges
runs of similarly sized shards, all of one tier, into files of about the target
size, until no tier has a full run; each document is rewritten at most once a
tier. No step shuffles. A version appears by one rename that fails if it exists
already, so a reader sees a whole version or none and of two writers one wins.

Whoever writes shards first leaves an intent in ``intents/`` and removes it when the
version that has them is committed. Vacuuming spares folders with an intent, so
it may run beside any number of writers.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    bytes: int


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """Opens or begins the store in ``root``, a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4, unit: int = 1 << 20, row_group_bytes: int = 32 << 20):
        self.spark, self.root, self.row_group_bytes = spark, root.rstrip("/"), row_group_bytes
        self.target_bytes, self.fan_in, self.unit = target_bytes, fan_in, unit
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri() if "://" in self.root else self._fs.getUri(), conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def versions(self) -> list[int]:
        found = self._fs.listStatus(self._path(f"{self.root}/manifests"))
        names = [f.getPath().getName() for f in found]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, str | None, list[Shard]]:
        """(version, schema, shards) of a version, or of the latest; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, None, []
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return version, found["schema"], [Shard(**s) for s in found["shards"]]

    def _commit(self, version: int, schema: str, shards: list[Shard]) -> int:
        text = json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]})
        temporary = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._context.rename(temporary, self._path(f"{self.root}/manifests/v{version:010d}.json"), options)
        except Py4JJavaError as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or "exist" in str(e.java_exception.getMessage()):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    @contextmanager
    def _writing(self, df: DataFrame) -> Iterator[list[Shard]]:
        """Writes df as new shards that no vacuum touches until the block is left; they go if it fails."""
        name = uuid.uuid4().hex
        intent, folder = self._path(f"{self.root}/intents/{name}"), f"data/{name}"
        self._fs.create(intent).close()
        try:
            # a task holds a row group in memory while it writes
            df.write.option("parquet.block.size", self.row_group_bytes).parquet(f"{self.root}/{folder}")
            files = self._fs.listStatus(self._path(f"{self.root}/{folder}"))
            yield [Shard(f"{folder}/{f.getPath().getName()}", f.getLen()) for f in files if f.getPath().getName().startswith("part-")]
        except BaseException:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise
        finally:
            self._fs.delete(intent, False)

    def append(self, df: DataFrame, tries: int = 20) -> int:
        """Adds an arrival; returns the version that has it. Names, order and types of the columns must be those of the store."""

        def held(schema: str | None) -> str:
            kind = df.schema if schema is None else T.StructType.fromJson(json.loads(schema))
            if kind.simpleString() != df.schema.simpleString():
                raise ValueError(f"the arrival is {df.schema.simpleString()}, the store {kind.simpleString()}")
            return schema or df.schema.json()

        held(self.manifest()[1])
        with self._writing(df) as new:
            for _ in range(tries):
                version, schema, shards = self.manifest()
                try:
                    return self._commit(version + 1, held(schema), shards + new)
                except Conflict:
                    continue
            raise Conflict("too many writers")

    def tier(self, size: int) -> int:
        """Shards of a tier are within a factor of fan_in; all below ``unit`` are tier 0."""
        return max(0, math.floor(math.log(max(size, 1) / self.unit, self.fan_in)) + 1)

    def full_run(self, shards: list[Shard]) -> list[Shard]:
        """The shards of the lowest tier with at least fan_in of them; shards of half the target or more rest."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes * 2 < self.target_bytes:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), [])

    def compact(self) -> int:
        """Merges until no tier has a full run; returns the version. A merge that loses a race is done anew.

        Each merge leaves fewer shards or larger ones, so this ends.
        """
        while True:
            version, schema, shards = self.manifest()
            run = self.full_run(shards)
            if not run:
                return version
            kind = T.StructType.fromJson(json.loads(schema))
            files = max(1, round(sum(s.bytes for s in run) / self.target_bytes))
            gone = set(run)
            with self._writing(self.spark.read.schema(kind).parquet(*[f"{self.root}/{s.path}" for s in run]).coalesce(files)) as merged:
                while True:
                    version, schema, now = self.manifest()
                    if not gone <= set(now):
                        break
                    try:
                        self._commit(version + 1, schema, [s for s in now if s not in gone] + merged)
                        break
                    except Conflict:
                        continue

    def vacuum(self, grace_seconds: float = 3600, abandoned_seconds: float = 7 * 86_400) -> None:
        """Deletes versions superseded for longer than ``grace_seconds``, and shards that no version left has.

        Readers of a version have that long to finish; with 0 there must be none. Shards with an intent are left
        alone, as their writer may be about to commit, unless the intent is older than ``abandoned_seconds``:
        no write takes that long, so its writer is gone.
        """
        now = time.time()
        # the order matters: what is listed here without an intent after it was committed before the versions are read
        folders = [f.getPath().getName() for f in self._listed("data")]
        intents = {f.getPath().getName(): now - f.getModificationTime() / 1000 for f in self._listed("intents")}
        stamped = {int(f.getPath().getName()[1:-5]): now - f.getModificationTime() / 1000 for f in self._listed("manifests") if f.getPath().getName().startswith("v")}
        newest_first = sorted(stamped, reverse=True)
        live: set[str] = set()
        for place, version in enumerate(newest_first):
            # a version is superseded when the next one appears
            if place and stamped[newest_first[place - 1]] >= grace_seconds:
                self._fs.delete(self._path(f"{self.root}/manifests/v{version:010d}.json"), False)
                continue
            try:
                live |= {s.path for s in self.manifest(version)[2]}
            except Py4JJavaError as e:  # another vacuum took it; nobody may read it any more
                if not place or "FileNotFound" not in e.java_exception.getClass().getName():
                    raise
        for name in folders:
            if name in intents and intents[name] < abandoned_seconds:
                continue
            files = [f.getPath() for f in self._listed(f"data/{name}")]
            if not any(f"data/{name}/{f.getName()}" in live for f in files):
                self._fs.delete(self._path(f"{self.root}/data/{name}"), True)
            else:
                for f in files:
                    if f.getName().startswith("part-") and f"data/{name}/{f.getName()}" not in live:
                        self._fs.delete(f, False)
            self._fs.delete(self._path(f"{self.root}/intents/{name}"), False)

    def _listed(self, folder: str) -> list:
        """What is in a folder of the store; nothing if it is not there yet, or no longer."""
        try:
            return list(self._fs.listStatus(self._path(f"{self.root}/{folder}")))
        except Py4JJavaError as e:
            if "FileNotFound" in e.java_exception.getClass().getName():
                return []
            raise

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``shard`` (replacing a column of that name)."""
        _, schema, shards = self.manifest(version)
        if not shards:
            kind = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType([])
            return self.spark.createDataFrame([], kind).withColumn("shard", F.lit(None).cast("string"))
        rows = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*[f"{self.root}/{s.path}" for s in shards])
        return rows.withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/[^/]+)$", 1))


def shard(df: DataFrame, root: str, target_bytes: int = 64 << 20, arrivals: list[DataFrame] | None = None, grace_seconds: float = 3600) -> DataFrame:
    """Appends df (or, one after another, the arrivals that make it up) to the store in root, compacts it after each, and returns the rows of the store with their ``shard``.

    Nulls, repeated rows and any columns are stored as they are; an empty table makes a
    version with an empty shard. Several runs may use one store at a time; ``grace_seconds`` as in
    ``vacuum``, 0 for a store that nobody else reads.
    """
    store = ShardStore(df.sparkSession, root, target_bytes)
    for arrival in arrivals or [df]:
        store.append(arrival)
        store.compact()
    store.vacuum(grace_seconds)
    return store.read()
