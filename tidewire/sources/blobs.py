"""Object storage: objects under keys, each distinct content kept once.

A put is a numbered folder with the blobs that were not there before, addressed by their
SHA-256, and the names that it gives. Whether a blob is there is asked by a join with the digests of
earlier puts, so contents are never compared or moved again; a put that another writer overtakes asks
anew. The latest put of a key counts. Keys and digests are sorted within files, so that lookups of a few read
little of a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.sources import numbered

BLOB, NAME = "digest string, n_bytes long, content binary", "key string, digest string, n_bytes long"


class BlobStore:
    """Opens or begins the store in ``root``, a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, kind: str, schema: str, puts: list[int]) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, put long")
        for start in range(0, len(puts), 500):
            paths = [f"{self.root}/{numbered.name_of(n, 'put')}/{kind}" for n in puts[start : start + 500]]
            found = self.spark.read.schema(schema).parquet(*paths)
            put = F.regexp_extract(F.col("_metadata.file_path"), r"/put=(\d+)/", 1).cast("long")
            out = out.unionByName(found.withColumn("put", put))
        return out

    def puts(self) -> list[int]:
        return numbered.numbers(self.spark, self.root, "put")

    def blobs(self) -> DataFrame:
        """(digest, n_bytes, content): each content once."""
        return self._read("blobs", BLOB, self.puts()).drop("put")

    def names(self) -> DataFrame:
        """(key, digest, n_bytes): what each key stands for now."""
        latest = F.max(F.struct("put", "digest", "n_bytes")).alias("n")
        return self._read("names", NAME, self.puts()).groupBy("key").agg(latest).select("key", "n.digest", "n.n_bytes")

    def put(self, objects: DataFrame, tries: int = 20) -> int:
        """Stores (key, content) and returns the number of the put. Of rows with one key any content that they have may stay; a null content
        is no object. Nothing is seen of a put that fails."""
        addressed = objects.where(F.col("content").isNotNull()).select(
            F.col("key").cast("string").alias("key"), F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("n_bytes"), F.col("content").cast("binary").alias("content")
        )
        for _ in range(tries):
            before, written = self.puts(), numbered.aside(self.root)
            known = self._read("blobs", BLOB, before).select("digest")
            new = addressed.drop("key").join(known, "digest", "left_anti").groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.first("content").alias("content"))
            new.sortWithinPartitions("digest").write.parquet(f"{written}/blobs")
            addressed.groupBy("key").agg(F.max(F.struct("digest", "n_bytes")).alias("n")).select("key", "n.*").sortWithinPartitions("key").write.parquet(f"{written}/names")
            number = max(before, default=0) + 1
            if numbered.commit(self.spark, written, self.root, "put", number):
                return number
            numbered.remove(self.spark, written)
        raise RuntimeError("too many writers")

    def put_files(self, path: str, under: str = "", pattern: str = "*") -> int:
        """Stores the files below a folder, each under its path from there on."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
        # the part of the path that the folder itself is, as Spark writes it
        root = path.split("://")[-1].removeprefix("file:").rstrip("/")
        return self.put(files.select(F.concat(F.lit(under), F.regexp_extract("path", rf"\Q{root}\E/(.*)$", 1)).alias("key"), "content"))

    def exists(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key, and more) with ``exists``."""
        there = self.names().select("key", F.lit(True).alias("exists"))
        return keys.join(there, "key", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))

    def get(self, keys: DataFrame) -> DataFrame:
        """``keys`` with digest, n_bytes and content; those that are not there are left out."""
        return keys.join(self.names(), "key").join(self.blobs().drop("n_bytes"), "digest")
