"""Upserts by bucket: what is written, what is logged, and editions with their pages."""

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tidewire.operators.merge import merge_snapshot
from tidewire.sources import numbered
from tidewire.sources.snapshots import Change, SnapshotStore, ingest_editions


def upsert(rows):
    return Change("t", ("k",), rows, lambda old, new: merge_snapshot(old, new, ["k"], F.lit(True)))


def held(store, version=None):
    return sorted(tuple(r) for r in store.read("t", version).collect())


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=16)
    first = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert store.write([upsert(first)]) == 1 and store.read("t").count() == 4000
    before = store.manifest()[1]["t"]["folders"]
    whole = size(tmp_path / "s" / "data")
    assert store.write([upsert(spark.createDataFrame([(7, -1), (5000, 1)], "k long, v long"))]) == 2
    after = store.manifest()[1]["t"]["folders"]
    assert len({b for b in after if after[b] != before.get(b)}) <= 2 and len(after) == 16
    assert size(tmp_path / "s" / "data") - whole < whole / 4
    assert dict(held(store)) == {k: 2 * k for k in range(4000)} | {7: -1, 5000: 1}
    assert sorted((r.k, r.v, r.action) for r in store.log("t", 2).collect()) == [(7, -1, "update"), (5000, 1, "insert")]
    assert dict(held(store, 1))[7] == 14  # older versions stay
    store.vacuum(1)
    assert store.versions() == [2] and len(held(store)) == 4001


def test_a_run_that_dies_leaves_the_version_before(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=4)
    store.write([upsert(spark.createDataFrame([(1, 1)], "k long, v long"))])
    bad = spark.createDataFrame([(1, 2)], "k long, v long").withColumn("v", F.raise_error(F.lit("dead")).cast("long"))
    try:
        store.write([upsert(bad)])
    except Exception as e:  # noqa: BLE001
        assert "dead" in str(e)
    assert store.versions() == [1] and held(store) == [(1, 1)]


def test_writers_side_by_side(spark, tmp_path):
    root = str(tmp_path / "s")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: SnapshotStore(spark, root, 4).write([upsert(spark.createDataFrame([(i, i), (9, i)], "k long, v long"))]), range(3)))
    store = SnapshotStore(spark, root)
    assert store.versions() == [1, 2, 3] and {k for k, _ in held(store)} == {0, 1, 2, 9}


def test_editions_replace_their_pages(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=4)
    edition = "channel string, edition_date string, sha256 string, ocr_done boolean"
    page = "channel string, edition_date string, page int, text string"
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    texts = lambda: sorted((r.channel, r.edition_date, r.page, r.text) for r in store.read("pages").collect())
    ingest_editions(store, make([("a", "1", "x", True), ("a", "2", "x", False), ("b", "1", "y", True)], edition), make([("a", "1", 0, "p"), ("a", "1", 1, "q"), ("a", "2", 0, "r"), ("b", "1", 0, "s")], page))
    assert len(texts()) == 4
    # the same file stays, an unrecognised one and another file are replaced, one with no pages left loses them
    ingest_editions(store, make([("a", "1", "x", True), ("a", "2", "x", True), ("b", "1", "z", True)], edition), make([("a", "1", 0, "ignored"), ("a", "2", 5, "new")], page))
    assert texts() == [("a", "1", 0, "p"), ("a", "1", 1, "q"), ("a", "2", 5, "new")]
    assert sorted((r.channel, r.edition_date, r.sha256) for r in store.read("editions").collect()) == [("a", "1", "x"), ("a", "2", "x"), ("b", "1", "z")]
    assert store.versions() == [1, 2] and numbered.listed(spark, store.root)[0] == "data"
