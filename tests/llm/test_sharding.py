import pytest
from pyspark.sql import functions as F

from tidewire.llm.common import new_folder
from tidewire.llm.sharding import Conflict, Shard, ShardStore, shard


def plain(df):
    return sorted((tuple(r) for r in df.drop("shard").collect()), key=repr)


def test_append_compact_read(spark, docs_of):
    store = ShardStore(spark, new_folder(spark, "store"), target_bytes=40_000, fan_in=3, unit=1000)
    assert store.versions() == []
    docs = [docs_of([f"text {i} {j} " + "é" * 50 for j in range(40)], ids=[100 * i + j for j in range(40)]).repartition(2) for i in range(4)]
    whole = docs[0]
    for i, d in enumerate(docs):
        assert store.append(d) == i + 1
        whole = whole.union(d) if i else d
    before = store.manifest()[2]
    assert len(before) == 8
    old = store.read(2)
    assert old.count() == 80
    last = store.compact()
    version, _, after = store.manifest()
    assert version == last > 4 and len(after) < 8
    assert not store.full_run(after)
    assert plain(store.read()) == plain(whole)
    assert old.count() == 80  # older versions stay readable
    store.vacuum()
    assert len(store.versions()) == last and old.count() == 80  # within the grace time
    store.vacuum(0)
    assert store.versions() == [last] and plain(store.read()) == plain(whole)


def test_commits_are_atomic(spark, docs_of):
    root = new_folder(spark, "store")
    a, b = ShardStore(spark, root), ShardStore(spark, root)
    a.append(docs_of(["one"]))
    schema = a.manifest()[1]
    b._commit(2, schema, b.manifest()[2])
    with pytest.raises(Conflict):
        a._commit(2, schema, [])
    assert a.append(docs_of(["two"])) == 3
    assert a.read().count() == 2
    with pytest.raises(ValueError):
        a.append(docs_of(["x"]).drop("lang"))


def test_tiers(spark):
    store = ShardStore(spark, new_folder(spark, "store"), target_bytes=1000, fan_in=4, unit=10)
    assert [store.tier(n) for n in (0, 1, 9, 10, 39, 40, 160)] == [0, 0, 0, 1, 1, 2, 3]
    small = [Shard(f"s{i}", 5) for i in range(4)]
    large = [Shard(f"l{i}", 600) for i in range(9)]
    middle = [Shard(f"m{i}", 50) for i in range(3)]
    assert store.full_run(large + middle) == []
    assert store.full_run(large + middle + small) == small


def test_edges(spark, docs_of):
    empty = shard(docs_of([]), new_folder(spark, "store"))
    assert empty.collect() == [] and "shard" in empty.columns
    rows = shard(docs_of([None, "", "a", "a"], ids=[None, 1, 2, 2]).withColumnRenamed("lang", "shard"), new_folder(spark, "store")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == [(0, ""), (1, ""), (2, "a"), (2, "a")]


def test_query_compacts_several_arrivals(spark, tmp_path, docs_of):
    from tidewire.llm.queries import op6_shards

    docs_of([f"text {i} " * 20 for i in range(200)]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op6_shards(spark, str(tmp_path))
    assert rows.count() == 200 and rows.where("not sharded").count() == 0
    # five arrivals of one small shard each; the first four were merged into one
    files = rows.select(F.input_file_name().alias("f")).distinct().count()
    assert files == 2


def test_vacuum_spares_what_another_writer_is_about_to_commit(spark, docs_of):
    root = new_folder(spark, "store")
    a, b = ShardStore(spark, root), ShardStore(spark, root)
    b.append(docs_of(["one"]))
    with a._writing(docs_of(["two", "three"])) as new:
        b.vacuum(0)
        version, schema, shards = a.manifest()
        a._commit(version + 1, schema, shards + new)
    b.vacuum(0)
    assert plain(b.read()) == plain(docs_of(["one"]).union(docs_of(["two", "three"])))
    assert b._listed("intents") == []


def test_writers_in_turn_on_one_store(spark, docs_of):
    from concurrent.futures import ThreadPoolExecutor

    root = new_folder(spark, "store")
    arrivals = [docs_of([f"text {k} {i}" for i in range(20)], ids=[100 * k + i for i in range(20)]) for k in range(6)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda d: shard(d, root).schema, arrivals))
    whole = ShardStore(spark, root).read()
    assert sorted(r.doc_id for r in whole.collect()) == sorted(100 * k + i for k in range(6) for i in range(20))


def test_failed_writes_leave_nothing_and_dead_writers_are_cleared(spark, docs_of):
    store = ShardStore(spark, new_folder(spark, "store"))
    store.append(docs_of(["one"]))
    with pytest.raises(ValueError):
        store.append(docs_of(["x"]).withColumn("doc_id", F.col("doc_id").cast("string")))
    with pytest.raises(RuntimeError), store._writing(docs_of(["two"])):
        raise RuntimeError("no commit")
    assert len(store._listed("data")) == 1 and store._listed("intents") == []
    writing = store._writing(docs_of(["never committed"]))
    writing.__enter__()
    store.vacuum(0)
    assert len(store._listed("data")) == 2
    store.vacuum(0, abandoned_seconds=0)
    assert len(store._listed("data")) == 1 and store._listed("intents") == [] and store.read().count() == 1
    assert store.append(docs_of(["two"])) == 2
