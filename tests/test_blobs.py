"""The object store: one blob for each content, keys that change, files, and writers side by side."""

import hashlib
from concurrent.futures import ThreadPoolExecutor

from tidewire.sources import numbered
from tidewire.sources.blobs import BlobStore

OBJECT = "key string, content binary"


def held(store):
    return sorted((r.digest, r.n_bytes, bytes(r.content)) for r in store.blobs().collect())


def blob(content):
    return hashlib.sha256(content).hexdigest(), len(content), content


def test_contents_are_kept_once(spark, tmp_path):
    store = BlobStore(spark, str(tmp_path / "s"))
    assert store.blobs().count() == store.names().count() == 0
    rows = [("a", b"one"), ("b", b"one"), ("c", b"two"), ("none", None), ("empty", b""), ("a", b"one")]
    assert store.put(spark.createDataFrame(rows, OBJECT)) == 1
    assert held(store) == sorted(map(blob, (b"one", b"two", b"")))
    assert store.put(spark.createDataFrame([("a", b"three"), ("d", b"two")], OBJECT)) == 2
    assert held(store) == sorted(map(blob, (b"one", b"two", b"", b"three")))
    keys = spark.createDataFrame([("a",), ("b",), ("d",), ("none",), ("x",)], "key string")
    assert {r.key: bytes(r.content) for r in store.get(keys).collect()} == {"a": b"three", "b": b"one", "d": b"two"}
    assert {r.key: r.exists for r in store.exists(keys).collect()} == {"a": True, "b": True, "d": True, "none": False, "x": False}
    assert store.put(spark.createDataFrame([], OBJECT)) == 3 and len(held(store)) == 4


def test_files(spark, tmp_path):
    for name, data in (("x.html", b"<p>"), ("sub/y.html", b"<p>"), ("sub/z.txt", b"no")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    store = BlobStore(spark, str(tmp_path / "s"))
    store.put_files(str(tmp_path / "in"), "raw/", "*.html")
    assert {r.key: r.digest for r in store.names().collect()} == dict.fromkeys(("raw/x.html", "raw/sub/y.html"), blob(b"<p>")[0])
    assert held(store) == [blob(b"<p>")]


def test_writers_side_by_side(spark, tmp_path):
    root = str(tmp_path / "s")
    many = [spark.createDataFrame([(f"{w}/{i}", f"content {i % 7}".encode()) for i in range(20)], OBJECT) for w in range(4)]
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(lambda d: BlobStore(spark, root).put(d), many)) == [1, 2, 3, 4]
    store = BlobStore(spark, root)
    assert held(store) == sorted(blob(f"content {i}".encode()) for i in range(7)) and store.names().count() == 80


def test_a_put_that_fails_is_not_seen(spark, tmp_path):
    store = BlobStore(spark, str(tmp_path / "s"))
    store.put(spark.createDataFrame([("a", b"one")], OBJECT))
    store.blobs().write.parquet(f"{numbered.aside(store.root)}/blobs")
    assert store.puts() == [1] and held(store) == [blob(b"one")]
