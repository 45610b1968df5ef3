"""Budget, breaker and job watch as streams with timers."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidewire.operators.gates import job_interrupted
from tidewire.streaming import hosts

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    hosts.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def feed(spark, path, n, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{path}/{n}")


def test_budget_breaker_and_forgetting(spark, tmp_path, rocksdb):
    kind = "host string, at timestamp, ok boolean"
    at = lambda s: BASE + dt.timedelta(seconds=s)
    first = [("h", at(i), True) for i in range(12)] + [("k", at(i), False) for i in range(7)]
    second = [("k", at(400), False), ("k", at(401), True), ("k", at(800), True), ("z", at(20_000), True)]
    feed(spark, tmp_path / "in", 1, first, kind)
    source = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = hosts.host_gate(source).writeStream.format("memory").queryName("gate").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    feed(spark, tmp_path / "in", 2, second, kind)
    q.processAllAvailable()
    feed(spark, tmp_path / "in", 3, [("z", at(20_001), True)], kind)
    q.processAllAvailable()
    q.stop()
    rows = spark.table("gate").where("at is not null").orderBy("host", "at").collect()
    h = [r.wait for r in rows if r.host == "h"]
    assert h[:10] == [0.0] * 10 and h[10] == pytest.approx(50.05) and h[11] == pytest.approx(50.05)
    k = [(r.allowed, r.failures) for r in rows if r.host == "k"]
    # open after five; half open at 400, where a failure opens it again; closed by the success at 800
    assert k == [(True, 1), (True, 2), (True, 3), (True, 4), (True, 5), (False, 5), (False, 5), (True, 6), (False, 6), (True, 0)]
    assert {r.host for r in spark.table("gate").where("at is null").collect()} == {"h", "k"}


def test_lost_jobs(spark, tmp_path, rocksdb):
    kind = "job_id string, at timestamp, status string, state string, started timestamp, created timestamp, task_id string"
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0)
    ago = lambda m: now - dt.timedelta(minutes=m)
    rows = [
        ("done", now, "succeeded", None, ago(90), ago(90), None), ("hard", now, "running", "STARTED", ago(41), ago(50), "t"), ("fine", now, "running", "STARTED", ago(39), ago(50), "t"),
        ("pending", now, "queued", "PENDING", ago(6), ago(6), "t"), ("unstarted", now, "queued", "PENDING", None, ago(6), "t"), ("legacy", now, "running", None, ago(16), ago(16), None),
        ("failed", now, "running", "FAILURE", ago(0), ago(0), "t"), ("timeless", now, "running", None, None, None, "t"),
    ]
    feed(spark, tmp_path / "in", 1, rows, kind)
    source = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def run(stream, name):
        return stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="500 milliseconds").start()

    # with timers in processing time there is always another batch, so the results are waited for
    q = run(hosts.lost_jobs(source), "lost")
    until = time.monotonic() + 60
    while time.monotonic() < until and spark.table("lost").count() < 4:
        time.sleep(1)
    q.stop()
    batch = spark.createDataFrame(rows, kind)
    want = {r.job_id for r in batch.where(job_interrupted(*[F.col(c) for c in ("status", "state", "started", "created", "task_id")], F.lit(now))).collect()}
    assert {r.job_id for r in spark.table("lost").collect()} == want == {"hard", "pending", "legacy", "failed"}
    # a timer tells of a job that falls silent: a few seconds in the place of minutes
    soon = [("late", now, "running", "STARTED", dt.datetime.now(dt.UTC).replace(tzinfo=None), None, "t")]
    feed(spark, tmp_path / "soon", 1, soon, kind)
    quiet = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "soon"))
    q = run(hosts.lost_jobs(quiet, hard_min=0.25), "silent")
    until = time.monotonic() + 60
    while time.monotonic() < until and not spark.table("silent").count():
        time.sleep(1)
    q.stop()
    assert [(r.job_id, r.reason) for r in spark.table("silent").collect()] == [("late", "silent")]
