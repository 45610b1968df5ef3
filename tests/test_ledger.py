"""Runs that stop and go on: stages done are not done again, and a publisher's failure stays its own."""

from pyspark.sql import functions as F

from tidewire.operators.ledger import RunLedger, Stage, run_all, totals

ROWS = [("a", 1), ("a", 2), ("b", 3), ("b", 4), ("c", 5), (None, 6)]


def stages(bad=None):
    def fetch(rows):
        test = F.when(F.col("publisher") == bad, F.raise_error(F.lit("no answer"))).otherwise(F.col("n") * 10) if bad else F.col("n") * 10
        return rows.select("publisher", test.cast("long").alias("n"))

    return [Stage("discover", lambda rows: rows.where("n <> 2")), Stage("fetch", fetch), Stage("stats", lambda rows: rows.groupBy("publisher").agg(F.sum("n").alias("n")))]


def held(outcome):
    return sorted((r.publisher, r.n) for r in outcome.rows.collect())


def counts(outcome):
    return {r.stage: (r.succeeded, r.failed, r["rows"]) for r in totals(outcome.entries).collect()}


def test_failure_stays_its_own_and_reruns_skip(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "publisher string, n long")
    ledger = RunLedger(spark, str(tmp_path / "ledger"))
    first = run_all(ledger, "r1", stages(bad="b"), rows)
    assert held(first) == [("a", 10), ("c", 50)] and first.worked == {"discover": 3, "fetch": 3, "stats": 2}
    assert counts(first) == {"discover": (3, 0, 4), "fetch": (2, 1, 2), "stats": (2, 0, 2)}
    assert "no answer" in first.entries.where("status = 'failed'").first().error
    # one publisher's recovery: only what failed runs
    again = run_all(ledger, "r2", stages(), rows, ["b"])
    assert held(again) == [("b", 70)] and again.worked == {"discover": 0, "fetch": 1, "stats": 1}
    whole = run_all(ledger, "r3", stages(), rows)
    assert held(whole) == [("a", 10), ("b", 70), ("c", 50)] and whole.worked == {"discover": 0, "fetch": 0, "stats": 0}
    assert whole.entries.count() == 0


def test_new_rows_run_for_their_publisher_only(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "publisher string, n long")
    ledger = RunLedger(spark, str(tmp_path / "ledger"))
    run_all(ledger, "r1", stages(), rows)
    more = rows.union(spark.createDataFrame([("c", 7)], rows.schema))
    after = run_all(ledger, "r2", stages(), more)
    assert after.worked == {"discover": 1, "fetch": 1, "stats": 1} and held(after) == [("a", 10), ("b", 70), ("c", 120)]


def test_nothing_to_do_and_all_failed(spark, tmp_path):
    empty = spark.createDataFrame([], "publisher string, n long")
    assert run_all(RunLedger(spark, str(tmp_path / "one")), "r", stages(), empty).rows.collect() == []
    one = spark.createDataFrame([("b", 1)], "publisher string, n long")
    failed = run_all(RunLedger(spark, str(tmp_path / "two")), "r", stages(bad="b"), one)
    assert failed.rows.collect() == [] and failed.worked == {"discover": 1, "fetch": 1} and counts(failed)["fetch"] == (0, 1, 0)
