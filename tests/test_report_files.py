"""Printed reports as files, and edits of reports."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tidewire.operators import reports
from tidewire.sources import report_files

AT = dt.datetime(2024, 1, 1)


def _items(spark, n=25):
    rows = [("a" if i % 5 else "b", i, i, "text", f"T<{i}>", f"s{i}", None, "", "x & y" if i == 1 else None, i % 4 != 3) for i in range(n)]
    return spark.createDataFrame(rows, "report_id string, sort_order int, item_id int, kind string, title string, source string, url string, snippet string, note string, included boolean")


def _heads(spark):
    return spark.createDataFrame([("a", "A & co", "2024-01-01", None, 3, "c" * 64, "n"), ("b", None, None, None, None, None, None), ("none", "N", None, None, 1, "", "")], "report_id string, title string, period_start string, period_end string, version int, content_hash string, notes string")


def _files(root):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs)


def test_reports_come_back_byte_equal(spark, tmp_path):
    root = str(tmp_path / "r")
    report_files.write_reports(reports.html_pieces(_heads(spark), _items(spark), 6), root, run="one", **reports.HTML)
    got = {(r.report_id, r.part): r for r in report_files.read_reports(spark, root).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("none", 0)}
    for r in got.values():
        raw = open(r.path, "rb").read()
        assert raw == r.content.encode() and hashlib.sha256(raw).hexdigest() == r.sha256 and r.path.endswith(f"{r.sha256}.html") and len(raw) == r.n_bytes
    shown = [i for i in range(25) if i % 5 and i % 4 != 3]
    whole = "".join(got["a", p].content for p in range(3))
    places = [whole.index(f"<h3>{n}. T&lt;{i}&gt;</h3>") for n, i in enumerate(shown, 1)]
    assert places == sorted(places) and whole.count("<h3>") == len(shown)
    assert "<h1>A &amp; co</h1>\n<p>Period: 2024-01-01 → — | Version 3 | Hash cccccccccccccccc</p>\n<p>n</p>" in got["a", 0].content
    assert "<p>Editor note: x &amp; y</p>" in whole and whole.count("<h1>") == 1
    assert "No included clippings." in got["none", 0].content and got["b", 0].content.startswith(reports.HTML["head"]) and "<h1>Untitled</h1>" in got["b", 0].content
    # the same rows dealt otherwise give the same files
    report_files.write_reports(reports.html_pieces(_heads(spark), _items(spark).repartition(7), 6), root, run="two", **reports.HTML)
    both = report_files.read_reports(spark, root, content=False).groupBy("report_id", "part", "sha256").agg(F.count("*").alias("n")).collect()
    assert len(both) == 5 and {r.n for r in both} == {2}


def test_runs_are_whole(spark, tmp_path):
    root = str(tmp_path / "r")
    pieces = spark.createDataFrame([("a", 0, 1, "x"), ("a", 0, 0, "é"), ("b", 0, 0, None)], "report_id string, part int, number int, text string")
    report_files.write_reports(pieces, root, "txt", "<", "|", ">", run="1")
    assert sorted(r.content for r in report_files.read_reports(spark, root).collect()) == ["<>", "<é|x>"]
    with pytest.raises(Exception, match="there already"):
        report_files.write_reports(pieces, root, run="1")
    before = _files(root)
    # a task that fails leaves no file, nor do those that were done before it
    broken = spark.range(2000).selectExpr("cast(id % 50 as string) report_id", "0 part", "id number", "if(id = 1999, raise_error('boom'), 'x') text")
    for bad in (broken, spark.createDataFrame([("a", 0, 1, "x"), ("a", 0, 1, "y")], pieces.schema), spark.createDataFrame([(None, 0, 1, "x")], pieces.schema)):
        with pytest.raises(Exception):
            report_files.write_reports(bad, root)
        assert _files(root) == before and os.listdir(root) == ["run=1"]
    report_files.write_reports(pieces.limit(0), root, run="2")
    assert {r.run for r in report_files.read_reports(spark, root).collect()} == {"1"}
    report_files.write_reports(pieces.where("report_id = 'b'"), root, run="3", mode="overwrite")
    left = report_files.read_reports(spark, root).collect()
    assert [(r.run, r.report_id, r.n_pieces, r.content) for r in left] == [("3", "b", 1, "")] and os.listdir(root) == ["run=3"]
    os.chmod(left[0].path, 0o644)
    open(left[0].path, "w").write("other")
    with pytest.raises(Exception, match="not what was written"):
        report_files.read_reports(spark, root).collect()


def test_attempts_that_were_lost_are_dropped(tmp_path):
    writer = report_files.ReportWriter({"path": str(tmp_path), "run": "r"}, False)
    kept, lost = writer.write(iter([("a", 0, 0, "x")])), writer.write(iter([("a", 0, 0, "x")]))
    assert kept.folder != lost.folder and kept.files == 1
    writer.commit([kept, None])
    assert len(_files(tmp_path)) == 2 and os.listdir(tmp_path) == ["run=r"]
    again = report_files.ReportWriter({"path": str(tmp_path), "run": "s"}, False)
    again.write(iter([("a", 0, 0, "x")]))
    again.abort([None])
    assert os.listdir(tmp_path) == ["run=r"]


def test_json_pieces(spark, tmp_path):
    import json

    report_files.write_reports(reports.json_pieces(_items(spark), 100), str(tmp_path / "j"), **reports.JSON_LINES)
    got = {r.report_id: [json.loads(x) for x in r.content.splitlines()] for r in report_files.read_reports(spark, str(tmp_path / "j")).collect()}
    assert [x["number"] for x in got["a"]] == list(range(1, len(got["a"]) + 1)) and got["a"][0]["note"] == "x & y" and got["a"][0]["title"] == "T<1>"


def test_edits(spark):
    heads = spark.createDataFrame([("a", "A", "draft"), ("b", "B", "approved")], "report_id string, title string, state string").withColumns({c: F.lit(None).cast("string") for c in ("notes", "period_start", "period_end")})
    items = spark.createDataFrame([("a", 1, "n", True), ("a", 2, None, True), ("b", 3, None, True)], "report_id string, item_id int, note string, included boolean")
    edits = spark.createDataFrame(
        [("a", 1, None, False, AT), ("a", 1, "new", None, AT), ("a", 1, "newer", None, AT + dt.timedelta(1)), ("a", 2, None, None, AT), ("a", 3, "x", None, AT), ("b", 3, "x", None, AT), ("c", 1, "x", None, AT)],
        "report_id string, item_id int, note string, included boolean, edited_at timestamp",
    )
    after, outcomes = reports.edit_items(heads, items, edits)
    assert sorted((r.item_id, r.note, r.included) for r in after.collect()) == [(1, "newer", False), (2, None, True), (3, None, True)]
    assert sorted((r.report_id, r.item_id, r.reason) for r in outcomes.where("reason is not null").collect()) == [("a", 3, "not_found"), ("b", 3, "not_editable"), ("c", 1, "not_found")] and outcomes.count() == 7
    meta = spark.createDataFrame([("a", "A2", None, None, AT), ("a", None, "hm", "in_review", AT), ("a", "A3", None, "sent", AT + dt.timedelta(1)), ("b", "B2", None, None, AT)], "report_id string, title string, notes string, state string, edited_at timestamp")
    meta = meta.withColumns({"period_start": F.lit("2024-01-01"), "period_end": F.lit(None).cast("string")})
    after, outcomes = reports.edit_meta(heads, meta)
    assert {r.report_id: (r.title, r.notes, r.state, r.period_start) for r in after.collect()} == {"a": ("A2", "hm", "in_review", "2024-01-01"), "b": ("B", None, "approved", None)}
    assert sorted(r.reason for r in outcomes.where("reason is not null").collect()) == ["bad_state", "not_editable"]


def test_numbers_skip_what_is_left_out(spark):
    assert sorted(r.number for r in reports.print_rows(_items(spark)).where("report_id = 'b'").collect()) == [1, 2, 3, 4]
