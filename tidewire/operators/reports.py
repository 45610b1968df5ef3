"""Reports: drafting, snapshots, versions, state changes, and rows for printing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import stable_json, xml_escape
from tidewire.operators.ranking import number_sections, number_versions

EDITABLE = ("draft", "in_review")


def draft(texts: DataFrame, cuttings: DataFrame, logos: DataFrame, posts: DataFrame) -> DataFrame:
    """Included items of the four kinds with kind, report_id, item_id, reviewed_at, created_at; numbered from 0."""
    kinds = (("text", texts), ("cutting", cuttings), ("logo", logos), ("social", posts))
    parts = [df.where(F.col("status") == "included").withColumn("kind", F.lit(k)) for k, df in kinds]
    ordered = [p.withColumn("_reviewed", F.coalesce(-F.col("reviewed_at").cast("double"), F.lit(float("inf")))).withColumn("_created", -F.col("created_at").cast("double")) for p in parts]
    return number_sections(ordered, ["_reviewed", "_created", "item_id"]).drop("_reviewed", "_created")


def snapshot(items: DataFrame) -> DataFrame:
    """(report_id, snapshot, content_hash): included items in order as stable JSON, and its SHA-256."""
    chosen = items.where("included").select("report_id", F.struct("sort_order", "kind", "item_id", "title").alias("i"))
    packed = chosen.groupBy("report_id").agg(F.array_sort(F.collect_list("i")).alias("items"))
    text = packed.withColumn("snapshot", stable_json(F.to_json(F.struct("report_id", "items"))))
    return text.select("report_id", "snapshot", F.sha2("snapshot", 256).alias("content_hash"))


def approve(snapshots: DataFrame, versions: DataFrame) -> DataFrame:
    """New versions, numbered after those that exist; a snapshot that a report has already is not one."""
    fresh = snapshots.join(versions.select("report_id", "content_hash"), ["report_id", "content_hash"], "left_anti")
    return number_versions(fresh, versions, "report_id", ["content_hash"])


def next_state(state: Column, action: Column, n_included: Column) -> Column:
    """The state after an action; null where it is not allowed."""
    open_ = state.isin(*EDITABLE)
    return (
        F.when((action == "submit") & (state == "draft"), "in_review")
        .when((action == "approve") & open_ & (n_included > 0), "approved")
        .when((action == "revise") & (state == "approved"), "draft")
        .when((action == "archive") & state.isin("approved", "sent", "failed"), "archived")
        .when((action == "deliver") & (state == "approved"), "sent")
        .when((action == "edit") & open_, state)
    )


def edit_items(reports: DataFrame, items: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, outcomes): items of open reports with the notes and choices of edits (report_id, item_id, note, included, edited_at).

    A null in an edit leaves that field as it is; of several edits the latest that sets a field counts, of equally late ones the greatest value.
    Outcomes hold each edit with ``reason``: null if it took effect, else "not_editable" or "not_found".
    """
    open_ = reports.select("report_id", F.col("state").isin(*EDITABLE).alias("_open"))
    known = items.select("report_id", "item_id").distinct().withColumn("_known", F.lit(True))
    judged = edits.join(open_, "report_id", "left").join(known, ["report_id", "item_id"], "left")
    why = F.when(F.col("_open").isNull(), "not_found").when(~F.col("_open"), "not_editable").when(F.col("_known").isNull(), "not_found")
    judged = judged.withColumn("reason", why).drop("_open", "_known")
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("edited_at", c)))[c].alias(f"_{c}")
    new = judged.where("reason is null").groupBy("report_id", "item_id").agg(last("note"), last("included"))
    edited = items.join(new, ["report_id", "item_id"], "left")
    return edited.withColumns({c: F.coalesce(f"_{c}", c) for c in ("note", "included")}).select(*items.columns), judged


def edit_meta(reports: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, outcomes): open reports with what edits (report_id, title, notes, period_start, period_end, state, edited_at) set.

    As ``edit_items``; a state other than draft and in_review fails the whole edit with "bad_state".
    """
    fields = ("title", "notes", "period_start", "period_end", "state")
    now = reports.select("report_id", F.col("state").isin(*EDITABLE).alias("_open"))
    why = F.when(F.col("_open").isNull(), "not_found").when(~F.col("_open"), "not_editable").when(~F.coalesce(F.col("state").isin(*EDITABLE), F.lit(True)), "bad_state")
    judged = edits.join(now, "report_id", "left").withColumn("reason", why).drop("_open")
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("edited_at", c)))[c].alias(f"_{c}") for c in fields]
    new = judged.where("reason is null").groupBy("report_id").agg(*last)
    edited = reports.join(new, "report_id", "left")
    return edited.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).select(*reports.columns), judged


def print_rows(items: DataFrame, *more: str) -> DataFrame:
    """What a printed report lists: included items, numbered from 1 without gaps, escaped for markup; and other columns as they are."""
    listed = number_sections([items.where("included")], ["sort_order", "item_id"])
    return listed.select("report_id", (F.col("sort_order") + 1).alias("number"), "kind", xml_escape("title").alias("title"), *more)


#: Fixed values of printed reports.
UNTITLED, NO_SOURCE, NO_ITEMS = "Untitled", "Source", "No included clippings."
HTML = {"head": '<!doctype html><html><head><meta charset="utf-8"></head><body>\n', "between": "", "tail": "</body></html>\n", "suffix": "html"}
JSON_LINES = {"head": "", "between": "\n", "tail": "\n", "suffix": "jsonl"}


def html_pieces(reports: DataFrame, items: DataFrame, per_part: int = 500) -> DataFrame:
    """Pieces (report_id, part, number, text) for the report files, in markup: a heading for each report, and its included items.

    ``reports`` has report_id, title, period_start, period_end, version, content_hash, notes; items have source, url, snippet and note besides what
    ``print_rows`` needs. A file holds ``per_part`` items, so that a very long report is several tasks' work; the heading is in part 0.
    """
    text = lambda c, otherwise="": xml_escape(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(otherwise)))
    optional = lambda c, before: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"<p>{before}"), text(c), F.lit("</p>\n"))).otherwise("")
    rows = print_rows(items, "source", "url", "snippet", "note")
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED))
    piece = F.concat(F.lit("<h3>"), F.col("number").cast("string"), F.lit(". "), title, F.lit("</h3>\n<p>"), text("source", NO_SOURCE), F.lit(" \u2014 "), text("url"), F.lit("</p>\n"), optional("snippet", ""), optional("note", "Editor note: "))
    body = rows.select("report_id", F.floor((F.col("number") - 1) / per_part).alias("part"), F.col("number").cast("long").alias("number"), piece.alias("text"))
    period = F.concat(F.lit("<p>Period: "), text("period_start", "\u2014"), F.lit(" \u2192 "), text("period_end", "\u2014"))
    version = F.concat(F.lit(" | Version "), F.coalesce(F.col("version"), F.lit(1)).cast("string"), F.lit(" | Hash "), F.substring(text("content_hash"), 1, 16), F.lit("</p>\n"))
    none = F.when(F.col("_any").isNull(), f"<p>{NO_ITEMS}</p>\n").otherwise("")
    heading = F.concat(F.lit("<h1>"), text("title", UNTITLED), F.lit("</h1>\n"), period, version, optional("notes", ""), none)
    some = items.where("included").select("report_id").distinct().withColumn("_any", F.lit(True))
    heads = reports.join(some, "report_id", "left").select("report_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("number"), heading.alias("text"))
    return heads.unionByName(body)


def json_pieces(items: DataFrame, per_part: int = 500) -> DataFrame:
    """Pieces of files with one JSON object a line: the included items by number, not escaped for markup."""
    rows = number_sections([items.where("included")], ["sort_order", "item_id"]).withColumn("number", (F.col("sort_order") + 1).cast("long"))
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("item_id", "kind", "note", "snippet", "source", "title", "url")]
    return rows.select("report_id", F.floor((F.col("number") - 1) / per_part).alias("part"), "number", F.to_json(F.struct("number", *fields)).alias("text"))
