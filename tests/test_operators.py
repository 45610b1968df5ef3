import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire.operators import gates, media, merge, priority, ranking, reports, semantic, stats


def first(spark, column):
    return spark.range(1).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "cos,rerank,lex,label,least",
    [(0.5, 0.4, 1.0, "relevant", 0.85), (0.1, 0.05, 0.0, "not_relevant", 0.8), (0.6, 0.4, 0.3, "needs_review", 0), (0.9, None, 0.96, "relevant", 0.9), (0.39, None, 0.96, "needs_review", 0), (1.0, 1.0, 0.5, "relevant", 0.8)],
)
def test_relevance(spark, cos, rerank, lex, label, least):
    r = first(spark, semantic.relevance(F.lit(cos), F.lit(rerank).cast("double"), F.lit(lex)))
    assert r.label == label and r.confidence >= least


def test_semantic_pipeline(spark):
    items = spark.createDataFrame([(i, [1.0, i / 40]) for i in range(60)], "item_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    top = semantic.cosine_top_k(queries, items)
    rows = top.orderBy("rank").collect()
    assert [r.item_id for r in rows] == list(range(20)) and rows[0].similarity == 1.0
    texts = top.withColumns({"q": F.lit("port news"), "t": F.when(F.col("item_id") < 12, "the port").otherwise("none")})
    ranked = semantic.rerank(texts, "q", "t").orderBy("rank").collect()
    assert [r.rerank for r in ranked] == [0.5] * 10 + [None] * 10
    lexical = spark.createDataFrame([(1, 0, 1.0, False), (1, 1, 1.0, True)], "query_id long, item_id long, lexical double, excluded boolean")
    done = semantic.semantic_candidates(semantic.rerank(texts, "q", "t"), lexical).orderBy("item_id").collect()
    assert done[0].item_id == 0 and done[0].decision.label == "relevant" and all(r.item_id != 1 for r in done)
    assert first(spark, semantic.pruned(F.lit(0.5), F.lit(0.05))) and not first(spark, semantic.pruned(F.lit(0.61), F.lit(0.05))) and not first(spark, semantic.pruned(F.lit(0.5), F.lit(None).cast("double")))
    tenants = spark.createDataFrame([(1,), (2,)], "tenant_id int")
    own = spark.createDataFrame([(2, 0.3, None, 0.5)], "tenant_id int, min_cosine double, min_rerank double, min_confidence double")
    assert [tuple(r) for r in semantic.thresholds(tenants, own).orderBy("tenant_id").collect()] == [(1, 0.45, 0.1, 0.6), (2, 0.3, 0.1, 0.5)]


def test_gates(spark):
    lit = F.lit
    gate = lambda g, e, c: first(spark, gates.epaper_gate(lit(g), lit(e), lit(c)))
    assert [gate(None, True, "rss"), gate("pending", True, "rss"), gate("approved", False, "rss"), gate("approved", True, "pending"), gate("approved", True, "rss"), gate("approved", True, "epaper")] == [
        "missing_assessment", "legal_gate_pending", "connector_disabled", "connector_not_configured", "connector_not_epaper", "ok",
    ]
    flags = {f: lit(f != "cost_approved") for f in ("credentials_available", *gates.SOCIAL_FLAGS)}
    assert first(spark, gates.social_missing(flags, lit(False), lit(True))) == ["cost_approved", "X_API_BEARER_TOKEN"]
    asof = lit("2024-01-01 12:00:00").cast("timestamp")
    lost = lambda state, minutes, task: first(
        spark, gates.job_interrupted(lit("running"), lit(state), asof - F.make_dt_interval(mins=lit(minutes)), asof, lit(task), asof)
    )
    assert [lost("STARTED", 30, "t"), lost("STARTED", 41, "t"), lost("PENDING", 6, "t"), lost(None, 10, None), lost(None, 16, None), lost("FAILURE", 0, "t")] == [False, True, True, False, True, True]
    r = lambda *x: first(spark, gates.recommendation(*map(lit, x)))
    assert [r(503, False, True, True, False, False), r(200, True, True, True, True, True), r(200, False, False, True, True, True), r(200, False, True, False, True, True), r(200, False, True, False, False, False)] == [
        "pending", "blocked", "blocked", "sitemap", "pending",
    ]
    assert first(spark, gates.valid_entity(lit("brand"), lit(" "), lit("x"))) and not first(spark, gates.valid_entity(lit("brand"), lit(None).cast("string"), lit("")))


def test_job_ages_count_parts_of_seconds(spark):
    asof, lit = F.lit("2024-01-15 00:00:00").cast("timestamp"), F.lit
    none = lit(None).cast("string")
    at = lambda time: lit(f"2024-01-14 {time}").cast("timestamp")
    lost = lambda state, time, task: first(spark, gates.job_interrupted(lit("running"), state, at(time), at(time), task, asof))
    assert [lost(none, t, none) for t in ("23:45:00", "23:45:00.000001", "23:45:00.999999", "23:44:59.5")] == [True, False, False, True]
    assert [lost(lit("PENDING"), t, lit("t")) for t in ("23:55:00", "23:55:00.4")] == [True, False]
    assert [lost(none, t, lit("t")) for t in ("23:20:00", "23:20:00.4")] == [True, False]
    done = lambda time: first(spark, gates.refresh_suppressed(lit("succeeded"), at(time), asof))
    assert [done(t) for t in ("23:45:00", "23:45:00.000001", "23:44:59.9")] == [False, True, False]


def test_merge(spark):
    old = spark.createDataFrame([(1, "included", 0.1), (2, "pending_review", 0.2), (3, "pending_review", 0.3)], "k int, status string, score double")
    new = spark.createDataFrame([(1, "x", 0.9), (2, "x", 0.8), (4, "x", 0.7)], "k int, status string, score double")
    rows = merge.upsert_matches(old, new, ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "included", 0.1, "keep"), (2, "pending_review", 0.8, "update"), (3, "pending_review", 0.3, "keep"), (4, "pending_review", 0.7, "insert")]
    kind = "publisher int, canonical_url string, title string, content_hash string, metadata map<string,string>"
    a = spark.createDataFrame([(1, "u", "t", "h", {"a": "1", "b": "1"})], kind)
    b = spark.createDataFrame([(1, "u", None, "h2", {"b": "2"}), (1, "v", "n", "h3", None)], kind)
    rows = merge.upsert_articles(a, b).orderBy("canonical_url").collect()
    assert (rows[0].title, rows[0].content_hash, rows[0].metadata, rows[1].action) == ("t", "h2", {"a": "1", "b": "2"}, "insert")
    decisions = spark.createDataFrame([(2, "included", "me", 1), (2, "rejected", "me", 2), (3, "odd", "me", 1)], "k int, new_status string, reviewer string, decided_at int")
    rows = merge.decide(old, decisions, "k", ("included", "rejected")).orderBy("k").collect()
    assert [r.status for r in rows] == ["included", "rejected", "pending_review"]


def test_ranking(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 1.0)], "g string, v double")
    assert {r.g: r.threshold for r in ranking.percentile_pick(df, "g", "v").collect()} == {"a": 6.0, "b": 1.0}
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id int")
    good = spark.createDataFrame([(3, 0), (1, 1), (2, 2)], "item_id int, position int")
    assert ranking.reordered(items, good).count() == 3
    assert ranking.reordered(items, good.where("position < 2")).count() == 0


def test_priority(spark):
    assert priority.focus_tokens(" Port, authority a،news ") == ["port, authority a،news", "port", "authority", "news"]
    rel, score = priority.priority(F.lit("port news"), F.lit(None).cast("double"), F.lit("negative"), ["port news", "port", "zz"])
    assert first(spark, rel) == pytest.approx(2 / 3) and first(spark, score) == pytest.approx(0.68 * 2 / 3 + 0.24 * 0.35 + 0.08 * 0.2)
    rows = [(i, f"T  {i % 3}", "x", i / 10, "neutral", None) for i in range(10)]
    a = spark.createDataFrame(rows, "doc_id long, title string, text string, importance double, sentiment string, cluster_id long")
    assert sorted(r.doc_id for r in priority.ranked(a, "").collect()) == [7, 8, 9]


def test_media(spark):
    t = spark.createDataFrame([("t1", "a" * 64, 0.5), ("t2", "b" * 64, 0.5), ("t3", "a" * 40 + "b" * 24, 0.99)], "template_id string, fingerprint string, min_confidence double")
    i = spark.createDataFrame([(1, "a" * 64, 100), (2, "a" * 64, 31)], "image_id long, fingerprint string, n_bytes int")
    rows = media.logo_cascade(t, i).orderBy("rank").collect()
    assert [(r.template_id, round(r.confidence, 4), r.stage) for r in rows] == [("t1", 0.99, "embedding_similarity"), ("t3", 0.775, "local_screen_below_threshold")]
    assert rows[1].score == pytest.approx((0.6 * 0.775 + 0.4 * 0.625) * 0.85)
    pages = spark.createDataFrame([(1, " a \n\nb\n")], "page_id long, text string")
    assert [tuple(r) for r in media.text_blocks(pages).orderBy("block_no").collect()] == [(1, 0, "a", 0.0, 0.45), (1, 1, "b", 0.5, 0.45)]
    box = F.array(*[F.struct(F.lit(x).alias("text"), *[F.lit(v).alias(c) for c in "xywh"]) for x, v in (("one", 0.1), ("Two", 0.2))])
    assert first(spark, media.anchor_box(box, F.lit("two"))).x == 0.2 and first(spark, media.anchor_box(box, F.lit("z"))).x == 0.1
    assert first(spark, media.page_text(F.lit("short"), F.lit("remote"), F.lit("stub"))).provider == "remote"


def test_reports(spark):
    at = dt.datetime(2024, 1, 1)
    kind = "report_id int, item_id int, title string, status string, reviewed_at timestamp, created_at timestamp"
    texts = spark.createDataFrame([(1, 1, "a", "included", None, at), (1, 2, "b&", "included", at, at), (1, 3, "c", "rejected", at, at)], kind)
    none = spark.createDataFrame([], kind)
    items = reports.draft(texts, none, texts.withColumn("item_id", F.col("item_id") + 10), none).withColumn("included", F.col("item_id") != 11)
    assert [(r.item_id, r.kind) for r in items.orderBy("sort_order").collect()] == [(2, "text"), (1, "text"), (12, "logo"), (11, "logo")]
    snap = reports.snapshot(items)
    versions = spark.createDataFrame([(1, 4, "old")], "report_id int, version int, content_hash string")
    assert [r.version for r in reports.approve(snap, versions).collect()] == [5]
    assert reports.approve(snap, snap.select("report_id", F.lit(1).alias("version"), "content_hash")).count() == 0
    assert [(r.number, r.title) for r in reports.print_rows(items).orderBy("number").collect()] == [(1, "b&amp;"), (2, "a"), (3, "b&amp;")]
    step = lambda s, a, n=1: first(spark, reports.next_state(F.lit(s), F.lit(a), F.lit(n)))
    assert [step("draft", "approve"), step("draft", "approve", 0), step("approved", "edit"), step("approved", "revise"), step("in_review", "edit")] == ["approved", None, None, "draft", "in_review"]


def test_stats(spark):
    rows = [(1, "x", dt.datetime(2024, 2, 9)), (1, "", None), (2, "y", None), (2, None, dt.datetime(2020, 1, 1))]
    a = spark.createDataFrame(rows, "p int, body string, published_at timestamp")
    r = stats.article_stats(a, F.lit("2024-02-10").cast("timestamp")).first()
    assert tuple(r) == (4, 2, 2, 1, 1)
    assert first(spark, stats.index_coverage(F.lit(9), F.lit(4))) == 1.0 and first(spark, stats.index_coverage(F.lit(1), F.lit(0))) == 1.0
