"""The dashboard's payload, a tenant's lists, and thresholds of values that lie unevenly."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidewire.operators import dashboard
from tidewire.operators.ranking import percentile_pick
from tidewire.sources.tenants import TenantTables, store_tenants

AT = dt.datetime(2024, 1, 10)
ARTICLE = "article_id long, story_cluster_id long, title string, url string, published_at timestamp, discovered_at timestamp, language string, body string, publisher string, ai struct<summary:string,topics:array<string>,sentiment:string,importance:double,model:string>"
RUN = "run_id int, task string, status string, attempt_count int, error string, created_at timestamp, started_at timestamp, finished_at timestamp, result struct<created:int>"


def _payload(spark, articles, runs):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    publishers = frame([("p", "P", None, None), ("q", "Q", None, "h")], "publisher string, name_en string, name_ar string, homepage_url string")
    images = frame([(1, AT, "late"), (1, AT - dt.timedelta(1), "early"), (9, AT, "x")], "article_id long, created_at timestamp, image_url string")
    channels = frame([("p", "c1"), ("p", "c2")], "publisher string, channel string")
    editions = frame([(i, "p" if i % 2 else "gone", AT + dt.timedelta(i), None, "new", None, 4) for i in range(30)], "edition_id int, publisher string, edition_date timestamp, title string, status string, source_url string, page_count int")
    marks = frame([("pending_review",), (None,)], "status string")
    got = dashboard.payload(frame(articles, ARTICLE), images, publishers, channels, editions.withColumn("edition_date", F.to_date("edition_date")), frame(runs, RUN), frame([(1,)], "a int"), marks, F.lit(AT))
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.section, r.position)):
        out.setdefault(r.section, []).append((r.position, r.key, json.loads(r.payload)))
    return out


def test_payload(spark):
    ai = ("s", ["t"], "mixed", 0.5, "m")
    rows = [
        (1, None, "", None, AT, AT, "en", "b" * 300, "p", ai), (2, 7, "T", "u", AT, AT + dt.timedelta(1), "en", "b", "p", None), (3, None, "no body", None, AT, AT, "en", None, "p", None),
        (4, None, "old", None, AT - dt.timedelta(6), AT, "en", "b", "p", None), (5, None, "undated", None, None, AT, "en", "b", "p", None), (6, None, "nobody's", None, AT, AT, "en", "b", "zz", None),
    ]
    runs = [(1, "ingest", "done", 1, None, AT, AT, None, (3,)), (2, "other", "x", 1, None, AT + dt.timedelta(1), None, None, None)]
    got = _payload(spark, rows, runs)
    assert got["stats"][0][2] == {"total": 6, "with_body": 5, "with_date": 5, "confirmed_in_lookback": 3, "date_unknown_with_body": 1}
    assert [(p, k) for p, k, _ in got["articles"]] == [(0, "2"), (1, "1")]
    first = got["articles"][1][2]
    assert first["title"] == "(untitled)" and first["cover_image_url"] == "early" and first["ai_model"] == "m" and len(first["snippet"]) <= 221 and got["articles"][0][2]["ai_topics"] == []
    assert [(k, x["channel_count"], x["article_stats"]["total"]) for _, k, x in got["publishers"]] == [("p", 2, 5), ("q", 0, 0)]
    assert [k for _, k, _ in got["editions"]] == [str(i) for i in range(29, 5, -2)]
    assert got["ingestion"][0][2]["id"] == "1" and got["ingestion"][0][2]["result"] == {"created": 3}
    assert got["ai_status"][0][2] == {"enriched": 1, "embedded": 1, "semantic_candidates": 2, "pending_review": 1, "index_coverage": 0.2}


def test_payload_of_nothing(spark):
    got = _payload(spark, [], [])
    assert set(got) == {"stats", "publishers", "editions", "ai_status"} and got["stats"][0][2]["total"] == 0 and got["ai_status"][0][2]["index_coverage"] == 1.0


def test_lists_of_a_tenant(spark, tmp_path):
    root = str(tmp_path)
    put = lambda rows, kind, table: store_tenants(spark.createDataFrame(rows, kind), root, table)
    put([("a", 1, 10, "proposed", AT), ("a", 2, 11, "included", AT + dt.timedelta(1)), ("b", 3, 10, "proposed", AT)], "tenant_id string, cutting_id int, page_id int, status string, created_at timestamp", "cuttings")
    put([("a", 10, 100), ("a", 11, 101), ("b", 10, 100)], "tenant_id string, page_id int, edition_id int", "pages")
    put([("a", 1, True, AT), ("a", 2, False, AT), ("b", 3, True, AT)], "tenant_id string, template_id int, is_active boolean, created_at timestamp", "logo_templates")
    put([("a", 1, "proposed", AT), ("a", 2, "included", AT)], "tenant_id string, match_id int, status string, created_at timestamp", "logo_matches")
    put([("a", 1, 5, "proposed", AT), ("a", 2, 6, "proposed", AT + dt.timedelta(1)), ("a", 3, 99, "included", AT)], "tenant_id string, match_id int, post_id int, status string, created_at timestamp", "social_matches")
    mine = TenantTables(spark, root, "a")
    assert [r.cutting_id for r in mine.cuttings().collect()] == [2, 1] and [r.cutting_id for r in mine.cuttings("proposed").collect()] == [1] and [r.cutting_id for r in mine.cuttings(edition=101).collect()] == [2]
    assert [r.template_id for r in mine.logo_templates().collect()] == [1, 2] and [r.template_id for r in mine.logo_templates(active_only=True).collect()] == [1]
    assert [r.match_id for r in mine.logo_matches("included").collect()] == [2]
    posts = spark.createDataFrame([(5, 1, "x"), (6, 2, "y")], "post_id int, account_id int, text string")
    accounts = spark.createDataFrame([(1, "h")], "account_id int, handle string")
    got = [(r.match_id, r.post and r.post.text, r.post and r.post.account and r.post.account.handle) for r in mine.social_matches(posts, accounts).collect()]
    assert got == [(2, "y", None), (1, "x", "h"), (3, None, None)]


def test_threshold_of_uneven_values(spark):
    rows = [("a", float(v)) for v in range(1000)] + [("a", 1e300), ("a", None), ("b", 2.0)] + [(None, 1.0)] * 5 + [("c", 0.0)] * 500 + [("c", 1.0)]
    got = {r.k: r.threshold for r in percentile_pick(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    plain = lambda vs, share=0.72: sorted(vs)[max(0, int(share * len(vs)) - 1)]
    assert got == {k: plain([v for n, v in rows if n == k and v is not None]) for k in ("a", "b", None, "c")}
