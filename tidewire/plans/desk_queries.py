"""More queries of the catalog: scalars, gates, desk tables, upserts and reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import dates, urls, vectors
from tidewire.functions import text as tx
from tidewire.operators import dashboard, desk, gates, matching, media, merge, priority, ranking, reports, semantic, stats
from tidewire.plans import jobs
from tidewire.plans.queries import ASOF, PHRASES, articles, asof, phrases, query
from tidewire.session import load, new_folder
from tidewire.sources import report_files, tenants

# scalars


@query("""SELECT event_id, epoch_us(ts) AS at, epoch_us(ts - INTERVAL 3 HOUR) AS local_at FROM events""")
def iso_dates(spark, root):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    micros = lambda c: F.unix_micros(c)
    return load(spark, root, "events").select("event_id", micros(dates.iso(text)).alias("at"), micros(dates.local_naive(text)).alias("local_at"))


@query("""SELECT o_orderkey, epoch_us(CAST(date_trunc('day', later) AS TIMESTAMP)) AS d, epoch_us(CAST(date_trunc('day', later) AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS BIGINT)) + to_minutes(7)) AS dh,
  CASE WHEN o_orderkey % 12 = 0 THEN 12 ELSE o_orderkey % 12 + 12 END AS pm, CASE WHEN o_orderkey % 12 = 0 THEN 0 ELSE o_orderkey % 12 END AS am
FROM (SELECT *, CAST(o_orderdate AS TIMESTAMP) + to_days(10957) AS later FROM orders)""")
def shown_dates(spark, root):
    """Orders date from 1992 on and only 20xx is read, so every day is shown 30 years (10,957 days) later."""
    o = load(spark, root, "orders").withColumn("later", F.date_add("o_orderdate", 10_957))
    clock = F.format_string("on %s %02d:07!", F.date_format("later", "dd/MM/yyyy"), F.col("o_orderkey") % 24)
    half = lambda mark: dates.clock_hour(F.format_string(f"%d:05 {mark}", F.when(F.col("o_orderkey") % 12 == 0, F.lit(12)).otherwise(F.col("o_orderkey") % 12))).cast("long")
    return o.select(
        "o_orderkey", F.unix_micros(dates.year_first(F.date_format("later", "yyyy.MM.dd"))).alias("d"), F.unix_micros(dates.day_first(clock)).alias("dh"),
        half("م").alias("pm"), half("ص").alias("am"),
    )


@query(r"""SELECT doc_id, CASE WHEN length(t) > 40 THEN rtrim(substr(t, 1, 39)) || '…' ELSE t END AS clipped, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
  CASE WHEN trim(title) <> '' AND trim(body) <> '' THEN title || chr(10) || body WHEN trim(title) <> '' THEN title ELSE CASE WHEN trim(body) <> '' THEN body ELSE '' END END AS whole,
  lang || ' | ' || publisher AS q, len(regexp_replace(body, '^\s+|\s+$', '', 'g')) >= 80 OR len(regexp_replace(title, '^\s+|\s+$', '', 'g')) < 80 AS replaces
FROM (SELECT *, regexp_replace(title, '^\s+|\s+$', '', 'g') AS t FROM articles)""", True)
def text_helpers(spark, root):
    a = articles(spark, root)
    return a.select(
        "doc_id", tx.clip("title", 40).alias("clipped"), tx.xml_escape("title").alias("escaped"), tx.article_text("title", "body").alias("whole"),
        tx.query_text("lang", F.lit(" "), "publisher").alias("q"), tx.should_replace("body", "title").alias("replaces"),
    )


@query(r"""SELECT doc_id, CASE WHEN lo > 0 THEN '…' ELSE '' END || regexp_replace(substr(text, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT)), '^\s+|\s+$', '', 'g') || CASE WHEN hi < length(text) THEN '…' ELSE '' END AS shown
FROM (SELECT doc_id, text, greatest(p - 1 - 80, 0) AS lo, least(p + 3 + 80, length(text)) AS hi FROM (SELECT doc_id, text, strpos(text, 'that') AS p FROM documents WHERE strpos(text, 'that') > 0))""")
def evidence_windows(spark, root):
    d = load(spark, root, "documents").withColumn("p", F.instr("text", "that")).where("p > 0")
    return d.select("doc_id", tx.match_window(F.col("text"), F.col("p") - 1, F.col("p") + 3).alias("shown"))


@query("""SELECT event_id, '{"a":"x","k":' || (event_id % 7) || ',"z":[1,2]}' AS stable, '***' AS token, event_type AS kind, '***' AS cookie, 'mixed' AS sentiment, least(event_id / 1000.0::DOUBLE, 1.0::DOUBLE) AS importance, 'p' AS topic FROM events""")
def json_helpers(spark, root):
    e = load(spark, root, "events")
    raw = F.concat(F.lit('{"z": [1, 2], "k": '), (F.col("event_id") % 7).cast("string"), F.lit(', "a": "x"}'))
    secret = tx.redact(F.create_map(F.lit("api_token"), F.lit("abc"), F.lit("kind"), F.col("event_type")))
    headers = tx.redact_headers(F.create_map(F.lit("Set-Cookie"), F.lit("abc"), F.lit("kind"), F.col("event_type")))
    model = tx.checked_enrichment(F.concat(F.lit('```json\n{"summary": "s", "sentiment": " MIXED", "importance": '), (F.col("event_id") / 1000.0).cast("string"), F.lit(', "topics": [" p ", ""]}\n```')))
    return e.select(
        "event_id", tx.stable_json(raw).alias("stable"), secret["api_token"].alias("token"), secret["kind"].alias("kind"), headers["Set-Cookie"].alias("cookie"),
        model["sentiment"].alias("sentiment"), model["importance"].alias("importance"), model["topics"][0].alias("topic"),
    )


@query("""SELECT page_id, 'https://a.com/d/' || page_id AS relative, 'https://a.com/' || page_id AS rooted, 'https:' || '//b.com/' || page_id AS of_scheme, 2000 + page_id % 30 AS year FROM pages""")
def resolved_links(spark, root):
    base, i = F.lit("https://a.com/d/x?y"), F.col("page_id").cast("string")
    link = lambda front: urls.resolve(base, F.concat(F.lit(front), i))
    year = urls.archive_year(F.concat(F.lit("https://a.com/?yearquarter="), (2000 + F.col("page_id") % 30).cast("string"), F.lit("Q1")))
    return load(spark, root, "pages").select("page_id", link("").alias("relative"), link("/").alias("rooted"), link("//b.com/").alias("of_scheme"), year.cast("long").alias("year"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, round(CASE WHEN n = 0 THEN e[1] ELSE e[1] / n END, 6) AS first, round(0.55::DOUBLE * 0.5 + 0.45::DOUBLE * (vec_id % 10) / 10, 6) AS blended FROM v""")
def vector_helpers(spark, root):
    e = load(spark, root, "embeddings")
    return e.select("vec_id", F.round(vectors.l2_normalize("embedding")[0], 6).alias("first"), F.round(vectors.blend(F.lit(0.5), (F.col("vec_id") % 10) / 10), 6).alias("blended"))


@query("""SELECT doc_id, CASE WHEN importance >= 0.7 THEN 'high' WHEN importance >= 0.45 THEN 'medium' ELSE 'low' END AS label FROM articles""", True)
def priority_labels(spark, root):
    return articles(spark, root).select("doc_id", priority.priority_label("importance").alias("label"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS edition FROM orders")
def edition_slugs(spark, root):
    return load(spark, root, "orders").select("o_orderkey", dates.edition_date(F.date_format("o_orderdate", "dd-MM-yyyy")).alias("edition"))


# gates and desk tables


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'legal_gate_pending' WHEN user_id % 3 = 0 THEN 'connector_not_epaper' ELSE 'ok' END AS reason,
  event_type IN ('click', 'view') OR (event_type = 'purchase' AND epoch(TIMESTAMP '2024-02-10') - epoch(ts) < 900) AS suppressed, user_id % 2 = 0 AND user_id % 5 <> 0 AS valid FROM events""")
def desk_gates(spark, root):
    e, u = load(spark, root, "events"), F.col("user_id")
    legal = F.when(F.col("event_type") == "error", "pending").otherwise("approved")
    why = gates.epaper_gate(legal, F.lit(True), F.when(u % 3 == 0, "rss").otherwise("epaper"))
    status = F.when(F.col("event_type").isin("click", "view"), "running").when(F.col("event_type") == "purchase", "succeeded").otherwise("failed")
    valid = gates.valid_entity(F.when(u % 2 == 0, "brand").otherwise("planet"), F.when(u % 5 != 0, "x").otherwise(" "), F.lit(None).cast("string"))
    return e.select("event_id", why.alias("reason"), gates.refresh_suppressed(status, F.col("ts"), asof()).alias("suppressed"), valid.alias("valid"))


@query("""SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'credentials' END, CASE WHEN s_suppkey % 3 = 0 THEN 'cost_approved' END, CASE WHEN s_suppkey % 2 = 0 THEN 'X_API_BEARER_TOKEN' END], lambda x: x IS NOT NULL), ',') AS missing,
  s_suppkey % 2 <> 0 AND s_suppkey % 3 <> 0 AS live_ready FROM supplier""")
def social_gates(spark, root):
    s, yes = load(spark, root, "supplier"), F.lit(True)
    g = s.select("s_suppkey", F.lit(False).alias("credentials_available"), yes.alias("pricing_reviewed"), yes.alias("endpoints_confirmed"), yes.alias("terms_documented"), (F.col("s_suppkey") % 3 != 0).alias("cost_approved"), yes.alias("live_enabled"))
    return desk.social_gate_view(g, yes, F.col("s_suppkey") % 2 != 0).select("s_suppkey", F.array_join("missing", ",").alias("missing"), "live_ready")


@query("""SELECT s_suppkey AS platform, s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AS live_enabled, s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 AS refused, s_suppkey % 3 <> 0 AS cost_approved FROM supplier""")
def social_gate_updates(spark, root):
    s, i, yes = load(spark, root, "supplier"), F.col("s_suppkey"), F.lit(True)
    g = s.select(i.alias("platform"), yes.alias("credentials_available"), yes.alias("pricing_reviewed"), yes.alias("endpoints_confirmed"), yes.alias("terms_documented"), (i % 3 != 0).alias("cost_approved"), F.lit(False).alias("live_enabled"))
    none = F.lit(None).cast("boolean")
    c = s.select(i.alias("platform"), *[none.alias(n) for n in ("credentials_available", "pricing_reviewed", "endpoints_confirmed", "terms_documented", "cost_approved")], F.when(i % 2 == 0, True).alias("live_enabled"))
    return desk.update_social_gate(g, c, F.lit(False)).select("platform", "live_enabled", "refused", "cost_approved")


@query("""SELECT (SELECT count(*) FROM embeddings) AS embedded, (SELECT count(*) FROM articles WHERE doc_id % 3 = 0) AS enriched, (SELECT count(*) FROM labels) AS semantic, (SELECT count(*) FROM labels WHERE quality = 1) AS pending""".replace("FROM articles", "FROM documents"))
def pipeline_counts(spark, root):
    a = load(spark, root, "documents").select(F.when(F.col("doc_id") % 3 == 0, '{"ai": {"model": "m"}}').when(F.col("doc_id") % 3 == 1, '{"x": 1}').alias("metadata"))
    c = load(spark, root, "labels").select(F.when(F.col("quality") == 1, "pending_review").otherwise("included").alias("status"))
    return desk.pipeline_counts(a, load(spark, root, "embeddings"), c)


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND source <> 'src1' AND starts_with(source, 'src')")
def enrichment_pending(spark, root):
    a = load(spark, root, "documents").withColumn("metadata", F.when(F.col("doc_id") % 3 == 0, '{"ai": {"model": "m"}}').when(F.col("doc_id") % 3 == 1, '{"ai": {"model": "old"}}'))
    return desk.with_prefix(desk.of_publishers(desk.not_enriched_by(a, "m"), exclude=["src1"], code="source"), "source", "src").select("doc_id")


@query("""SELECT (SELECT count(*) FROM nation) AS publishers, (SELECT count(*) FROM supplier) AS channels, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS enabled, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS pending""")
def inventory(spark, root):
    c = load(spark, root, "supplier").withColumn("enabled", F.col("s_acctbal") > 0)
    a = load(spark, root, "orders").select(F.when(F.col("o_orderstatus") == "O", "pending_assessment").otherwise("approved_for_rss").alias("status"))
    return desk.inventory(load(spark, root, "nation"), c, a)


@query("SELECT count(*) AS editions, count(*) FILTER (WHERE o_orderstatus = 'F') AS searchable, CAST(sum(o_orderkey % 40) AS BIGINT) AS pages FROM orders")
def edition_totals(spark, root):
    o = load(spark, root, "orders").select(F.when(F.col("o_orderstatus") == "F", "ocr_done").otherwise("new").alias("status"), (F.col("o_orderkey") % 40).alias("page_count"))
    return desk.edition_totals(o)


@query("SELECT o_orderkey AS edition_id, o_orderdate AS edition_date FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 12")
def newest_editions(spark, root):
    return desk.newest_editions(load(spark, root, "orders").select(F.col("o_orderkey").alias("edition_id"), F.col("o_orderdate").alias("edition_date")))


@query("""SELECT position, points FROM (SELECT p_partkey AS position, CASE p_partkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 40 ELSE 0 END + CASE WHEN p_size > 25 THEN 20 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN -100 WHEN p_partkey % 5 = 1 THEN 10 ELSE 0 END AS points FROM part)
WHERE points > 0 ORDER BY points DESC, position LIMIT 4""")
def shortlist(spark, root):
    p, i = load(spark, root, "part"), F.col("p_partkey")
    kind = F.when(i % 4 == 0, "rss").when(i % 4 == 1, "sitemap").when(i % 4 == 2, "html").otherwise("pending")
    status = F.when(i % 5 == 0, "disabled").when(i % 5 == 1, "approved_for_rss").otherwise("pending_assessment")
    rows = p.select(i.alias("position"), kind.alias("recommended_connector"), F.when(F.col("p_size") > 25, "yes").otherwise("no").alias("robots_allows_fetch"), status.alias("status"))
    return desk.shortlist(rows).select("position", F.col("points").cast("long").alias("points"))


@query("""SELECT s_suppkey AS channel, CASE WHEN s_suppkey % 2 = 0 THEN 'approved' ELSE 'pending' END AS legal_gate, CASE WHEN s_suppkey % 3 <> 0 THEN 'new' ELSE 'old' END AS status, CASE WHEN s_suppkey % 2 <> 0 THEN 'insert' WHEN s_suppkey % 3 <> 0 THEN 'update' ELSE 'keep' END AS action
FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 <> 0""")
def assessment_upserts(spark, root):
    s, i = load(spark, root, "supplier"), F.col("s_suppkey")
    old = s.where(i % 2 == 0).select(i.alias("channel"), F.lit("approved").alias("legal_gate"), F.lit("old").alias("status"))
    return desk.assessed(old, s.where(i % 3 != 0).select(i.alias("channel"), F.lit("approved").alias("legal_gate"), F.lit("new").alias("status")))


@query("""SELECT s_suppkey AS channel, 'channel: ' || s_suppkey || chr(10) || 'name: "' || s_name || '"' || chr(10) || 'legal_gate: null' AS document FROM supplier""")
def assessment_documents(spark, root):
    return desk.assessment_document(load(spark, root, "supplier").select(F.col("s_suppkey").alias("channel"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("legal_gate")))


@query("""SELECT source AS tenant_id, sha256(text) AS content_hash, min(doc_id) AS position FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND text <> ''
  AND (source, sha256(text)) NOT IN (SELECT (source, sha256(text)) FROM documents WHERE doc_id % 7 = 0) GROUP BY ALL""")
def logo_templates(spark, root):
    d = load(spark, root, "documents").select(F.col("source").alias("tenant_id"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("position"), F.octet_length("text").alias("n_bytes"))
    offered = d.withColumns({"content_type": F.when(F.col("position") % 4 == 0, "text/html").otherwise("image/png"), "track_role": F.when(F.col("position") % 5 == 0, "mine").otherwise("own")})
    return desk.new_templates(d.where("position % 7 = 0"), offered).select("tenant_id", "content_hash", "position")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'page_render' WHEN event_id % 4 = 1 THEN 'edition_pdf' WHEN event_id % 4 = 2 THEN 'article_image' ELSE 'article_image_url_stub' END AS scanned,
  CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'remote' WHEN event_id % 5 = 0 OR event_id % 2 <> 0 THEN 'local' END AS provider FROM events""")
def scan_and_provider(spark, root):
    i, x = F.col("event_id"), F.lit("key")
    some = lambda n: F.when(i % 4 == n, x)
    provider = desk.embedding_provider(F.when(i % 2 == 0, "remote").otherwise("local"), i % 3 == 0, i % 5 == 0)
    return load(spark, root, "events").select("event_id", desk.scan_source(some(0), some(1), some(2), x).alias("scanned"), provider.alias("provider"))


@query("SELECT count(*) FILTER (WHERE l.quality IS NOT NULL) AS closed, count(*) FILTER (WHERE l.quality IS NULL) AS open, count(*) FILTER (WHERE l.quality = 1) AS enabled, coalesce(bool_and(l.quality IS NOT NULL), true) AS complete FROM documents d LEFT JOIN labels l USING (doc_id)")
def closure_summary(spark, root):
    rows = load(spark, root, "documents").join(load(spark, root, "labels"), "doc_id", "left")
    return gates.closure_summary(rows.select(F.when(F.col("quality").isNotNull(), "active").alias("disposition"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("enabled")))


@query("SELECT count(DISTINCT doc_id) AS documents, count(*) FILTER (WHERE toxic = 0) AS matches, count(*) FILTER (WHERE toxic = 1) AS excluded FROM labels")
def matching_totals(spark, root):
    return stats.matching_totals(load(spark, root, "labels").select("doc_id", (F.col("toxic") == 1).alias("excluded")))


# matching


@query(f"""WITH {PHRASES}, veto AS (SELECT item_id AS entity_id, lower(string_split(text, ' ')[6]) AS phrase FROM benchmark WHERE item_id % 3 = 0),
d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body FROM documents),
f AS (SELECT *, trim(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS ft, trim(regexp_replace(regexp_replace(lower(body), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS fb FROM d),
n AS (SELECT entity_id, surface, trim(regexp_replace(regexp_replace(lower(surface), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS fs FROM terms),
v AS (SELECT entity_id, trim(regexp_replace(regexp_replace(phrase, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS fp FROM veto),
j AS (SELECT doc_id, n.entity_id, fp IS NOT NULL AND fp <> '' AND contains(trim(ft || ' ' || fb), fp) AS excluded, contains(title, surface) OR contains(body, surface) AS e,
        contains(lower(title), lower(surface)) OR contains(lower(body), lower(surface)) AS c, fs <> '' AND (contains(ft, fs) OR contains(fb, fs)) AS a FROM f, n LEFT JOIN v ON v.entity_id = n.entity_id)
SELECT doc_id, entity_id, excluded, CASE WHEN excluded THEN NULL WHEN e THEN 'exact' WHEN c THEN 'case_insensitive_en' ELSE 'arabic_normalized' END AS match_type,
       CASE WHEN excluded THEN NULL WHEN e THEN 1.0::DOUBLE WHEN c THEN 0.99::DOUBLE ELSE 0.97::DOUBLE END AS score FROM j WHERE excluded OR e OR c OR a""")
def lexical_best(spark, root):
    """Exact, case-insensitive, normalised and veto layers: the best type of each pair. Fuzzy ones are in lexical_evidence."""
    t = phrases(spark, root).select("entity_id", F.lit(0).alias("pos"), "surface", F.lit("en").alias("language"), F.lit(True).alias("exact_only"), F.lit("canonical").alias("source"))
    bad = load(spark, root, "benchmark").where("item_id % 3 = 0").select(F.col("item_id").alias("entity_id"), F.lower(F.get(F.split("text", " "), F.lit(5))).alias("phrase"))
    return matching.match_documents(articles(spark, root), t, bad).select("doc_id", "entity_id", "excluded", "match_type", "score")


@query(f"""WITH {PHRASES}, p AS (SELECT entity_id AS query_id, doc_id AS item_id, surface AS q, split_part(text, chr(10), 1) AS t,
  row_number() OVER (PARTITION BY entity_id ORDER BY (length(text) - length(replace(lower(text), lower(surface), ''))) / length(surface) DESC, doc_id) AS rank FROM documents JOIN terms ON contains(lower(text), lower(surface))),
w AS (SELECT *, list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(q), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS qw, string_split(trim(regexp_replace(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS tw FROM p),
r AS (SELECT *, len(list_intersect(qw, tw)) / len(qw) AS o, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(qw, tw)) / len(qw) DESC, rank, item_id) AS r FROM w)
SELECT query_id, item_id, CASE WHEN r <= 10 THEN round(o, 6) END AS rerank, r <= 10 AND o < 0.1 AS pruned FROM r""")
def reranked(spark, root):
    found = matching.existence(load(spark, root, "documents"), phrases(spark, root)).select(F.col("entity_id").alias("query_id"), F.col("doc_id").alias("item_id"), F.col("surface").alias("q"), "folded_hits")
    placed = ranking.top_per_group(found, ["query_id"], [F.desc("folded_hits"), F.col("item_id")], 1 << 30)
    texts = placed.join(articles(spark, root).select(F.col("doc_id").alias("item_id"), F.col("title").alias("t")), "item_id")
    out = semantic.rerank(texts, "q", "t")
    return out.select("query_id", "item_id", F.round("rerank", 6).alias("rerank"), semantic.pruned(F.lit(0.5), F.col("rerank")).alias("pruned"))


@query("""SELECT doc_id, CASE WHEN l.quality IS NULL OR n < 0.9 THEN 'semantic_assisted' ELSE 'semantic_with_lexical' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'exact' ELSE 'semantic_assisted' END AS mirrored
FROM (SELECT doc_id, doc_id % 10 / 10.0 AS n FROM documents) d LEFT JOIN labels l USING (doc_id)""")
def inbox_types(spark, root):
    d = load(spark, root, "documents").select("doc_id").join(load(spark, root, "labels").select("doc_id", "quality"), "doc_id", "left")
    lexical = F.when(F.col("quality").isNotNull(), F.col("doc_id") % 10 / 10.0)
    return d.select("doc_id", semantic.inbox_type(lexical).alias("kind"), merge.mirror_type(F.when(F.col("doc_id") % 2 == 0, "exact").otherwise("x"), F.lit("semantic_assisted")).alias("mirrored"))


@query("""SELECT doc_id AS item_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.doc_id = d.doc_id AND c.doc_id % 3 = 0)""")
def stale_embeddings(spark, root):
    d = load(spark, root, "documents").select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("content_hash"))
    cache = d.withColumn("content_hash", F.when(F.col("item_id") % 3 == 0, F.col("content_hash")).otherwise("old"))
    return semantic.stale_embeddings(d, cache).select("item_id")


@query("SELECT n_nationkey AS tenant_id, CASE WHEN n_nationkey % 2 = 0 THEN 0.5 ELSE 0.45 END::DOUBLE AS min_cosine, CASE WHEN n_nationkey % 2 = 0 THEN 0.2 ELSE 0.1 END::DOUBLE AS min_rerank, CASE WHEN n_nationkey % 2 = 0 THEN 0.7 ELSE 0.6 END::DOUBLE AS min_confidence FROM nation")
def tenant_thresholds(spark, root):
    t = load(spark, root, "nation").select(F.col("n_nationkey").alias("tenant_id"))
    put = t.where("tenant_id % 2 = 0").select("tenant_id", F.lit(0.5).alias("min_cosine"), F.lit(0.2).alias("min_rerank"), F.lit(0.7).alias("min_confidence"))
    old = put.where("tenant_id % 4 = 0").withColumns({"min_cosine": F.lit(0.9), "min_rerank": F.lit(0.9), "min_confidence": F.lit(0.9)})
    return semantic.thresholds(t, desk.put_thresholds(old, put).drop("action"))


@query("""SELECT d.doc_id, 'relevant' AS label, 0.5::DOUBLE AS confidence, 'system' AS actor_type FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality <> 1""")
def decision_log(spark, root):
    old = load(spark, root, "labels").select("doc_id", F.when(F.col("quality") == 1, "included").otherwise("pending_review").alias("status"))
    new = load(spark, root, "documents").select("doc_id", F.lit("relevant").alias("label"), F.lit(0.5).alias("confidence"))
    return desk.decision_log(old, new, ["doc_id"])


# upserts, decisions, reads


@query("""WITH o AS (SELECT page_id, url FROM pages WHERE page_id % 2 = 0), c AS (SELECT page_id, url FROM pages WHERE page_id % 3 = 0)
SELECT coalesce(o.page_id, c.page_id) AS canonical_url, CASE WHEN c.page_id IS NULL THEN 'old' WHEN c.page_id % 9 = 0 AND o.page_id IS NOT NULL THEN 'old' WHEN c.page_id % 9 = 0 THEN NULL ELSE 'new' END AS title,
  CASE WHEN o.page_id IS NULL THEN 'insert' WHEN c.page_id IS NULL THEN 'keep' ELSE 'update' END AS action, CASE WHEN c.page_id IS NOT NULL THEN 'n' ELSE 'o' END AS seen FROM o FULL JOIN c ON o.page_id = c.page_id""")
def upsert_articles(spark, root):
    p = load(spark, root, "pages").select(F.lit("x").alias("publisher"), F.col("page_id").alias("canonical_url"))
    old = p.where("canonical_url % 2 = 0").withColumns({"title": F.lit("old"), "metadata": F.create_map(F.lit("k"), F.lit("o"))})
    new = p.where("canonical_url % 3 = 0").withColumns({"title": F.when(F.col("canonical_url") % 9 != 0, "new"), "metadata": F.create_map(F.lit("k"), F.lit("n"))})
    return merge.upsert_articles(old, new).select("canonical_url", "title", "action", F.try_element_at("metadata", F.lit("k")).alias("seen"))


@query("""WITH last AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS n FROM events WHERE event_type IN ('click', 'view'))
SELECT c_custkey, coalesce(event_type, 'pending') AS status FROM customer LEFT JOIN last ON user_id = c_custkey AND n = 1""")
def review_decisions(spark, root):
    rows = load(spark, root, "customer").select("c_custkey", F.lit("pending").alias("status"))
    d = load(spark, root, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("new_status"), F.lit("r").alias("reviewer"), F.col("ts").alias("decided_at"))
    return merge.decide(rows, d, "c_custkey", ("click", "view")).select("c_custkey", "status")


@query(f"""SELECT doc_id, publisher, page_id AS first_image FROM (SELECT * FROM articles WHERE published_at >= TIMESTAMP '{ASOF}' - INTERVAL 5 DAY ORDER BY published_at DESC, doc_id LIMIT 40) a
LEFT JOIN (SELECT page_id % 50 AS d, min(page_id) AS page_id FROM pages GROUP BY 1) i ON i.d = doc_id""", True)
def dashboard_list(spark, root):
    a = articles(spark, root).withColumns({"article_id": F.col("doc_id"), "discovered_at": F.lit(0)})
    i = load(spark, root, "pages").select((F.col("page_id") % 50).alias("article_id"), F.col("page_id").alias("created_at"), F.col("page_id").alias("image_url"))
    return jobs.dashboard(a, i, asof()).select("doc_id", "publisher", F.col("image_url").alias("first_image"))


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'")
def tenant_rows(spark, root):
    o = load(spark, root, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tenant_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return jobs.listed(o, 7, "O").select("id", "created_at")


@query("""WITH last AS (SELECT user_id, arg_max(event_type = 'purchase' OR event_type = 'click', struct_pack(t := ts, a := CAST(event_id AS VARCHAR))) AS approved, count(*) AS n FROM events GROUP BY user_id)
SELECT c_custkey AS account_id, c_name AS handle, coalesce(n, 0) AS n_decisions FROM customer LEFT JOIN last ON user_id = c_custkey WHERE coalesce(approved, c_custkey % 2 = 0) AND c_acctbal >= 0""")
def approved_accounts(spark, root):
    """Customers as accounts, active if their balance is not negative, half of them approved; every event of a user decides on the account anew."""
    c = load(spark, root, "customer").select(F.col("c_custkey").alias("account_id"), F.lit("x").alias("platform"), F.col("c_name").alias("handle"), (F.col("c_custkey") % 2 == 0).alias("is_approved"), (F.col("c_acctbal") >= 0).alias("is_active"))
    e = load(spark, root, "events")
    asked = e.select(F.col("user_id").alias("account_id"), F.col("event_type").isin("purchase", "click").alias("approved"), F.col("event_id").cast("string").alias("actor_id"), F.col("ts").alias("decided_at"))
    after, audit, _ = desk.approve_accounts(c, asked)
    counted = audit.groupBy(F.col("resource_id").cast("long").alias("account_id")).agg(F.count("*").alias("n_decisions"))
    return desk.accounts(after, approved_only=True).join(counted, "account_id", "left").select("account_id", "handle", F.coalesce("n_decisions", F.lit(0)).alias("n_decisions"))


@query("SELECT o_orderpriority AS tenant_id, o_orderkey AS id, count(l_orderkey) AS n_items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY ALL")
def tenant_partitions(spark, root):
    """Orders and their lines stored by tenant (the priority), and read back with nested lines through each tenant's own view."""
    o, folder = load(spark, root, "orders"), new_folder(spark, "tenants")
    lines = load(spark, root, "lineitem").join(o.select("o_orderkey", F.col("o_orderpriority").alias("tenant_id")), F.col("l_orderkey") == F.col("o_orderkey"))
    tenants.store_tenants(o.select(F.col("o_orderpriority").alias("tenant_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), folder, "orders")
    tenants.store_tenants(lines.select("tenant_id", F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")), folder, "lines")
    out = None
    for (tenant,) in o.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect():  # a handful
        rows = tenants.TenantTables(spark, folder, tenant).nested("orders", "lines", "id", ["line"], "lines").where("status = 'O'")
        rows = rows.select("tenant_id", "id", F.size("lines").cast("long").alias("n_items"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT o_orderkey AS edition_id, len(list(l_linenumber)) AS n_pages, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS pages FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def edition_tree(spark, root):
    e = load(spark, root, "orders").select(F.col("o_orderkey").alias("edition_id"))
    p = load(spark, root, "lineitem").select(F.col("l_orderkey").alias("edition_id"), F.col("l_linenumber").alias("page_number"), F.col("l_partkey").alias("page_id"))
    b = load(spark, root, "part").select(F.col("p_partkey").alias("page_id"), F.lit(0).alias("block_no"), F.col("p_name").alias("text"))
    t = jobs.edition_tree(e, p, b).where("pages is not null")
    return t.select("edition_id", F.size("pages").cast("long").alias("n_pages"), F.array_join(F.transform("pages", lambda x: x["page_id"].cast("string")), ",").alias("pages"))


@query("""WITH s AS (SELECT doc_id, round(0.68 * r + 0.24 * importance + 0.08 * CASE sentiment WHEN 'negative' THEN 0.2 WHEN 'mixed' THEN 0.08 ELSE 0 END, 9) AS score, r, title FROM (
  SELECT *, (CASE WHEN contains(t, 'that with') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'that') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'with') THEN 1 ELSE 0 END) / 3.0::DOUBLE AS r FROM (SELECT *, lower(title || ' ' || body) AS t FROM articles)) WHERE r > 0),
bar AS (SELECT greatest(0.68, min(score)) AS bar FROM (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM s) WHERE i > greatest(0, CAST(floor(n * 0.72) AS INTEGER) - 1))
SELECT doc_id, round(r, 6) AS relevance, score FROM (SELECT *, row_number() OVER (PARTITION BY substr(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), 1, 80) ORDER BY score DESC, doc_id) AS n FROM s, bar WHERE score >= bar) WHERE n = 1""".replace("WITH s AS", "+ s AS"), True)
def focused_ranking(spark, root):
    a = articles(spark, root).select("doc_id", "title", F.col("body").alias("text"), "importance", "sentiment", F.lit(None).cast("long").alias("cluster_id"))
    return priority.ranked(a, "That  with".replace("  ", " ")).select("doc_id", F.round("relevance", 6).alias("relevance"), "score")


@query("""SELECT o_orderkey AS edition_id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0)""")
def changed_editions(spark, root):
    o = load(spark, root, "orders").select(F.col("o_orderkey").alias("edition_id"), F.col("o_orderkey").alias("channel"), F.col("o_orderdate").alias("edition_date"), F.lit("h").alias("sha256"), (F.col("o_orderstatus") == "F").alias("ocr_done"))
    return media.edition_changed(o.where("edition_id % 2 = 0"), o.drop("ocr_done")).select("edition_id")


@query("SELECT doc_id AS page_id, length(trim(text)) < 40 AS weak, CASE WHEN length(trim(text)) >= 40 THEN 'text_layer' WHEN doc_id % 2 = 0 THEN 'remote' ELSE 'local_stub' END AS provider FROM documents")
def page_texts(spark, root):
    d = load(spark, root, "documents")
    chosen = media.page_text(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "r"), F.lit("s"))
    return d.select(F.col("doc_id").alias("page_id"), media.weak_text_layer(F.col("text")).alias("weak"), chosen["provider"].alias("provider"))


@query("""SELECT publisher AS report_id, CAST(row_number() OVER (PARTITION BY publisher ORDER BY doc_id % 4, published_at DESC NULLS LAST, doc_id) AS INTEGER) AS number, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS title FROM articles WHERE doc_id % 5 <> 0""", True)
def printed_rows(spark, root):
    from tidewire.plans.queries import _sections

    return reports.print_rows(reports.draft(*_sections(spark, root)).withColumn("included", F.lit(True))).select("report_id", "number", "title")


PRINTED = r"""
+ listed AS (SELECT doc_id, publisher AS report_id, title, lang, 'u' || doc_id AS url, row_number() OVER (PARTITION BY publisher ORDER BY doc_id % 4, published_at DESC NULLS LAST, doc_id) - 1 AS pos FROM articles WHERE doc_id % 5 <> 0),
shown AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pos) AS number FROM listed WHERE doc_id % 7 <> 0),
esc AS (SELECT *, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t FROM shown),
pieces AS (SELECT report_id, (number - 1) // 100 AS part, number, '<h3>' || number || '. ' || CASE WHEN t = '' THEN 'Untitled' ELSE t END || '</h3>' || chr(10) || '<p>' || lang || ' ' || chr(8212) || ' ' || url || '</p>' || chr(10)
    || CASE WHEN doc_id % 3 = 0 THEN '<p>Editor note: n &amp; m</p>' || chr(10) ELSE '' END AS text FROM esc
  UNION ALL SELECT DISTINCT publisher, 0, 0, '<h1>Press of ' || publisher || '</h1>' || chr(10) || '<p>Period: 2024-01-01 ' || chr(8594) || ' ' || chr(8212) || ' | Version 1 | Hash ' || substr(sha256(publisher), 1, 16) || '</p>' || chr(10)
    || CASE WHEN EXISTS (SELECT 1 FROM shown WHERE shown.report_id = publisher) THEN '' ELSE '<p>No included clippings.</p>' || chr(10) END FROM articles WHERE publisher IS NOT NULL),
files AS (SELECT report_id, part, count(*) AS n_pieces, '<!doctype html><html><head><meta charset="utf-8"></head><body>' || chr(10) || string_agg(text, '' ORDER BY number) || '</body></html>' || chr(10) AS content FROM pieces WHERE report_id IS NOT NULL GROUP BY ALL)
SELECT report_id, CAST(part AS INTEGER) AS part, n_pieces, CAST(strlen(content) AS BIGINT) AS n_bytes, sha256(content) AS sha256 FROM files"""


@query(PRINTED, True)
def report_documents(spark, root):
    """Publishers' reports printed to files and read back; a seventh of the drafted items is left out by an editor."""
    from tidewire.plans.queries import _sections

    a = articles(spark, root).where("publisher is not null")
    extra = a.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("source"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("snippet"), F.when(F.col("doc_id") % 3 == 0, "n & m").alias("note"))
    items = reports.draft(*_sections(spark, root)).join(extra, "item_id").withColumn("included", F.col("item_id") % 7 != 0)
    heads = a.select(F.col("publisher").alias("report_id")).distinct().withColumns(
        {"title": F.concat(F.lit("Press of "), "report_id"), "period_start": F.lit("2024-01-01"), "period_end": F.lit(None).cast("string"), "version": F.lit(1), "content_hash": F.sha2("report_id", 256), "notes": F.lit(None).cast("string")}
    )
    folder = new_folder(spark, "printed")
    report_files.write_reports(reports.html_pieces(heads, items, 100), folder, **reports.HTML)
    return report_files.read_reports(spark, folder).select("report_id", "part", "n_pieces", "n_bytes", "sha256")


DASHBOARD = r"""
+ a AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN upper(lang) END AS model, published_at >= TIMESTAMP '2024-02-10' - INTERVAL 5 DAY AS recent FROM articles),
counts AS (SELECT publisher, count(*) AS total, count(*) FILTER (WHERE body <> '') AS b, count(published_at) AS d, count(*) FILTER (WHERE body <> '' AND recent) AS c, count(*) FILTER (WHERE body <> '' AND published_at IS NULL) AS u, count(model) AS e FROM a GROUP BY 1),
p AS (SELECT DISTINCT publisher, row_number() OVER (ORDER BY publisher) - 1 AS position FROM (SELECT DISTINCT publisher FROM a WHERE publisher <> 'src3')),
top AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, doc_id DESC) - 1 AS position FROM (SELECT * FROM a WHERE recent AND publisher IN (SELECT publisher FROM p) ORDER BY published_at DESC, doc_id DESC LIMIT 40)),
img AS (SELECT page_id % 50 AS doc_id, min(page_id) AS cover FROM pages GROUP BY 1),
ed AS (SELECT o_orderkey, o_orderdate, o_orderstatus, publisher, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS position FROM orders JOIN p ON publisher = 'src' || (o_custkey % 7)),
run AS (SELECT * FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1)
SELECT 'stats' AS section, 0 AS position, '' AS key, CAST(json_object('total', CAST(sum(total) AS BIGINT), 'with_body', CAST(sum(b) AS BIGINT), 'with_date', CAST(sum(d) AS BIGINT), 'confirmed_in_lookback', CAST(sum(c) AS BIGINT), 'date_unknown_with_body', CAST(sum(u) AS BIGINT)) AS VARCHAR) AS payload FROM counts
UNION ALL SELECT 'articles', CAST(position AS INTEGER), CAST(doc_id AS VARCHAR), CAST(json_object('id', CAST(doc_id AS VARCHAR), 'published_at', strftime(published_at, '%Y-%m-%dT%H:%M:%S'), 'language', lang, 'has_body', body <> '', 'cover_image_url', cover, 'ai_topics', CASE WHEN model IS NULL THEN [] ELSE [lang] END, 'ai_importance', CASE WHEN model IS NOT NULL THEN 0.5 END, 'ai_model', model, 'publisher', publisher) AS VARCHAR) FROM top LEFT JOIN img USING (doc_id)
UNION ALL SELECT 'publishers', CAST(position AS INTEGER), publisher, CAST(json_object('code', publisher, 'name_en', upper(publisher), 'name_ar', NULL, 'homepage_url', NULL, 'channel_count', (SELECT count(DISTINCT lang) FROM a WHERE a.publisher = p.publisher),
  'article_stats', json_object('total', total, 'with_body', b, 'with_date', d, 'confirmed_in_lookback', c, 'date_unknown_with_body', u)) AS VARCHAR) FROM p JOIN counts USING (publisher)
UNION ALL SELECT 'editions', CAST(position AS INTEGER), CAST(o_orderkey AS VARCHAR), CAST(json_object('id', CAST(o_orderkey AS VARCHAR), 'edition_date', strftime(o_orderdate, '%Y-%m-%d'), 'title', NULL, 'status', o_orderstatus, 'source_url', NULL, 'page_count', o_orderkey % 40, 'publisher', publisher, 'name_en', upper(publisher), 'name_ar', NULL) AS VARCHAR) FROM ed WHERE position < 12
UNION ALL SELECT 'ingestion', 0, CAST(event_id AS VARCHAR), CAST(json_object('id', CAST(event_id AS VARCHAR), 'status', 'done', 'attempt_count', user_id, 'error', NULL, 'created_at', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'started_at', NULL, 'finished_at', NULL, 'result', json_object('created', user_id)) AS VARCHAR) FROM run
UNION ALL SELECT 'ai_status', 0, '', CAST(json_object('enriched', CAST(sum(e) AS BIGINT), 'embedded', (SELECT count(*) FROM embeddings), 'semantic_candidates', (SELECT count(*) FROM labels), 'pending_review', (SELECT count(*) FROM labels WHERE quality = 1),
  'index_coverage', least(1.0, round_even(CAST((SELECT count(*) FROM embeddings) AS DOUBLE) / greatest(sum(b), 1), 3))) AS VARCHAR) FROM counts"""


@query(DASHBOARD, True)
def dashboard_payload(spark, root):
    """All of the dashboard; of an article's payload the fields that are not texts, which JSON writers escape differently."""
    ai = F.struct(F.col("title").alias("summary"), F.array("lang").alias("topics"), "sentiment", F.lit(0.5).alias("importance"), F.upper("lang").alias("model"))
    a = articles(spark, root).withColumns({
        "article_id": F.col("doc_id"), "story_cluster_id": F.lit(None).cast("long"), "url": F.lit(None).cast("string"), "language": F.col("lang"), "ai": F.when(F.col("doc_id") % 3 == 0, ai),
        "discovered_at": F.timestamp_seconds("doc_id"),
    })
    none = lambda *names: {n: F.lit(None).cast("string") for n in names}
    images = load(spark, root, "pages").select((F.col("page_id") % 50).alias("article_id"), F.col("page_id").alias("created_at"), F.col("page_id").alias("image_url"))
    publishers = a.select("publisher").where("publisher <> 'src3'").distinct().withColumn("name_en", F.upper("publisher")).withColumns(none("name_ar", "homepage_url"))
    channels = a.select("publisher", F.col("lang").alias("channel")).distinct()
    o = load(spark, root, "orders")
    editions = o.select(F.col("o_orderkey").alias("edition_id"), F.concat(F.lit("src"), (F.col("o_custkey") % 7).cast("string")).alias("publisher"), F.to_date("o_orderdate").alias("edition_date"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 40).alias("page_count")).withColumns(none("title", "source_url"))
    runs = load(spark, root, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("run_id"), F.lit("ingest").alias("task"), F.lit("done").alias("status"), F.col("user_id").alias("attempt_count"), F.col("ts").alias("created_at"), F.struct(F.col("user_id").alias("created")).alias("result"))
    runs = runs.withColumns(none("error")).withColumns({c: F.lit(None).cast("timestamp") for c in ("started_at", "finished_at")})
    marks = load(spark, root, "labels").select(F.when(F.col("quality") == 1, "pending_review").otherwise("included").alias("status"))
    out = dashboard.payload(a, images, publishers, channels, editions, runs, load(spark, root, "embeddings"), marks, asof())
    short = F.from_json("payload", "id string, published_at string, language string, has_body boolean, cover_image_url long, ai_topics array<string>, ai_importance double, ai_model string, publisher string")
    return out.withColumn("payload", F.when(F.col("section") == "articles", F.to_json(short, {"ignoreNullFields": "false"})).otherwise(F.col("payload")))


LISTS = """
WITH cut AS (SELECT event_id, user_id, event_type, ts, c_mktsegment AS tenant FROM events JOIN customer ON c_custkey = user_id)
SELECT 'cuttings' AS list, tenant AS tenant_id, event_id AS id, CAST(NULL AS VARCHAR) AS nested FROM cut WHERE event_type = 'click'
UNION ALL SELECT 'edition cuttings', tenant, event_id, NULL FROM cut WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)
UNION ALL SELECT 'social', tenant, event_id, c.c_name || ' of ' || coalesce(n_name, '-') FROM cut JOIN customer c ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 WHERE event_type = 'view'"""


@query(LISTS)
def tenant_lists(spark, root):
    """Segments as tenants: events are cuttings on pages (customers) of editions (nations), and matches of posts (customers) by accounts (nations)."""
    c, folder = load(spark, root, "customer"), new_folder(spark, "lists")
    of = load(spark, root, "events").join(c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("tenant_id")), "user_id")
    tenants.store_tenants(of.select("tenant_id", F.col("event_id").alias("cutting_id"), F.col("user_id").alias("page_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at")), folder, "cuttings")
    tenants.store_tenants(of.select("tenant_id", F.col("event_id").alias("match_id"), F.col("user_id").alias("post_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at")), folder, "social_matches")
    tenants.store_tenants(c.select(F.col("c_mktsegment").alias("tenant_id"), F.col("c_custkey").alias("page_id"), F.col("c_nationkey").alias("edition_id")), folder, "pages")
    posts = c.select(F.col("c_custkey").alias("post_id"), F.col("c_nationkey").alias("account_id"), F.col("c_name").alias("text"))
    accounts = load(spark, root, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("account_id"), F.col("n_name").alias("handle"))
    out, none = None, F.lit(None).cast("string")
    for (tenant,) in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect():  # a handful
        mine = tenants.TenantTables(spark, folder, tenant)
        nested = F.concat("post.text", F.lit(" of "), F.coalesce("post.account.handle", F.lit("-")))
        parts = [("cuttings", mine.cuttings("click"), "cutting_id", none), ("edition cuttings", mine.cuttings(edition=5), "cutting_id", none), ("social", mine.social_matches(posts, accounts, "view"), "match_id", nested)]
        for name, rows, key, more in parts:
            rows = rows.select(F.lit(name).alias("list"), "tenant_id", F.col(key).alias("id"), more.alias("nested"))
            out = rows if out is None else out.unionByName(rows)
    return out
