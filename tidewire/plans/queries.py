"""Queries over the driver's tables: each operator on whole tables, and the SQL that says the same.

Documents stand for articles: the first line is the title, the rest the body, ``source`` the
publisher; publication dates are derived from ids, with gaps. Nothing reads the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import text as tx
from tidewire.functions import urls, vectors
from tidewire.operators import gates, ledger, matching, media, merge, priority, ranking, reports, semantic, stats, vector_index
from tidewire.operators.extraction import extract_articles
from tidewire.plans import jobs
from tidewire.session import load, new_folder
from tidewire.sources import blobs, connector, discovery, snapshots
from tidewire.streaming import pipeline as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ASOF = "2024-02-10 00:00:00"

ARTICLES = r"""
articles AS (
  SELECT doc_id, source AS publisher, lang, split_part(text, chr(10), 1) AS title,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body,
         CASE WHEN doc_id % 10 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 40 AS INTEGER)) END AS published_at,
         CAST(doc_id % 97 AS DOUBLE) / 96 AS importance,
         CASE doc_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'mixed' WHEN 2 THEN 'neutral' ELSE 'positive' END AS sentiment
  FROM documents)
"""


def articles(spark: SparkSession, root: str) -> DataFrame:
    d = load(spark, root, "documents")
    tones = F.array(*[F.lit(t) for t in ("negative", "mixed", "neutral", "positive")])
    at = F.when(F.col("doc_id") % 10 != 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("doc_id") % 40).cast("int")))
    body = F.when(F.instr("text", "\n") > 0, F.substr("text", F.instr("text", "\n") + 1)).otherwise(F.lit(""))
    return d.select(
        "doc_id", F.col("source").alias("publisher"), "lang", F.substring_index("text", "\n", 1).alias("title"), body.alias("body"), at.alias("published_at"),
        ((F.col("doc_id") % 97).cast("double") / 96).alias("importance"), F.get(tones, (F.col("doc_id") % 4).cast("int")).alias("sentiment"),
    )


def query(sql: str | None = None, with_articles: bool = False):
    """Registers a query under its name, and its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {ARTICLES}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}" if with_articles else sql
        return f

    return put


# lexical matching


def phrases(spark: SparkSession, root: str) -> DataFrame:
    """Monitored names: the first three words of each benchmark item."""
    b = load(spark, root, "benchmark")
    return b.select(F.col("item_id").alias("entity_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("surface"))


PHRASES = "terms AS (SELECT item_id AS entity_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS surface FROM benchmark)"


@query(f"""WITH {PHRASES}
SELECT doc_id, entity_id, surface, CAST((length(text) - length(replace(text, surface, ''))) / length(surface) AS BIGINT) AS exact_hits,
       CAST((length(text) - length(replace(lower(text), lower(surface), ''))) / length(surface) AS BIGINT) AS folded_hits
FROM documents JOIN terms ON contains(lower(text), lower(surface))""")
def lexical_existence(spark, root):
    return matching.existence(load(spark, root, "documents"), phrases(spark, root))


@query()
def lexical_evidence(spark, root):
    """All layers: names with fuzzy ones, aliases that must be exact, and exclusions. test_matching compares it with a plain loop."""
    words = load(spark, root, "benchmark").select(F.col("item_id").alias("entity_id"), F.split("text", " ").alias("w"))
    names = words.select("entity_id", F.array_join(F.slice("w", 1, 3), " ").alias("name_en"), F.lit(None).cast("string").alias("name_ar"))
    aliases = words.select("entity_id", F.lit(0).alias("pos"), F.array_join(F.slice("w", 7, 2), " ").alias("alias_text"), F.lit("en").alias("language"), F.lit(True).alias("exact_only"))
    bad = words.where("entity_id % 3 = 0").select("entity_id", F.lower(F.get("w", F.lit(5))).alias("phrase"))
    return matching.match_documents(articles(spark, root), matching.entity_terms(names, aliases), bad)


@query(f"""WITH {PHRASES}, hits AS (SELECT entity_id, doc_id FROM documents JOIN terms ON contains(text, surface))
SELECT entity_id, count(*) AS n_documents, min(doc_id) AS first_document FROM hits GROUP BY entity_id""")
def mentions_per_entity(spark, root):
    found = matching.existence(load(spark, root, "documents"), phrases(spark, root)).where("exact_hits > 0")
    return found.groupBy("entity_id").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_document"))


# scalars


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS folded FROM documents""")
def normalized_text(spark, root):
    return load(spark, root, "documents").select("doc_id", F.sha2(tx.normalize_text("text"), 256).alias("folded"))


@query(r"""WITH u AS (SELECT page_id, replace(trim(url), '&amp;', '&') AS url FROM pages),
p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
             regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM u),
k AS (SELECT page_id, string_agg(kv, '&' ORDER BY kv) AS kept FROM (
        SELECT page_id, CASE WHEN lower(split_part(x, '=', 1)) = 'language' THEN lower(x) ELSE 'id=' || substr(x, strpos(x, '=') + 1) END AS kv
        FROM (SELECT page_id, unnest(string_split(query, '&')) AS x FROM p) WHERE lower(split_part(x, '=', 1)) IN ('id', 'language')) GROUP BY page_id)
SELECT p.page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || coalesce('?' || kept, '') AS canonical FROM p LEFT JOIN k USING (page_id)""")
def canonical_urls(spark, root):
    return load(spark, root, "pages").select("page_id", urls.canonical_url("url").alias("canonical"))


@query("SELECT doc_id, sha256(title || chr(10) || body) AS content_hash FROM articles", True)
def content_hashes(spark, root):
    return articles(spark, root).select("doc_id", tx.content_hash(F.col("title"), F.col("body")).alias("content_hash"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 220 THEN rtrim(substr(t, 1, 219)) || '…' ELSE t END AS snippet
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def snippets(spark, root):
    return load(spark, root, "documents").select("doc_id", tx.snippet("text").alias("snippet"))


@query(r"SELECT doc_id, length(regexp_replace(body, '^\s+|\s+$', '', 'g')) >= 80 AS ok, length(regexp_replace(body, '^\s+|\s+$', '', 'g')) = 0 AS junk FROM articles", True)
def body_quality(spark, root):
    return articles(spark, root).select("doc_id", tx.body_ok("body").alias("ok"), tx.is_junk_body("body").alias("junk"))


@query("""SELECT page_id, regexp_extract(url, '/article/([0-9]+)', 1) <> '' AS is_article, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) IN ('http', 'https')
  AND regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') = 'example.com' AS same_site FROM pages""")
def url_predicates(spark, root):
    return load(spark, root, "pages").select("page_id", urls.site_article_id("url").isNotNull().alias("is_article"), F.coalesce(urls.same_site(F.lit("https://www.example.com/"), "url"), F.lit(False)).alias("same_site"))


# aggregates and joins

MEASURES = """count(*) AS total, count(*) FILTER (WHERE body <> '') AS with_body, count(published_at) AS with_date,
  count(*) FILTER (WHERE body <> '' AND published_at >= TIMESTAMP '2024-02-05') AS confirmed_in_lookback,
  count(*) FILTER (WHERE body <> '' AND published_at IS NULL) AS date_unknown_with_body"""


def asof():
    return F.lit(ASOF).cast("timestamp")


@query(f"SELECT {MEASURES} FROM articles", True)
def article_stats(spark, root):
    return stats.article_stats(articles(spark, root), asof())


@query(f"SELECT publisher, {MEASURES} FROM articles GROUP BY publisher", True)
def article_stats_by_publisher(spark, root):
    return stats.article_stats(articles(spark, root), asof(), by="publisher")


@query("SELECT n_nationkey AS publisher_id, count(s_suppkey) AS n_channels FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def channels_per_publisher(spark, root):
    p = load(spark, root, "nation").select(F.col("n_nationkey").alias("publisher_id"))
    c = load(spark, root, "supplier").select(F.col("s_nationkey").alias("publisher_id"), F.col("s_suppkey").alias("channel_id"))
    return stats.channels_per_publisher(p, c)


@query("""SELECT publisher, least(1.0, round_even(count(*) FILTER (WHERE doc_id % 3 = 0) / greatest(count(*) FILTER (WHERE body <> ''), 1), 3)) AS coverage
FROM articles GROUP BY publisher""", True)
def index_coverage(spark, root):
    a = articles(spark, root).groupBy("publisher").agg(F.count_if(F.col("doc_id") % 3 == 0).alias("e"), F.count_if(F.col("body") != "").alias("b"))
    return a.select("publisher", stats.index_coverage(F.col("e"), F.col("b")).alias("coverage"))


@query("SELECT o_custkey AS parent, count(*) + 1 AS next_version FROM orders GROUP BY o_custkey")
def next_versions(spark, root):
    numbered = ranking.number_versions(load(spark, root, "orders").select(F.col("o_custkey").alias("parent"), "o_orderkey"), spark.createDataFrame([], "parent long, version int"), "parent", ["o_orderkey"])
    return stats.next_version(numbered, "parent").select("parent", F.col("next_version").cast("long").alias("next_version"))


@query("SELECT user_id AS channel, least(5, count(*)) AS recent_failure_count FROM events WHERE event_type = 'error' GROUP BY user_id")
def recent_failures(spark, root):
    e = load(spark, root, "events").where("event_type = 'error'").select(F.col("user_id").alias("channel"))
    return stats.recent_failures(e, "channel")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_run_per_channel(spark, root):
    return ranking.latest_by(load(spark, root, "events"), ["user_id"], F.col("ts"), ["event_id", "event_type"])


@query("SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events WHERE event_type = 'error') WHERE rank <= 5")
def newest_failures(spark, root):
    e = load(spark, root, "events").where("event_type = 'error'")
    return ranking.top_per_group(e, ["user_id"], [F.desc("ts"), F.col("event_id")], 5).select("user_id", "event_id", "rank")


@query("""SELECT o_orderkey, o_orderdate, l_partkey AS first_part FROM orders LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) l ON l_orderkey = o_orderkey AND n = 1""")
def first_image(spark, root):
    first = load(spark, root, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("first_part"))
    o = load(spark, root, "orders").select("o_orderkey", "o_orderdate")
    return o.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderdate", "first_part")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def without_image(spark, root):
    return load(spark, root, "documents").join(load(spark, root, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def in_subquery(spark, root):
    n = load(spark, root, "nation").where("n_regionkey = 1")
    return load(spark, root, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_name")


@query("SELECT d.doc_id, d.publisher, l.quality FROM articles d LEFT JOIN labels l USING (doc_id)", True)
def inbox_lookup(spark, root):
    return articles(spark, root).join(load(spark, root, "labels"), "doc_id", "left").select("doc_id", "publisher", "quality")


@query("SELECT conv_id, string_agg(role || ':' || CAST(length(text) AS VARCHAR), ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def nested_children(spark, root):
    c = load(spark, root, "conversations").select("conv_id", F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("t")).alias("s"))
    packed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("l"))
    return packed.select("conv_id", F.array_join(F.transform("l", lambda s: s["t"]), ",").alias("turns"))


@query("SELECT d.publisher, count(*) AS n FROM articles d JOIN (SELECT DISTINCT publisher FROM articles WHERE published_at IS NULL) p USING (publisher) GROUP BY d.publisher", True)
def publisher_join(spark, root):
    a = articles(spark, root)
    p = a.where("published_at is null").select("publisher").distinct()
    return a.join(p, "publisher").groupBy("publisher").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE p AND q) AS tp, count(*) FILTER (WHERE p AND NOT q) AS fp, count(*) FILTER (WHERE NOT p AND q) AS fn, count(*) FILTER (WHERE NOT p AND NOT q) AS tn FROM (SELECT quality = 1 AS q, n_chars >= 80 AS p FROM labels JOIN documents USING (doc_id))")
def confusion(spark, root):
    rows = load(spark, root, "labels").join(load(spark, root, "documents").select("doc_id", "n_chars"), "doc_id")
    return stats.confusion(rows, F.col("n_chars") >= 80, F.col("quality") == 1)


@query("""SELECT sentiment AS tone, count(*) AS n, CAST(floor(count(*) * 100.0 / sum(count(*)) OVER () + 0.5) AS BIGINT) AS percent,
  row_number() OVER (ORDER BY count(*) DESC, sentiment) = 1 AS dominant FROM articles WHERE body <> '' GROUP BY sentiment""", True)
def tone_shares(spark, root):
    return stats.tone_shares(articles(spark, root).withColumn("summary", F.col("body")))


@query("SELECT topic, count(*) AS n FROM (SELECT unnest(string_split(title, ' ')) AS topic FROM articles) GROUP BY topic ORDER BY n DESC, topic LIMIT 5", True)
def top_topics(spark, root):
    return stats.top_topics(articles(spark, root).withColumn("topics", F.split("title", " ")))


@query("""WITH kinds(disposition) AS (VALUES ('F'), ('O'), ('P'), ('X'), ('unset'))
SELECT disposition, coalesce(n, 0) AS n FROM kinds LEFT JOIN (SELECT coalesce(o_orderstatus, 'unset') AS disposition, count(*) AS n FROM orders GROUP BY 1) USING (disposition)""")
def disposition_histogram(spark, root):
    kinds = spark.createDataFrame([("F",), ("O",), ("P",), ("X",), ("unset",)], "disposition string")
    return gates.disposition_histogram(load(spark, root, "orders").withColumnRenamed("o_orderstatus", "disposition"), kinds)


@query("""SELECT count(*) FILTER (WHERE event_type <> 'error') AS channels_ok, count(*) FILTER (WHERE event_type = 'error') AS channels_failed,
  CAST(sum(user_id) FILTER (WHERE event_type <> 'error') AS BIGINT) AS discovered, CAST(sum(event_id) FILTER (WHERE event_type <> 'error') AS BIGINT) AS created FROM events""")
def discovery_totals(spark, root):
    e = load(spark, root, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("user_id").alias("discovered"), F.col("event_id").alias("created"))
    return stats.discovery_totals(e)


# ranking, limits, sets


@query("SELECT doc_id, publisher, published_at FROM articles ORDER BY published_at DESC NULLS LAST, doc_id LIMIT 40", True)
def dashboard_top(spark, root):
    return articles(spark, root).select("doc_id", "publisher", "published_at").orderBy(F.desc_nulls_last("published_at"), "doc_id").limit(40)


@query("SELECT doc_id FROM (SELECT * FROM articles ORDER BY importance DESC, doc_id LIMIT 160) WHERE sentiment = 'mixed' ORDER BY importance DESC, doc_id LIMIT 40", True)
def limited_then_filtered(spark, root):
    return ranking.limited_then_filtered(articles(spark, root), [F.desc("importance"), F.col("doc_id")], 160, F.col("sentiment") == "mixed", 40).select("doc_id")


@query("""SELECT publisher, threshold FROM (SELECT publisher, importance AS threshold, row_number() OVER (PARTITION BY publisher ORDER BY importance) AS i,
  count(*) OVER (PARTITION BY publisher) AS n FROM articles) WHERE i = greatest(0, CAST(floor(n * 0.72) AS INTEGER) - 1) + 1""", True)
def percentile_threshold(spark, root):
    return ranking.percentile_pick(articles(spark, root), "publisher", "importance")


@query(r"""SELECT sha256(trim(regexp_replace(regexp_replace(lower(trim(title)), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS fingerprint,
  substr(arg_min(title, doc_id), 1, 512) AS representative, count(*) AS size, min(doc_id) AS first_id FROM articles GROUP BY 1""", True)
def story_clusters(spark, root):
    return ranking.story_clusters(articles(spark, root), tx.title_fingerprint("title"), "doc_id", "title")


@query("""SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def set_differences(spark, root):
    return ranking.set_differences(load(spark, root, "documents"), load(spark, root, "labels"), "doc_id")


@query("SELECT url, page_id FROM (SELECT url, page_id, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def first_seen_urls(spark, root):
    return ranking.first_seen(load(spark, root, "pages"), F.col("url"), [F.col("page_id")]).select("url", "page_id")


# semantic


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0), pairs AS (
  SELECT query_id, vec_id AS item_id, list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))) AS s
  FROM embeddings, q WHERE vec_id <> query_id)
SELECT query_id, item_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM pairs WHERE s >= 0.1) WHERE rank <= 20""")
def cosine_top_k(spark, root):
    e = load(spark, root, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = semantic.cosine_top_k(q, e.withColumnRenamed("vec_id", "item_id"), 21, 0.1).where("query_id <> item_id")
    again = ranking.top_per_group(found.drop("rank"), ["query_id"], [F.desc("similarity"), F.col("item_id")], 20)
    return again.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"), "rank")


@query()
def indexed_top_k(spark, root):
    """As cosine_top_k by the cell index; test_vector_index measures its recall."""
    e = load(spark, root, "embeddings").withColumnRenamed("vec_id", "item_id")
    q = e.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    found = vector_index.indexed_top_k(q, e, vector_index.fit(e, 32), 24, 21, 0.1).where("query_id <> item_id")
    again = ranking.top_per_group(found.drop("rank"), ["query_id"], [F.desc("similarity"), F.col("item_id")], 20)
    return again.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(r"""WITH words AS (SELECT page_id, unnest(CASE WHEN len(w) = 0 THEN ['empty'] ELSE w END) AS word FROM (SELECT page_id, regexp_extract_all(lower(coalesce(url, '')), '[\p{L}\p{N}_]+') AS w FROM pages)),
slots AS (SELECT page_id, CAST(('0x' || substr(sha256(word), 1, 8))::BIGINT % 1024 AS INTEGER) AS slot, CASE WHEN ('0x' || substr(sha256(word), 9, 2))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END AS v FROM words)
SELECT page_id, slot, CAST(sum(v) AS DOUBLE) AS value FROM slots GROUP BY page_id, slot HAVING sum(v) <> 0""")
def hash_embedding_slots(spark, root):
    return vectors.hash_slots(load(spark, root, "pages"), "page_id", "url")


RULES = """SELECT vec_id, round(0.35 * c + 0.25 * coalesce(r, 0) + 0.4 * least(l, 1), 6) AS score,
  CASE WHEN l >= 0.96 AND c >= 0.4 OR (0.35 * c + 0.25 * coalesce(r, 0) + 0.4 * least(l, 1) >= 0.75 AND l >= 0.5) THEN 'relevant'
       WHEN 0.35 * c + 0.25 * coalesce(r, 0) + 0.4 * least(l, 1) < 0.35 AND l < 0.2 THEN 'not_relevant' ELSE 'needs_review' END AS label
FROM (SELECT vec_id, (vec_id % 10) / 10.0 AS c, CASE WHEN vec_id % 3 > 0 THEN (vec_id % 7) / 7.0 END AS r, (vec_id % 5) / 4.0 AS l FROM embeddings)"""


@query(RULES)
def relevance_rules(spark, root):
    e = load(spark, root, "embeddings")
    c, r, lex = (F.col("vec_id") % 10) / 10.0, F.when(F.col("vec_id") % 3 > 0, (F.col("vec_id") % 7) / 7.0), (F.col("vec_id") % 5) / 4.0
    d = semantic.relevance(c, r, lex)
    return e.select("vec_id", F.round(d["score"], 6).alias("score"), d["label"].alias("label"))


@query(f"""WITH {PHRASES}, {ARTICLES}, hits AS (SELECT entity_id, doc_id, surface, title FROM articles JOIN terms ON contains(lower(title || chr(10) || body), lower(surface)))
SELECT entity_id, doc_id, round(len(list_intersect(q, t)) / len(q), 6) AS overlap FROM (
  SELECT entity_id, doc_id, list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(surface), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS q,
         string_split(trim(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS t FROM hits)""")
def overlap_rerank(spark, root):
    found = matching.existence(load(spark, root, "documents"), phrases(spark, root))
    joined = found.join(articles(spark, root).select("doc_id", "title"), "doc_id")
    return joined.select("entity_id", "doc_id", F.round(semantic.overlap(F.col("surface"), F.col("title")), 6).alias("overlap"))


# priority

SCORED = """scored AS (SELECT doc_id, title, round(0.8 * importance + CASE sentiment WHEN 'negative' THEN 0.2 WHEN 'mixed' THEN 0.08 ELSE 0 END, 9) AS score FROM articles),
bar AS (SELECT greatest(0.3, min(score)) AS bar FROM (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM scored) WHERE i > greatest(0, CAST(floor(n * 0.72) AS INTEGER) - 1))"""


@query(f"""+ {SCORED}
SELECT doc_id, score FROM (SELECT doc_id, score, row_number() OVER (PARTITION BY substr(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), 1, 80) ORDER BY score DESC, doc_id) AS n FROM scored, bar WHERE score >= bar) WHERE n = 1""", True)
def priority_ranking(spark, root):
    a = articles(spark, root).select("doc_id", "title", F.col("body").alias("text"), "importance", "sentiment", F.lit(None).cast("long").alias("cluster_id"))
    return priority.ranked(a, "").select("doc_id", "score")


@query("SELECT doc_id FROM articles WHERE lang = 'en' AND (contains(lower(title), 'than') OR contains(lower(body), 'than'))", True)
def search(spark, root):
    a = articles(spark, root).select("doc_id", "title", F.col("lang").alias("language"), F.col("publisher"), F.col("body").alias("summary"), F.lit("").alias("snippet"))
    return priority.search(a, "than", language="en").select("doc_id")


@query("SELECT doc_id FROM articles WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", True)
def saved(spark, root):
    return priority.saved(articles(spark, root), load(spark, root, "labels").where("quality = 1")).select("doc_id")


# gates, state, reports, media


@query("""SELECT event_id, CASE WHEN event_type IS NULL THEN 'missing_assessment' WHEN event_type = 'error' THEN 'legal_gate_pending' WHEN user_id % 2 = 0 THEN 'connector_disabled' ELSE 'ok' END AS reason FROM events""")
def ingestion_gate(spark, root):
    legal = F.when(F.col("event_type") == "error", "pending").when(F.col("event_type").isNotNull(), "approved")
    return load(spark, root, "events").select("event_id", gates.ingestion_gate(legal, F.col("user_id") % 2 != 0, F.lit("rss")).alias("reason"))


@query("SELECT doc_id FROM articles WHERE NOT coalesce(published_at < TIMESTAMP '2024-02-01', false)", True)
def stale_dropped(spark, root):
    return articles(spark, root).where(discovery.not_stale(F.col("published_at"), F.lit("2024-02-01").cast("timestamp"))).select("doc_id")


@query("SELECT event_id, user_id FROM events WHERE json_exists(props, '$.k')")
def json_key_exists(spark, root):
    e = load(spark, root, "events")
    return e.where(F.array_contains(F.json_object_keys("props"), "k")).select("event_id", "user_id")


@query("""WITH jobs AS (SELECT event_id, event_type, ts, epoch(TIMESTAMP '2024-01-15' - ts) / 60 AS age FROM events)
SELECT event_id, event_type IN ('click', 'view') AND (age >= 40 OR age >= 15) AS lost FROM jobs""")
def jobs_interrupted(spark, root):
    e = load(spark, root, "events")
    status = F.when(F.col("event_type").isin("click", "view"), "running").otherwise("succeeded")
    lost = gates.job_interrupted(status, F.lit(None).cast("string"), F.col("ts"), F.col("ts"), F.lit(None).cast("string"), F.lit("2024-01-15").cast("timestamp"))
    return e.select("event_id", lost.alias("lost"))


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending_review' WHEN l.quality = 1 THEN 'included' ELSE 'pending_review' END AS status,
  CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 0.5 ELSE d.score END AS score, CASE WHEN l.doc_id IS NULL THEN 'insert' WHEN l.quality = 1 THEN 'keep' ELSE 'update' END AS action
FROM (SELECT doc_id, CAST(doc_id % 10 AS DOUBLE) / 10 AS score FROM documents) d LEFT JOIN labels l USING (doc_id)""")
def upsert_matches(spark, root):
    old = load(spark, root, "labels").select("doc_id", F.when(F.col("quality") == 1, "included").otherwise("pending_review").alias("status"), F.lit(0.5).alias("score"))
    new = load(spark, root, "documents").select("doc_id", F.lit("pending_review").alias("status"), ((F.col("doc_id") % 10).cast("double") / 10).alias("score"))
    return merge.upsert_matches(old, new, ["doc_id"])


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN 'user' ELSE 'system' END AS actor_type FROM events")
def audit_rows(spark, root):
    e = load(spark, root, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("actor_id"))
    return merge.audit(e).select("event_id", "actor_type")


def _sections(spark, root):
    base = articles(spark, root).select(F.col("publisher").alias("report_id"), F.col("doc_id").alias("item_id"), "title", F.when(F.col("doc_id") % 5 != 0, "included").otherwise("excluded").alias("status"), F.col("published_at").alias("reviewed_at"), F.lit(ASOF).cast("timestamp").alias("created_at"))
    return [base.where(F.pmod("item_id", F.lit(4)) == i) for i in range(4)]


DRAFT = """SELECT publisher AS report_id, doc_id AS item_id, CAST(row_number() OVER (PARTITION BY publisher ORDER BY doc_id % 4, published_at DESC NULLS LAST, doc_id) - 1 AS INTEGER) AS sort_order FROM articles WHERE doc_id % 5 <> 0"""


@query(DRAFT, True)
def report_draft(spark, root):
    return reports.draft(*_sections(spark, root)).select("report_id", "item_id", "sort_order")


@query()
def report_snapshot(spark, root):
    return reports.snapshot(reports.draft(*_sections(spark, root)).withColumn("included", F.lit(True)))


@query("""WITH t AS (SELECT DISTINCT source AS template_id, translate(sha256(source), '0123456789abcdef', '0000000011111111') AS fp FROM documents),
g AS (SELECT page_id, translate(sha256(url), '0123456789abcdef', '0000000011111111') AS img FROM pages),
p AS (SELECT page_id, template_id, len(list_filter(range(1, 65), lambda i: substr(img, i, 1) = substr(fp, i, 1))) / 64 AS s FROM g, t)
SELECT page_id AS image_id, template_id, round(least(0.99, 0.4 + 0.6 * s), 6) AS confidence, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY least(0.99, 0.4 + 0.6 * s) DESC, template_id) AS rank FROM p WHERE s >= 0.35) WHERE rank <= 20""")
def logo_candidates(spark, root):
    coarse = lambda c: F.translate(F.sha2(c, 256), "0123456789abcdef", "0" * 8 + "1" * 8)
    t = load(spark, root, "documents").select(F.col("source").alias("template_id")).distinct().withColumns({"fingerprint": coarse("template_id"), "min_confidence": F.lit(0.5)})
    images = load(spark, root, "pages").select(F.col("page_id").alias("image_id"), coarse("url").alias("fingerprint"), F.length("html").alias("n_bytes"))
    return media.logo_cascade(t, images).select("image_id", "template_id", F.round("confidence", 6).alias("confidence"), "rank")


@query(r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS block_no, lines[i] AS text, least(0.95, (i - 1) / len(lines)) AS bbox_y, greatest(0.02, 0.9 / len(lines)) AS bbox_h FROM (
  SELECT page_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id AS page_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents))""")
def text_blocks(spark, root):
    return media.text_blocks(load(spark, root, "documents").select(F.col("doc_id").alias("page_id"), "text"))


@query("SELECT conv_id AS post_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n = 1")
def deduped_posts(spark, root):
    c = load(spark, root, "conversations").where("role = 'user'").select(F.lit("x").alias("platform"), F.col("conv_id").alias("external_id"), F.col("turn").alias("posted_at"), F.col("turn").alias("post_id"))
    return media.dedupe_posts(c).select(F.col("external_id").alias("post_id"), F.col("posted_at").alias("turn"))


# sources and streams


@query()
def extracted_articles(spark, root):
    return extract_articles(load(spark, root, "pages"), 2024)


@query()
def listing_links(spark, root):
    p = load(spark, root, "pages").select(F.col("page_id").cast("string").alias("channel"), "url", F.col("html").alias("content"))
    return discovery.listing(p)


@query("""+ dated AS (SELECT *, publisher || '-' || CAST(doc_id // 200 AS VARCHAR) AS channel FROM articles)
SELECT channel, 'https://news.example.com/' || doc_id AS source_url, trim(title) AS title, epoch_us(published_at) AS at FROM dated
WHERE NOT coalesce(published_at < TIMESTAMP '2024-01-11', false) AND channel <> publisher || '-0'""", True)
def connector_feeds(spark, root):
    """All articles as feeds of up to 200 items, stored as document sets and read by the connector source, stale items left out."""
    a = articles(spark, root).withColumn("channel", F.concat_ws("-", "publisher", F.floor(F.col("doc_id") / 200).cast("string")))
    day = F.coalesce(F.concat(F.lit("<pubDate>"), F.date_format("published_at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>")), F.lit(""))
    # XML has no form feeds and the like
    title = tx.xml_escape(F.regexp_replace("title", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>https://news.example.com/"), F.col("doc_id").cast("string"), F.lit("</link>"), day, F.lit("</item>"))
    feeds = a.groupBy("channel").agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("i"))
    content = F.concat(F.lit('<rss version="2.0"><channel>'), F.col("i"), F.lit("</channel></rss>"))
    folder = new_folder(spark, "feeds")
    connector.store_documents(feeds.select(F.lit("rss").alias("connector"), "channel", F.lit("https://news.example.com/feed").alias("url"), content.alias("content")), folder)
    connector.register(spark)
    found = spark.read.format(connector.FORMAT).option("connector", "rss").option("cutoff", "2024-01-11").load(folder)
    return found.where(~F.endswith("channel", F.lit("-0"))).select("channel", "source_url", "title", F.unix_micros("published_at").alias("at"))


@query("""SELECT channel, edition_date, 'https://pdf.example.com/pdf/' || strftime(edition_date, '%Y/%m/%d-%m-%Y/%d-%m-%Y') || '.pdf' AS source_url
FROM (SELECT n_name AS channel, CAST(unnest(generate_series(DATE '2024-02-03', DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS edition_date FROM nation)""")
def edition_candidates(spark, root):
    c = load(spark, root, "nation").select(F.col("n_name").alias("channel"), F.lit("https://pdf.example.com").alias("host"))
    return discovery.edition_candidates(c, F.lit("2024-02-10").cast("date"), 7)


@query("""SELECT sha256(html) AS digest, CAST(max(strlen(html)) AS BIGINT) AS n_bytes, 1 AS n_blobs, 2 * count(*) AS n_keys, max(page_id) AS newest FROM pages WHERE html IS NOT NULL GROUP BY 1""")
def stored_pages(spark, root):
    """All pages put into the object store twice, under two keys each: one blob for each content."""
    pages = load(spark, root, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    store = blobs.BlobStore(spark, new_folder(spark, "objects"))
    for kind in ("raw", "again"):
        store.put(pages.select(F.format_string(f"{kind}/%012d.html", "page_id").alias("key"), "content"))
    held = store.blobs().groupBy("digest").agg(F.count("*").cast("int").alias("n_blobs"))
    named = store.names().groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.count("*").alias("n_keys"), F.max(F.regexp_extract("key", r"(\d+)", 1).cast("long")).alias("newest"))
    return held.join(named, "digest", "full_outer").select("digest", "n_bytes", "n_blobs", "n_keys", "newest")


@query(r"""+ found AS (SELECT * FROM articles WHERE publisher IS NOT NULL AND NOT coalesce(published_at < TIMESTAMP '2024-01-06', false)),
fetched AS (SELECT *, length(regexp_replace(body, '^\s+|\s+$', '', 'g')) >= 80 AS ok FROM found)
SELECT publisher, count(*) AS n_found, count(*) FILTER (ok) AS n_bodies, CAST(sum(length(body)) FILTER (ok) AS BIGINT) AS n_chars FROM fetched GROUP BY publisher""", True)
def lookback_run(spark, root):
    """Discover, fetch and sum up all articles by publisher, first in a run that loses one publisher, then in one that goes on from there."""
    a = articles(spark, root).select("publisher", "doc_id", "title", "body", "published_at")

    def stages(lost=None):
        body = F.when(F.col("publisher") == lost, F.raise_error(F.lit("no answer")).cast("string")).otherwise(F.col("body")) if lost else F.col("body")
        ok = tx.body_ok("body")
        sums = [F.count("*").alias("n_found"), F.count(F.when(ok, 1)).alias("n_bodies"), F.sum(F.when(ok, F.length("body"))).alias("n_chars")]
        return [
            ledger.Stage("discover", lambda rows: rows.where(discovery.not_stale(F.col("published_at"), F.lit("2024-01-06").cast("timestamp")))),
            ledger.Stage("fetch", lambda rows: rows.select("publisher", "doc_id", body.alias("body"))),
            ledger.Stage("stats", lambda rows: rows.groupBy("publisher").agg(*sums)),
        ]

    book = ledger.RunLedger(spark, new_folder(spark, "runs"))
    first = a.agg(F.min("publisher")).first()[0]
    ledger.run_all(book, "first", stages(first), a)
    return ledger.run_all(book, "second", stages(), a).rows.select("publisher", "n_found", "n_bodies", "n_chars")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS channel, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS sha256, count(l_orderkey) AS n_pages, coalesce(CAST(sum(l_linenumber) AS BIGINT), 0) AS sum_pages
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND (o_orderkey % 3 <> 0 OR l_linenumber % 2 = 1) GROUP BY o_orderkey""")
def edition_ingest(spark, root):
    """Orders as printed editions and their lines as pages, stored twice: a third comes back as another file with fewer pages, the rest unchanged."""
    o, lines = load(spark, root, "orders"), load(spark, root, "lineitem")
    day = F.lit("2024-02-10").alias("edition_date")
    edition = lambda sha: o.select(F.col("o_orderkey").cast("string").alias("channel"), day, sha.alias("sha256"), F.lit(True).alias("ocr_done"))
    pages = lines.select(F.col("l_orderkey").cast("string").alias("channel"), day, F.col("l_linenumber").cast("int").alias("page"))
    store = snapshots.SnapshotStore(spark, new_folder(spark, "editions"), 16)
    snapshots.ingest_editions(store, edition(F.lit("first")), pages)
    snapshots.ingest_editions(store, edition(F.when(F.col("o_orderkey") % 3 == 0, "second").otherwise("first")), pages.where("page % 2 = 1"))
    of = store.read("pages").groupBy("channel").agg(F.count("*").alias("n_pages"), F.sum("page").alias("sum_pages"))
    joined = store.read("editions").join(of, "channel", "left")
    return joined.select("channel", "sha256", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("sum_pages", F.lit(0)).alias("sum_pages"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM events GROUP BY ALL""")
def hourly_counts(spark, root):
    return streams.windowed_counts(load(spark, root, "events"), "ts", ["event_type"])


@query("""SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, session""")
def sessions(spark, root):
    """An extension: bursts of a user's events, 30 minutes apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double")
    e = load(spark, root, "events").withColumn("new", F.when(gap.isNull() | (gap > 1800), 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("session")


@query("""WITH latest AS (SELECT user_id AS channel, event_id AS last_run, event_type AS last_status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1),
failed AS (SELECT user_id AS channel, least(5, count(*)) AS n FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT channel, last_run, last_status, coalesce(n, 0) AS recent_failure_count FROM latest LEFT JOIN failed USING (channel)""")
def source_health(spark, root):
    e = load(spark, root, "events").withColumnsRenamed({"user_id": "channel", "event_id": "run_id", "event_type": "status", "ts": "at"})
    return jobs.source_health(e.select("channel").distinct(), e, e.where("status = 'error'").select("channel"))


@query("SELECT conv_id AS post_id, turn AS posted_at FROM (SELECT conv_id * 100 + turn AS k, * FROM conversations) ORDER BY turn DESC, conv_id DESC LIMIT 500")
def newest_posts(spark, root):
    c = load(spark, root, "conversations").select(F.col("conv_id").alias("post_id"), F.col("turn").alias("posted_at"))
    return media.newest_posts(c)


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'explicitly_skipped' WHEN doc_id % 7 = 1 THEN 'awaiting_licensing' WHEN doc_id % 7 = 2 THEN 'blocked' WHEN lang = 'es' THEN 'connector_not_scrapeable' ELSE 'enabled' END AS reason FROM documents""")
def enablement_reasons(spark, root):
    d = load(spark, root, "documents")
    kind = F.when(F.col("doc_id") % 7 == 1, "awaiting_licensing").when(F.col("doc_id") % 7 == 2, "blocked").when(F.col("doc_id") % 7 == 3, "temporarily_broken")
    why = gates.enablement(F.lit(True), F.col("doc_id") % 11 == 0, kind, F.lit(False), True, F.col("lang") != "es")
    return d.select("doc_id", why.alias("reason"))


@query("""SELECT event_id, CASE WHEN a = 'submit' AND s = 'draft' THEN 'in_review' WHEN a = 'approve' AND s IN ('draft', 'in_review') AND n > 0 THEN 'approved' WHEN a = 'revise' AND s = 'approved' THEN 'draft'
  WHEN a = 'archive' AND s IN ('approved', 'sent', 'failed') THEN 'archived' WHEN a = 'edit' AND s IN ('draft', 'in_review') THEN s END AS state
FROM (SELECT event_id, ['draft', 'in_review', 'approved', 'sent'][1 + event_id % 4] AS s, ['submit', 'approve', 'revise', 'archive', 'edit'][1 + event_id % 5] AS a, user_id % 3 AS n FROM events)""")
def report_states(spark, root):
    pick = lambda n, *names: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % n).cast("int"))
    state, action = pick(4, "draft", "in_review", "approved", "sent"), pick(5, "submit", "approve", "revise", "archive", "edit")
    return load(spark, root, "events").select("event_id", reports.next_state(state, action, F.col("user_id") % 3).alias("state"))


@query("""SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'pending' WHEN page_id % 8 = 0 THEN 'blocked' WHEN page_id % 5 = 0 THEN 'blocked' WHEN page_id % 2 = 0 THEN 'rss' WHEN page_id % 3 = 0 THEN 'sitemap'
  WHEN contains(html, '<a ') THEN 'html' ELSE 'pending' END AS recommended FROM pages""")
def source_recommendation(spark, root):
    i = F.col("page_id")
    status = F.when(i % 9 == 0, 503).otherwise(200)
    return load(spark, root, "pages").select("page_id", gates.recommendation(status, i % 8 == 0, i % 5 != 0, i % 2 == 0, i % 3 == 0, F.contains("html", F.lit("<a "))).alias("recommended"))


@query("""SELECT user_id AS host, time_bucket(INTERVAL 1 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1""")
def busy_minutes(spark, root):
    counted = streams.windowed_counts(load(spark, root, "events"), "ts", ["user_id"], "60 seconds")
    return counted.where("n > 1").select(F.col("user_id").alias("host"), "start", "n")
