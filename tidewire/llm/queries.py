"""The operators' queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.chunk_dedup import dedup_substrings
from tidewire.llm.common import new_folder
from tidewire.llm.decontaminate import find_contamination
from tidewire.llm.fill_middle import fill_middle, restored
from tidewire.llm.jaccard_join import jaccard_groups
from tidewire.llm.kneser_ney import classify
from tidewire.llm.line_dedup import dedup_lines
from tidewire.llm.line_rules import clean_lines
from tidewire.llm.mixing import mix
from tidewire.llm.secret_scan import scan_secrets
from tidewire.llm.sharding import shard
from tidewire.llm.token_alignment import align_tokens
from tidewire.llm.url_filter import judge_urls
from tidewire.llm.webp import decode_media, encode_media


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "part_words")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).drop("node", "class_node")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "lang"])


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # five arrivals, so that small shards pile up and are merged
    arrivals = [docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == i) for i in range(5)]
    rows = shard(docs, new_folder(spark, "shards"), arrivals=arrivals, grace_seconds=0)
    stored = F.sha2(F.coalesce("text", F.lit("")), 256)
    return rows.select("doc_id", "lang", "source", "n_chars", stored.alias("text_sha256"), F.col("shard").isNotNull().alias("sharded"))


BASE_KINDS = ("assign", "access", "hex")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), new_folder(spark, "ledger")
    # an earlier arrival, about half of the rows; the scan of the whole table then meets blobs that the ledger holds
    scan_secrets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger)
    found = scan_secrets(docs, ledger)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("findings", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(of(*BASE_KINDS)), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"),
        "blob",
    )


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), keep=["page_id"])


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = encode_media(table(spark, sf_dir, "documents"), keep=["doc_id"])
    measured = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    read = decode_media(measured, keep=["doc_id", "n_bytes", "payload_bytes", "media_bytes", "media_sha256"])
    payload = F.substring(F.col("pixels"), F.lit(1), F.col("payload_bytes").cast("int"))
    return read.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.withColumn("cleaned_sha256", F.sha2(F.col("cleaned").cast("binary"), 256)).drop("cleaned")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    aligned = align_tokens(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), keep=["doc_id"])
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return aligned.withColumn("groups_sha256", digest).drop("groups")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_substrings": op2_substrings,
    "op3_decontamination": op3_decontamination,
    "op4_jaccard": op4_jaccard,
    "op5_quality": op5_quality,
    "op6_shards": op6_shards,
    "op7_secrets": op7_secrets,
    "op8_lines": op8_lines,
    "op9_urls": op9_urls,
    "op10_webp": op10_webp,
    "op11_fill_middle": op11_fill_middle,
    "op12_quality_rules": op12_quality_rules,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {
    "op1_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS level, 1.5 * sum(source_size) OVER () AS total FROM sources),
opened AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY level, cap, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY level, cap, weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opening
  FROM levels),
filled AS (SELECT *, max(CASE WHEN opening <= level THEN opening END) OVER () AS fill FROM opened),
targets AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN fill IS NULL OR level < fill THEN cap ELSE fill * weight END AS target FROM filled)
, whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies,
         CAST(round(target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size) AS BIGINT) AS extra
  FROM targets),
dealt AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.copies AS whole, least(greatest(t.extra - coalesce(sum(d.size) OVER (
           PARTITION BY d.source ORDER BY md5(concat_ws(':', '7', d.doc_id, d.size)), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), d.size) AS more
  FROM sized d JOIN whole t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + more AS BIGINT) AS taken,
       CAST(whole + CASE WHEN more = size AND size > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST(CASE WHEN more = size THEN 0 ELSE more END AS BIGINT) AS part_words
FROM dealt
""",
    "op3_decontamination": r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
lengths AS (SELECT DISTINCT k FROM windows),
spots AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lengths WHERE len(w) >= k),
hits AS (SELECT s.doc_id, s.i, s.k, win.item FROM spots s JOIN windows win ON win.k = s.k AND win.win = array_to_string(s.w[s.i : s.i + s.k - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
    "op6_shards": """
SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256, true AS sharded FROM documents
""",
    "op9_urls": r"""
WITH parts AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS after FROM pages),
cut AS (SELECT page_id, regexp_extract(after, '^[^/?#]*') AS raw_host, substr(after, length(regexp_extract(after, '^[^/?#]*')) + 1) AS tail FROM parts),
urls AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^?#]*') AS path,
         lower(translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || tail) AS whole
  FROM cut),
rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost) + length(rpath)) AS rule, arg_max(action, length(rhost) + length(rpath)) AS action
  FROM urls JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY page_id),
patterns AS (
  SELECT page_id, CASE WHEN regexp_matches(whole, '[?&]utm_(source|medium|campaign)=') THEN 'tracking'
              WHEN regexp_matches(whole, '[?&](sid|sessionid|phpsessid)=') THEN 'session'
              WHEN regexp_matches(whole, '[?&]ref=[^&#]*') THEN 'referral'
              WHEN regexp_matches(whole, '/print/\d+') THEN 'print'
              WHEN regexp_matches(whole, '/(ads|banner|sponsored)/') THEN 'ads' END AS blocked,
         CASE WHEN regexp_matches(whole, '/article/\d+') THEN 'article' END AS allowed
  FROM urls)
SELECT u.page_id, u.host, u.path, f.rule, CASE WHEN f.rule IS NULL THEN coalesce(p.blocked, p.allowed) END AS pattern_rule,
       coalesce(f.action, CASE WHEN p.blocked IS NOT NULL THEN 'block' WHEN p.allowed IS NOT NULL THEN 'allow' END, 'allow') AS verdict
FROM urls u LEFT JOIN fits f USING (page_id) LEFT JOIN patterns p USING (page_id)
""",
    "op11_fill_middle": r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM hashed),
cuts AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS low, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(list_slice(u, 1, low), '') AS prefix, array_to_string(list_slice(u, low + 1, high), '') AS middle,
         array_to_string(list_slice(u, high + 1, n), '') AS suffix
  FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
""",
    "op12_quality_rules": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^ 	-
]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs)),
counted AS (
  SELECT *, len(regexp_extract_all(line, '[^ 	-
]+')) AS n, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
         len(regexp_extract_all(line, '[|>»›·•/–-]([ 	-
]|\z)')) AS separators
  FROM lines),
judged AS (
  SELECT *, n > 0 AND (
           NOT regexp_matches(line, '[.!?:;…。！？؟।]["''”’»)\]]*([ 	-
]|\z)') OR symbols > n * 0.1 OR separators > n * 0.2
           OR regexp_matches(line, 'all rights reserved|terms of (use|service)|privacy policy|use of cookies|(accept|uses|use) cookies|enable javascript|lorem ipsum|click here|sign up for our|subscribe to our|share (this )?on (facebook|twitter)|powered by', 'i')) AS fails
  FROM counted),
by_doc AS (
  SELECT doc_id, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
         count(*) FILTER (fails) AS n_failed_lines, CAST(coalesce(sum(n) FILTER (fails), 0) AS BIGINT) AS lost_words,
         coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT fails), '') AS cleaned
  FROM judged GROUP BY doc_id),
joined AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_lines, n_failed_lines, lost_words, sha256(cleaned) AS cleaned_sha256
  FROM docs d JOIN by_doc USING (doc_id) LEFT JOIN repeated USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_words <= 50 * n_words AS kept
FROM joined
""",
}
