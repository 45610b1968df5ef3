"""What feeds, sitemaps, listings and edition pages announce, from documents already fetched.

Input is (channel, url, content); the network is left to whoever fetches. Each reader
gives (channel, source_url, title, published_at, position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.dates import feed_date, lastmod
from tidewire.functions.urls import parts, resolve, same_site

RSS = "channel struct<item:array<struct<title:string,link:string,pubDate:string,description:string>>>"
ATOM = "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string>>"
#: A link: its address and what it shows.
ANCHOR = r'(?is)<a\b[^>]*?\bhref\s*=\s*["\']([^"\']*)["\'][^>]*>(.*?)</a>'
URLSET = "url array<struct<loc:string,lastmod:string>>"


def not_stale(at: Column, cutoff: Column | None) -> Column:
    """Undated rows are never stale."""
    return F.lit(True) if cutoff is None else ~F.coalesce(at < cutoff, F.lit(False))


def first_by_url(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Of each channel and address the first, in order, and of those the first ``most``."""
    seen = Window.partitionBy("channel", "source_url").orderBy("url", "position")
    kept = rows.withColumn("_n", F.row_number().over(seen)).where("_n = 1").drop("_n")
    if most is None:
        return kept
    order = Window.partitionBy("channel").orderBy("url", "position")
    return kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def rss(documents: DataFrame, cutoff: Column | None = None, most: int | None = None) -> DataFrame:
    """RSS 2.0 and Atom."""
    r = F.from_xml("content", RSS, {"mode": "PERMISSIVE"})["channel"]["item"]
    a = F.from_xml("content", ATOM, {"mode": "PERMISSIVE"})["entry"]
    each = documents.select("channel", "url", F.posexplode_outer(r).alias("position", "i")).where("i is not null")
    feeds = each.select("channel", "url", "position", F.trim("i.link").alias("source_url"), F.trim("i.title").alias("title"), feed_date("i.pubDate").alias("published_at"))
    entries = documents.select("channel", "url", F.posexplode_outer(a).alias("position", "i")).where("i is not null")
    link = F.get(F.filter("i.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), 0)["_href"]
    atoms = entries.select("channel", "url", "position", link.alias("source_url"), F.trim("i.title").alias("title"), F.coalesce(feed_date("i.published"), feed_date("i.updated")).alias("published_at"))
    rows = feeds.unionByName(atoms).where((F.col("source_url") != "") & not_stale(F.col("published_at"), cutoff))
    return first_by_url(rows, most)


def sitemap(documents: DataFrame, cutoff: Column | None = None, most: int = 200) -> DataFrame:
    """Entries of urlsets; addresses of further XML files are left out. Nothing is deduplicated."""
    urls = F.from_xml("content", URLSET, {"mode": "PERMISSIVE"})["url"]
    each = documents.select("channel", "url", F.posexplode(urls).alias("position", "u"))
    rows = each.select("channel", "url", "position", F.trim("u.loc").alias("source_url"), F.lit(None).cast("string").alias("title"), lastmod("u.lastmod").alias("published_at"))
    rows = rows.where((F.col("source_url") != "") & ~F.endswith(F.lower("source_url"), F.lit(".xml")) & not_stale(F.col("published_at"), cutoff))
    order = Window.partitionBy("channel").orderBy("url", "position")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def nested_sitemaps(documents: DataFrame, most: int = 20) -> DataFrame:
    """(channel, location) of an index's sitemaps, at most ``most`` a channel."""
    found = F.from_xml("content", "sitemap array<struct<loc:string>>", {"mode": "PERMISSIVE"})["sitemap"]
    each = documents.select("channel", "url", F.posexplode(found).alias("position", "s"))
    order = Window.partitionBy("channel").orderBy("url", "position")
    return each.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("channel", F.trim("s.loc").alias("location"))


def listing(documents: DataFrame, allowed_hosts: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), include: str | None = None, exclude: str | None = None, most: int = 100) -> DataFrame:
    """Links of a page to its own site or allowed hosts: absolute, without fragment, first of each; short titles are null."""
    hrefs, texts = (F.regexp_extract_all("content", F.lit(ANCHOR), F.lit(i)) for i in (1, 2))
    each = documents.select("channel", "url", F.posexplode(F.arrays_zip(hrefs.alias("h"), texts.alias("t"))).alias("position", "a"))
    each = each.where((F.col("a.h") != "") & ~F.regexp_like("a.h", F.lit("^(#|mailto:)")))
    whole = F.substring_index(resolve(F.col("url"), F.col("a.h")), "#", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace("a.t", "<[^>]*>", " "), r"\s+", " "))
    rows = each.select("channel", "url", "position", whole.alias("source_url"), F.when(F.length(title) >= 8, title).alias("title"), F.lit(None).cast("timestamp").alias("published_at"))
    rows = rows.where(same_site("url", "source_url", allowed_hosts))
    p = parts("source_url")
    path = F.concat(p["path"], F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"])))
    if prefixes:
        rows = rows.where(F.greatest(*[F.startswith(path, F.lit(x)) for x in prefixes], F.lit(False)))
    if include:
        rows = rows.where(F.regexp_like(path, F.lit(include)))
    if exclude:
        rows = rows.where(~F.regexp_like(path, F.lit(exclude)))
    return first_by_url(rows, most)


def edition_candidates(channels: DataFrame, asof: Column, days: int) -> DataFrame:
    """(channel, edition_date, source_url): an address for each of the last days + 1 dates from the channel's host and slug pattern."""
    dates = F.explode(F.sequence(F.date_sub(asof, days), asof))
    slug = F.date_format("edition_date", "dd-MM-yyyy")
    url = F.concat(F.col("host"), F.lit("/pdf/"), F.date_format("edition_date", "yyyy/MM"), F.lit("/"), slug, F.lit("/"), slug, F.lit(".pdf"))
    return channels.withColumn("edition_date", dates).select("channel", "edition_date", url.alias("source_url"))


def is_feed(content_type: Column, head: Column) -> Column:
    start = F.lower(F.substring(head, 1, 400))
    return F.contains(F.lower(content_type), F.lit("rss")) | F.contains(F.lower(content_type), F.lit("atom")) | F.contains(start, F.lit("<rss")) | F.contains(start, F.lit("<feed"))


def is_sitemap(head: Column) -> Column:
    start = F.lower(F.substring(head, 1, 400))
    return F.contains(start, F.lit("<urlset")) | F.contains(start, F.lit("<sitemapindex"))


def timeline(posts: DataFrame, handle: str, most: int = 20) -> DataFrame:
    """A handle's posts, whatever its case, newest first, 5 to 100 of them."""
    return posts.where(F.lower("handle") == handle.lower()).orderBy(F.desc("posted_at"), "post_id").limit(min(100, max(5, most)))


READERS = {"rss": rss, "sitemap": sitemap, "html": listing}


def reader(kind: str):
    """The reader of a connector type."""
    if kind not in READERS:
        raise ValueError(f"unknown connector type: {kind}")
    return READERS[kind]
