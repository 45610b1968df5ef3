"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import col

#: Entities that canonical URLs have undone.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'"}


def unescape(text: Column) -> Column:
    for name, char in reversed(ENTITIES.items()):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def parts(url: Column | str) -> dict[str, Column]:
    """scheme, host (with port), path, query, without a URL parser, so that odd URLs give empty parts."""
    u = F.coalesce(F.trim(col(url)), F.lit(""))
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    return {name: F.regexp_extract(u, pattern, i) for i, name in enumerate(("scheme", "host", "path", "query"), 1)}


def canonical_url(url: Column | str) -> Column:
    """Entities undone, scheme and host in lower case, no trailing slash, only the parameters id and
    language (in lower case), sorted; no fragment."""
    p = parts(unescape(F.coalesce(F.trim(col(url)), F.lit(""))))
    path = F.regexp_replace(p["path"], "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.transform(F.split(p["query"], "&"), lambda kv: F.struct(F.lower(F.substring_index(kv, "=", 1)).alias("k"), F.regexp_replace(kv, "^[^=]*=?", "").alias("v")))
    kept = F.filter(pairs, lambda kv: kv["k"].isin("id", "language"))
    kept = F.array_sort(F.transform(kept, lambda kv: F.concat(kv["k"], F.lit("="), F.when(kv["k"] == "language", F.lower(kv["v"])).otherwise(kv["v"]))))
    query = F.array_join(kept, "&")
    front = F.when(p["scheme"] == "", "").otherwise(F.concat(F.lower(p["scheme"]), F.lit(":")))
    host = F.when(p["host"] == "", "").otherwise(F.concat(F.lit("//"), F.lower(p["host"])))
    return F.concat(front, host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def site(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def same_site(base: Column | str, other: Column | str, allowed_hosts: tuple[str, ...] = ()) -> Column:
    b, o = parts(base), parts(other)
    mine = (site(b["host"]) != "") & (site(b["host"]) == site(o["host"]))
    also = site(o["host"]).isin(*allowed_hosts) if allowed_hosts else F.lit(False)
    return F.lower(o["scheme"]).isin("http", "https") & (mine | also)


def archive_year(url: Column | str) -> Column:
    """The year in a yearquarter parameter; null without one."""
    return F.regexp_extract(col(url), r"(?i)[?&]yearquarter=(\d{4})", 1).try_cast("int")


def site_article_id(url: Column | str) -> Column:
    found = F.regexp_extract(col(url), r"/article/(\d+)", 1)
    return F.when(found != "", found)


def resolve(base: Column | str, href: Column | str) -> Column:
    """A link in a page of address ``base``: absolute, scheme-relative, root-relative or relative to the page's folder."""
    p, h = parts(base), F.trim(col(href))
    root = F.concat(p["scheme"], F.lit("://"), p["host"])
    folder = F.regexp_replace(p["path"], "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(F.regexp_like(h, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), h)
        .when(F.startswith(h, F.lit("//")), F.concat(p["scheme"], F.lit(":"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(root, h))
        .otherwise(F.concat(root, folder, h))
    )
