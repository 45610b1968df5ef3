"""Article extraction from raw pages: title, body, date, cover image, with their sources.

A task parses pages in one pass over their tags and gives back what it saw as a list of
(field, source, value), from most to least trusted. Which of them counts - the precedence of
sources, what parses as a date, what is junk - is said with column functions.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import dates
from tidewire.functions import text as tx

#: Meta names of a publication date and of a cover image, most trusted first.
DATE_METAS = ("article:published_time", "og:published_time", "pubdate", "publish-date", "date", "DC.date.issued")
IMAGE_METAS = ("og:image:secure_url", "og:image", "twitter:image", "twitter:image:src")
#: Keys under which an object holds an image's address.
IMAGE_KEYS = ("url", "contentUrl", "src", "sourceUrl")
#: Ids and classes of the pages monitored - an article's date, its byline, today's date in the header, its photo.
DATE_LABEL, MAIN_DATE_LABEL = r"(^|_)lblDate$", r"ContentPlaceHolder1_lblDate$"
BYLINE, NEWS_PHOTO = "WriterLink", "newspictures/"
TODAY_LABELS = ("lblGrogerianDate", "lblGregorianDate", "lblHijriDate")
#: Names of the data that pages embed.
NEXT_DATA, ARTICLE_INFO, NEWS_TYPES = "__NEXT_DATA__", "article_info", {"NewsArticle", "Article"}
#: Fixed limits: shortest paragraph, longest text without paragraphs, days by which a shown date must be newer to win.
PARAGRAPH_MIN, BODY_MAX, STALE_DAYS, ADDRESS_MAX = 40, 20_000, 30, 2048
_EMPTY_TAGS = set("area base br col embed hr img input link meta source track wbr".split())
_CHROME = {"script", "style", "noscript", "nav", "footer", "aside"}


#: The elements that hold an article's text, best first: tag, and the attribute with a pattern that it must have.
CONTAINERS = (
    ("article", None, None),
    ("div", "class", r"(article|story|content|post).*body"),
    ("div", "id", r"(article|story|content)"),
    ("main", None, None),
    ("body", None, None),
)


def boxes(tag: str, attrs: dict[str, str]) -> Iterator[int]:
    """As which body container an element can serve: 0 the best."""
    for rank, (name, attribute, pattern) in enumerate(CONTAINERS):
        if tag == name and (attribute is None or re.search(pattern, attrs.get(attribute, ""), re.IGNORECASE)):
            yield rank


class Seen(HTMLParser):
    """What is of use on a page, gathered while its tags go by. ``texts`` maps names to captured texts."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.texts: dict[str, list[str]] = {}
        self.metas: dict[str, str] = {}
        self.firsts: dict[str, str] = {}
        self.photos: list[str] = []
        self.paragraphs: dict[int, list[str]] = {}
        self._open: list[str] = []
        self._captures: list[tuple[int, str, list[str], str, bool]] = []  # depth, name, pieces, joint, also within chrome
        self.feed(page)
        self.close()
        self._close_to(0)

    def _capture(self, name: str, joint: str = " ", anywhere: bool = False) -> None:
        self._captures.append((len(self._open), name, [], joint, anywhere))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p" and self._open[-1:] == ["p"]:
            self._close_to(len(self._open) - 1)
        got = {k: v or "" for k, v in attrs}
        self._note(tag, got)
        if tag in _EMPTY_TAGS:
            return
        self._open.append(tag)
        shown = not _CHROME & set(self._open)
        if shown and tag in ("title", "h1"):
            self._capture(tag)
        if shown and tag == "p":
            self._capture("p")
        for box in boxes(tag, got) if shown else ():
            if f"box{box}" not in self.texts and all(c[1] != f"box{box}" for c in self._captures):
                self._capture(f"box{box}", "\n")
        if tag == "script":
            kind = "ld" if got.get("type") == "application/ld+json" else NEXT_DATA if got.get("id") == NEXT_DATA else "script"
            self._capture(kind, "", True)
        for name, label in (("main_date", MAIN_DATE_LABEL), ("date", DATE_LABEL)):
            if re.search(label, got.get("id", ""), re.IGNORECASE):
                self._capture(name, " ", True)
        if tag == "font" and BYLINE in got.get("class", "").split():
            self._capture("byline", " ", True)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._note(tag, {k: v or "" for k, v in attrs})

    def _note(self, tag: str, got: dict[str, str]) -> None:
        if tag == "meta" and got.get("content"):
            for kind in ("property", "name"):
                if got.get(kind):
                    self.metas.setdefault(got[kind], got["content"])
        elif tag == "time" and "datetime" in got:
            self.firsts.setdefault("time", got["datetime"])
        elif tag == "link" and "image_src" in got.get("rel", "").split():
            self.firsts.setdefault("image_src", got.get("href", ""))
        elif tag == "img" and NEWS_PHOTO in got.get("src", "").lower():
            self.photos.append(got["src"])

    def handle_endtag(self, tag: str) -> None:
        if tag in self._open:
            self._close_to(len(self._open) - 1 - self._open[::-1].index(tag))

    def handle_data(self, data: str) -> None:
        hidden = bool(_CHROME & set(self._open))
        for _, name, pieces, joint, anywhere in self._captures:
            if anywhere or not hidden:
                piece = data.strip() if joint else data
                if piece:
                    pieces.append(piece)

    def _close_to(self, depth: int) -> None:
        """Ends what was opened below ``depth``, and the captures that began there."""
        del self._open[depth:]
        while self._captures and self._captures[-1][0] > depth:
            _, name, pieces, joint, _ = self._captures.pop()
            text = joint.join(pieces)
            self.texts.setdefault(name, []).append(text)
            if name == "p" and len(text) >= PARAGRAPH_MIN:
                for outer in self._captures:
                    if outer[1].startswith("box"):
                        self.paragraphs.setdefault(int(outer[1][3:]), []).append(text)

    def first(self, name: str) -> str:
        return next(iter(self.texts.get(name, [])), "")

    def dom_body(self) -> str:
        for box in range(len(CONTAINERS)):
            if f"box{box}" in self.texts:
                return "\n\n".join(self.paragraphs.get(box, [])) or self.first(f"box{box}")[:BODY_MAX]
        return ""


class _Lines(HTMLParser):
    def __init__(self, fragment: str):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.feed(fragment)
        self.close()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.lines.append(data.strip())


def plain(value: object) -> str:
    """Text without markup, a line for each piece."""
    if not isinstance(value, str):
        return ""
    return "\n".join(_Lines(value).lines) if re.search("[<&]", value) else value.strip()


def _json(text: str) -> object:
    """The JSON value that a text begins with; None if there is none."""
    try:
        return json.JSONDecoder().raw_decode(text.lstrip())[0]
    except ValueError:
        return None


def _within(value: object, *keys: str) -> dict:
    """The object found under a path of keys; empty where the path breaks off."""
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value if isinstance(value, dict) else {}


def _any(found: dict, *keys: str) -> object:
    return next((found[k] for k in keys if found.get(k)), None)


def image_addresses(value: object) -> Iterator[str]:
    """The addresses in a string, list or object, in order."""
    if isinstance(value, str) and value.strip():
        yield value.strip()
    elif isinstance(value, list):
        for x in value:
            yield from image_addresses(x)
    elif isinstance(value, dict):
        for k in IMAGE_KEYS:
            yield from image_addresses(value.get(k))


def linked_objects(value: object) -> Iterator[dict]:
    """The objects of JSON-LD, with lists and graphs laid flat."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict) and isinstance(x.get("@graph"), list):
            stack.append(x["@graph"])
        elif isinstance(x, dict):
            yield x


def _is_news(item: dict) -> bool:
    kinds = item.get("@type")
    return bool(NEWS_TYPES & {k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)})


def seen_on(page: str, url: str) -> list[tuple[str, str, str | None]]:
    """(field, source, value), for each field from most to least trusted."""
    seen, out = Seen(page), []

    def add(field: str, source: str, value: object) -> None:
        if value not in (None, ""):
            out.append((field, source, str(value)))

    following = _within(_json(seen.first(NEXT_DATA)), "props", "pageProps", "article")
    scripts = (s for s in seen.texts.get("script", []) if ARTICLE_INFO in s)
    assigned = (re.split(rf"var\s+{ARTICLE_INFO}\s*=", s, maxsplit=1) for s in scripts)
    info = _within({"i": next((_json(x[1]) for x in assigned if len(x) > 1), None)}, "i")
    linked = [x for text in seen.texts.get("ld", []) for x in linked_objects(_json(text))]
    news = sorted((x for x in linked if _is_news(x)), key=lambda x: len(plain(x.get("articleBody"))))
    story = news[-1] if news else {}
    payloads = (
        ("next_data", following, ("title",), ("content", "body"), ("date",), "iso"),
        (ARTICLE_INFO, info, ("article_title", "seo_meta_title"), ("article_body", "article_content", "body"), ("publish_time", "max_publish_time"), "local"),
        ("json_ld", story, ("headline",), ("articleBody",), ("datePublished", "dateCreated"), "iso"),
    )
    for source, found, titles, bodies, days, form in payloads:
        add("title", source, _any(found, *titles))
        add("body", source, plain(_any(found, *bodies)))
        add("date", form, _any(found, *days))
    if following.get("paidArticle"):
        add("paid", "next_data", "yes")
    for source, value in (("og", seen.metas.get("og:title")), ("title", seen.first("title")), ("h1", seen.first("h1"))):
        add("title", source, value)
    for name in DATE_METAS:
        add("date", "iso", seen.metas.get(name))
    add("date", "iso", seen.firsts.get("time"))
    add("dom", "dom", seen.dom_body())
    for text in seen.texts.get("main_date", []):
        add("shown", "day_first", text)
    lines = seen.texts.get("byline", [])
    day, clock = (next((x for x in reversed(lines) if re.fullmatch(p, x)), "") for p in (dates.SHOWN_YEAR_FIRST, r".*\d:\d\d.*"))
    if day:
        add("shown", "day_and_clock", f"{day} {clock}")
    for text in seen.texts.get("date", []):
        add("shown", "day_first", text)
    images = [seen.metas.get(m) for m in IMAGE_METAS] + [seen.firsts.get("image_src")]
    images += [next(image_addresses(_any(x, "image", "thumbnailUrl")), None) for x in linked] + seen.photos
    for raw in filter(None, images):
        whole = urljoin(url, html.unescape(raw.strip()))
        if urlsplit(whole).netloc:
            add("image", "page", whole[:ADDRESS_MAX])
    return out


SEEN = "array<struct<field:string,source:string,value:string>>"


def seen_on_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``seen``, what ``seen_on`` finds in html, a string or UTF-8 bytes."""
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 500):
                part = frame.iloc[lo : lo + 500]
                found = [[dict(zip(("field", "source", "value"), x, strict=True)) for x in seen_on(h or "", u or "")] for u, h in zip(part["_url"], part["_page"], strict=True)]
                yield part[keep].assign(seen=found)

    return pages.select(*keep, F.col("url").alias("_url"), F.col("html").cast("string").alias("_page")).mapInPandas(run, ", ".join([*kinds, f"seen {SEEN}"]))


def _of(field: str) -> Column:
    return F.filter("seen", lambda s: s["field"] == field)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _dated(s: Column) -> Column:
    """The time that a value of a stated form stands for."""
    forms = {"local": dates.local_naive, "day_first": dates.day_first, "day_and_clock": dates.day_and_clock}
    out = dates.iso(s["value"])
    for form, parse in forms.items():
        out = F.when(s["source"] == form, parse(s["value"])).otherwise(out)
    return out


def published(page: Column, url: Column, asof_year: int) -> Column:
    """Data and metas, then the address; a date that readers see wins if it is the only one or much newer, and where the other is long past."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*?//[^/?#]*([^?#]*)", 1)
    given = F.coalesce(_first(F.transform(_of("date"), _dated)), dates.year_first(F.regexp_extract(path, r"20\d\d[-/]\d\d[-/]\d\d", 0)))
    # what the header calls today is no article's date
    rest = F.regexp_replace(page, "<[^<>]*(?:" + "|".join(TODAY_LABELS) + ")[^<>]*>[^<]*", " ")
    anywhere = [_first(F.transform(F.regexp_extract_all(rest, F.lit(p), F.lit(0)), parse)) for p, parse in ((dates.SHOWN_DAY_FIRST, dates.day_first), (dates.SHOWN_YEAR_FIRST, dates.year_first))]
    shown = F.coalesce(_first(F.transform(_of("shown"), _dated)), *anywhere)
    newer = given.isNull() | (given < shown - F.make_dt_interval(days=F.lit(STALE_DAYS)))
    best = F.when(newer, F.coalesce(shown, given)).otherwise(given)
    return F.when(F.year(best) < asof_year - 1, shown).otherwise(best)


def extract_articles(pages: DataFrame, asof_year: int, id_col: str = "page_id") -> DataFrame:
    """One row a page: its id, title, body, image_url, published_at, char_count, paid_article, used_next_data, body_source, date_unknown."""
    found = seen_on_pages(pages.select(F.col(id_col), "url", "html"), [id_col, "url", "html"])
    page = F.coalesce(F.col("html").cast("string"), F.lit(""))
    found = found.withColumn("_at", published(page, F.col("url"), asof_year))
    good = lambda s: tx.body_ok(s["value"])
    bodies, dom = _of("body"), F.coalesce(F.get(_of("dom"), F.lit(0))["value"], F.lit(""))
    best = F.get(F.filter(bodies, good), F.lit(0))
    some = F.get(bodies, F.lit(0))
    use_dom = best.isNull() & (tx.body_ok(dom) | (F.length(dom) > F.coalesce(F.length(some["value"]), F.lit(0))))
    body = F.when(use_dom, dom).otherwise(F.coalesce(best["value"], some["value"], F.lit("")))
    source = F.when(use_dom, F.lit("dom")).otherwise(F.coalesce(best["source"], some["source"]))
    found = found.withColumns({"_body": body, "_source": source, "_used": F.coalesce(F.exists(bodies, lambda s: (s["source"] == "next_data") & good(s)), F.lit(False))})
    junk = tx.is_junk_body("_body")
    text = F.when(junk, F.lit("")).otherwise(F.col("_body"))
    return found.select(
        id_col,
        _first(F.transform(_of("title"), lambda s: F.nullif(F.trim(s["value"]), F.lit("")))).alias("title"),
        text.alias("body"),
        _first(F.transform(_of("image"), lambda s: F.when(F.regexp_like(s["value"], F.lit("(?i)^https?://")), s["value"]))).alias("image_url"),
        F.col("_at").alias("published_at"),
        F.length(text).cast("long").alias("char_count"),
        (F.size(_of("paid")) > 0).alias("paid_article"),
        F.col("_used").alias("used_next_data"),
        F.when(~junk, F.col("_source")).alias("body_source"),
        F.col("_at").isNull().alias("date_unknown"),
    )


def invalidated(articles: DataFrame, junk: Column) -> DataFrame:
    """Articles whose body is junk lose body and what was said about it."""
    return articles.withColumns({c: F.when(~junk, F.col(c)) for c in ("body", "metadata") if c in articles.columns})
