"""Connectors as a data source: ``spark.read`` and ``spark.readStream`` with format "tidewire_connector".

What was fetched is kept as document sets, ``root/arrival=N/connector=K/channel=C/``: what one run fetched
of one channel for one connector. ``store_documents`` adds an arrival, by a rename, so a reader sees
all of it or nothing. A task takes one set after another, up to ``PACK_SETS`` of them and about ``PACK_BYTES``: it opens a set's files, parses them and gives out
the items that they announce, in the columns of the readers in ``discovery`` and with
their rules, by set: of equal addresses the first, at most ``most``, nothing older than the cutoff. Filters on
``channel``, ``arrival`` and ``published_at`` are taken over: the first two leave sets unread, the last one
rows unsent. A stream's offset is the last arrival that it has read.

Options: ``path``; ``connector`` (rss, sitemap or html); ``cutoff`` (ISO), ``most``; for html ``allowed_hosts`` and
``prefixes`` (comma-separated), ``include`` and ``exclude`` (patterns).

The path must be one that pyarrow.fs opens in every task (a shared folder, hdfs, s3, gs).
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidewire.sources import numbered
from tidewire.sources.discovery import ANCHOR

FORMAT = "tidewire_connector"
ITEM = "arrival long, channel string, url string, position int, source_url string, title string, published_at timestamp"
#: How many items a set gives at most unless told otherwise; feeds give all.
MOST = {"rss": None, "sitemap": 200, "html": 100}
TITLE_MIN = 8
#: What a task reads, as starting one costs more than to read a small set.
PACK_SETS, PACK_BYTES = 64, 8 << 20


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and has Spark hand filters to Python sources, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ConnectorSource)


def store_documents(documents: DataFrame, root: str, tries: int = 100) -> int:
    """Adds (connector, channel, url, content) as the next arrival; returns its number. Writers may run side by side."""
    spark, root = documents.sparkSession, root.rstrip("/")
    written = numbered.aside(root)
    sets = documents.select("connector", "channel", "url", "content").repartition("connector", "channel")
    sets.write.partitionBy("connector", "channel").parquet(written)
    for _ in range(tries):
        arrival = max(numbered.numbers(spark, root, "arrival"), default=0) + 1
        if numbered.commit(spark, written, root, "arrival", arrival):
            return arrival
    raise RuntimeError("too many writers")


@dataclass
class DocumentSet:
    arrival: int
    channel: str | None
    files: list[str]


@dataclass
class Pack(InputPartition):
    """Document sets that one task reads."""

    sets: list[DocumentSet]

    def __post_init__(self) -> None:
        super().__init__(len(self.sets))


@dataclass
class Rules:
    """What a connector is asked for."""

    connector: str
    most: int | None = None
    cutoff: dt.datetime | None = None
    allowed_hosts: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    include: str | None = None
    exclude: str | None = None
    #: Bounds on dated items only, from filters: (comparison, time); rows without a date do not meet them.
    bounds: list[tuple[str, dt.datetime]] = field(default_factory=list)

    @classmethod
    def of(cls, options: dict[str, str]) -> Rules:
        kind = options.get("connector", "")
        if kind not in CONNECTORS:
            raise ValueError(f"unknown connector type: {kind}")
        listed = lambda name: tuple(x for x in options.get(name, "").split(",") if x)
        cutoff = options.get("cutoff")
        return cls(kind, int(options["most"]) if "most" in options else MOST[kind], iso(cutoff) if cutoff else None, listed("allowed_hosts"), listed("prefixes"), options.get("include"), options.get("exclude"))

    def takes(self, at: dt.datetime | None) -> bool:
        return at is None or self.cutoff is None or at >= self.cutoff

    def meets(self, at: dt.datetime | None) -> bool:
        tests = {">": lambda x: at > x, ">=": lambda x: at >= x, "<": lambda x: at < x, "<=": lambda x: at <= x}
        return not self.bounds or (at is not None and all(tests[op](x) for op, x in self.bounds))


def iso(raw: str | None) -> dt.datetime | None:
    """As ``dates.iso``: from the day on, UTC unless it says otherwise."""
    text = (raw or "").strip()
    if not re.match(r"\d{4}-\d{2}-\d{2}", text):
        return None
    try:
        at = dt.datetime.fromisoformat(text)
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=dt.UTC)


def feed_date(raw: str | None) -> dt.datetime | None:
    """As ``dates.feed_date``: RFC 822 as feeds write it, else ISO."""
    text = re.sub(r"^[A-Za-z]{3},\s*", "", (raw or "").strip())
    text = re.sub(r"\s+", " ", re.sub(r"\b(GMT|UTC|UT|Z)$", "+0000", text))
    for form in ("%d %b %Y %H:%M:%S %z", "%d %b %Y %H:%M %z", "%d %b %Y %H:%M:%S"):
        try:
            at = dt.datetime.strptime(text, form)
        except ValueError:
            continue
        return at if at.tzinfo else at.replace(tzinfo=dt.UTC)
    return iso(raw)


def _tree(content: str) -> ElementTree.Element | None:
    """The document with names freed of their namespaces; None if it is not well formed."""
    try:
        root = ElementTree.fromstring(content.strip())
    except ElementTree.ParseError:
        return None
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    return root


def _text(e: ElementTree.Element | None) -> str | None:
    return None if e is None else (e.text or "").strip()


Found = tuple[str | None, str | None, dt.datetime | None]


def rss_items(url: str, content: str, rules: Rules) -> Iterator[Found]:
    root = _tree(content)
    for item in root.findall("channel/item") if root is not None else ():
        yield _text(item.find("link")), _text(item.find("title")), feed_date(_text(item.find("pubDate")))
    for entry in root.findall("entry") if root is not None else ():
        links = [x.get("href") for x in entry.findall("link") if x.get("rel", "alternate") == "alternate"]
        days = [feed_date(_text(entry.find(n))) for n in ("published", "updated")]
        yield links[0] if links else None, _text(entry.find("title")), next((x for x in days if x), None)


def sitemap_items(url: str, content: str, rules: Rules) -> Iterator[Found]:
    root = _tree(content)
    for u in root.findall("url") if root is not None else ():
        where = _text(u.find("loc"))
        yield None if (where or "").lower().endswith(".xml") else where, None, iso(_text(u.find("lastmod")))


_URL = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?")


def _parts(url: str) -> tuple[str, str, str, str]:
    return tuple(x or "" for x in _URL.match(url.strip()).groups())


def _site(host: str) -> str:
    return re.sub(r"^www\.", "", host.lower())


def resolved(base: str, href: str) -> str:
    """As ``urls.resolve``."""
    scheme, host, path, _ = _parts(base)
    href = href.strip()
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", href):
        return href
    if href.startswith("//"):
        return f"{scheme}:{href}"
    return f"{scheme}://{host}{href}" if href.startswith("/") else f"{scheme}://{host}{re.sub('[^/]*$', '', path) or '/'}{href}"


def html_items(url: str, content: str, rules: Rules) -> Iterator[Found]:
    own = _site(_parts(url)[1])
    for href, text in re.findall(ANCHOR, content):
        where = resolved(url, href).partition("#")[0]
        scheme, host, path, query = _parts(where)
        path += f"?{query}" if query else ""
        kept = href != "" and not re.match("#|mailto:", href) and scheme.lower() in ("http", "https") and ((own and own == _site(host)) or _site(host) in rules.allowed_hosts)
        kept = kept and (not rules.prefixes or path.startswith(rules.prefixes))
        kept = kept and (not rules.include or re.search(rules.include, path)) and (not rules.exclude or not re.search(rules.exclude, path))
        title = re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", text)).strip(" ")
        yield where if kept else None, title if len(title) >= TITLE_MIN else None, None


#: Connector types. Each gives what a document announces, in order; an item without an address only holds a position.
CONNECTORS: dict[str, Callable[[str, str, Rules], Iterator[Found]]] = {"rss": rss_items, "sitemap": sitemap_items, "html": html_items}


def items(rules: Rules, held: DocumentSet, documents: Iterable[tuple[str | None, str | None]]) -> Iterator[tuple]:
    """The rows of one set. Sitemaps keep repeated addresses; feeds and listings give each once."""
    seen, given = set(), 0
    for url, content in sorted(documents, key=lambda d: d[0] or ""):
        for position, (where, title, at) in enumerate(CONNECTORS[rules.connector](url or "", content or "", rules)):
            if not where or not rules.takes(at) or (rules.connector != "sitemap" and where in seen):
                continue
            if rules.most is not None and given >= rules.most:
                return
            seen.add(where)
            given += 1
            if rules.meets(at):
                yield held.arrival, held.channel, url, position, where, title, at


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _folders(fs: pyarrow.fs.FileSystem, where: str) -> list[str]:
    return sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(where, allow_not_found=True)) if f.type == pyarrow.fs.FileType.Directory)


class _Sets:
    """Listing and reading of document sets, for batches and streams alike."""

    def __init__(self, options: dict[str, str]):
        self.path, self.rules = options["path"].rstrip("/"), Rules.of(options)

    def arrivals(self) -> dict[int, str]:
        fs, root = _opened(self.path)
        return {n: f for f in _folders(fs, root) if (n := numbered.number_of(f.rpartition("/")[2], "arrival"))}

    def packs(self, arrivals: dict[int, str], channels: set | None = None) -> list[Pack]:
        """The sets of some arrivals, all or of some channels, in order; each arrival is listed at once."""
        fs, out, size = _opened(self.path)[0], [], 0
        for n, folder in sorted(arrivals.items()):
            held: dict[str, list[pyarrow.fs.FileInfo]] = {}
            for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{folder}/connector={self.rules.connector}", allow_not_found=True, recursive=True)):
                if f.type == pyarrow.fs.FileType.File and f.path.endswith(".parquet"):
                    held.setdefault(f.path.rpartition("/")[0], []).append(f)
            for leaf, files in sorted(held.items()):
                name = unquote(leaf.rpartition("channel=")[2])
                name = None if name == "__HIVE_DEFAULT_PARTITION__" else name
                if channels is not None and name not in channels:
                    continue
                if not out or len(out[-1].sets) >= PACK_SETS or size >= PACK_BYTES:
                    out.append(Pack([]))
                    size = 0
                out[-1].sets.append(DocumentSet(n, name, sorted(f.path for f in files)))
                size += sum(f.size for f in files)
        return [Pack(p.sets) for p in out]

    def read(self, partition: Pack) -> Iterator[tuple]:
        fs = _opened(self.path)[0]
        for held in partition.sets:
            tables = [pyarrow.parquet.ParquetFile(fs.open_input_file(f)).read(["url", "content"]) for f in held.files]
            yield from items(self.rules, held, (d for t in tables for d in zip(t.column("url").to_pylist(), t.column("content").to_pylist(), strict=True)))


class ConnectorReader(_Sets, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.channels: set | None = None
        self.only: list[tuple[str, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}
        for f in filters:
            name, sign = getattr(f, "attribute", None), signs.get(type(f))
            if name == ("channel",) and isinstance(f, EqualTo | In):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.channels = values if self.channels is None else self.channels & values
            elif name == ("arrival",) and sign:
                self.only.append((sign, f.value))
            elif name == ("published_at",) and sign and sign != "=":
                self.rules.bounds.append((sign, f.value if f.value.tzinfo else f.value.astimezone(dt.UTC)))
            else:
                yield f

    def partitions(self) -> list[Pack]:
        tests = {">": int.__gt__, ">=": int.__ge__, "<": int.__lt__, "<=": int.__le__, "=": int.__eq__}
        return self.packs({n: f for n, f in self.arrivals().items() if all(tests[s](n, v) for s, v in self.only)}, self.channels) or [Pack([])]


class ConnectorStream(_Sets, DataSourceStreamReader):
    """Offsets are arrivals; a trigger reads the sets of all that came since, packed into tasks."""

    def initialOffset(self) -> dict:
        return {"arrival": 0}

    def latestOffset(self) -> dict:
        return {"arrival": max(self.arrivals(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        return self.packs({n: f for n, f in self.arrivals().items() if start["arrival"] < n <= end["arrival"]})

    def commit(self, end: dict) -> None:
        """Document sets stay; whoever stores them decides how long."""


class ConnectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> ConnectorReader:
        return ConnectorReader(dict(self.options))

    def streamReader(self, schema) -> ConnectorStream:
        return ConnectorStream(dict(self.options))
