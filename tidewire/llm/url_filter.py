"""URL filters: rules indexed by their rarest literal token.

Each rule has literal tokens that any URL it matches must contain. Token counts
over all URLs tell which of a rule's tokens is rarest; the rule is filed under
that one. A URL's tokens fetch the rules filed under them, and only those run
their regular expressions. Everything is joins and built-in functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import fresh, quoted


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts with ``path``. Beats every pattern rule; the longest wins."""

    action: str
    host: str
    path: str


@dataclass(frozen=True)
class PatternRule:
    """A regular expression on host + path + rest, in lower case. It decides URLs that no host rule fits: block beats allow."""

    action: str
    name: str
    pattern: str


HOST_RULES = (HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"))
PATTERN_RULES = (
    PatternRule("block", "tracking", r"[?&]utm_(source|medium|campaign)="),
    PatternRule("block", "session", r"[?&](sid|sessionid|phpsessid)="),
    PatternRule("block", "ads", r"/(ads|banner|sponsored)/"),
    PatternRule("block", "referral", r"[?&]ref=[^&#]*"),
    PatternRule("block", "print", r"/print/\d+"),
    PatternRule("allow", "article", r"/article/\d+"),
)
TOKEN = r"[a-z0-9]+"
#: Up to so many rules their index is broadcast; a longer list is joined by token as Spark decides.
BROADCAST_RULES = 10_000
_LITERALS = re.compile(r"\\[.\\/?&=#-]|\[[^\]]*\]|\([^()]*\)|[a-z0-9_/=&:#-]+|.")


def literal_tokens(pattern: str) -> list[list[str]]:
    """Sets of tokens of which a matching URL has one each, whole: [['utm'], ['source', 'medium', 'campaign']].

    Only what stands between two literal separators (or a class or group of them) counts;
    anything else in the pattern is passed over. A pattern with | outside a group has none.
    """
    parts = _LITERALS.findall(pattern)
    if "|" in parts:
        return []
    flat: list[list[str]] = []  # what stands at each place: separators as "/", choices of tokens, or "?" for anything
    for i, part in enumerate(parts):
        after = parts[i + 1] if i + 1 < len(parts) else ""
        loose = after[:1] in ("?", "*", "{", "+")
        if part.startswith("("):
            choices = part[1:-1].split("|")
            flat.append(choices if all(re.fullmatch(TOKEN, c) for c in choices) and not loose else ["?"])
        elif part.startswith("["):
            inside = part[1:-1]
            flat.append(["/"] if inside and not re.search(r"[a-z0-9^\\]", inside) and not loose else ["?"])
        elif part.startswith("\\"):
            flat.append(["/"] if not loose else ["?"])
        elif re.fullmatch(r"[a-z0-9_/=&:#-]+", part):
            pieces = re.findall(rf"{TOKEN}|[^a-z0-9]", part)
            flat += [[p] if re.fullmatch(TOKEN, p) else ["/"] for p in pieces]
            if loose:
                flat[-1] = ["?"]
        else:
            flat.append(["?"])
    framed = zip(flat, flat[1:], flat[2:], strict=False)
    return [mid for a, mid, b in framed if a == ["/"] and b == ["/"] and mid not in (["/"], ["?"])]


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest): after the first ://; the host's A-Z in lower case; all empty without one."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    tail = F.substr(after, F.length(host) + 1)
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path, F.substr(tail, F.length(path) + 1)


def rule_table(spark: SparkSession, hosts: tuple[HostRule, ...], patterns: tuple[PatternRule, ...]) -> DataFrame:
    """A row for each rule: number, kind, action, name, pattern and its literal token sets."""
    rows = []
    for r in hosts:
        rank = len(r.host) + len(r.path)
        # the host's labels stand whole in any URL that fits; those of the path are left to the pattern
        rows.append((len(rows), "host", r.action, r.host + r.path, rank, r"(?s)^([^/?#]*\.)?" + re.escape(r.host) + re.escape(r.path), [[t] for t in re.findall(TOKEN, r.host)]))
    for r in patterns:
        rows.append((len(rows), "pattern", r.action, r.name, 0, "(?s)" + r.pattern, literal_tokens(r.pattern)))
    return spark.createDataFrame(rows, "rule_no int, kind string, action string, name string, rank int, pattern string, needs array<array<string>>")


def judge_urls(
    pages: DataFrame,
    url_col: str = "url",
    keep: list[str] | None = None,
    hosts: tuple[HostRule, ...] = HOST_RULES,
    patterns: tuple[PatternRule, ...] = PATTERN_RULES,
) -> DataFrame:
    """The columns ``keep`` (all, if None) and host, path, ``rule`` (the host rule that decides, else
    null), ``pattern_rule`` (the pattern rule that decides, else null) and ``verdict``.

    Null URLs and those without :// have an empty host and path, fit no rule, and are
    allowed. Equal URLs are judged once. Columns named host, path, rule, pattern_rule or
    verdict are replaced.
    """
    spark = pages.sparkSession
    keep = [c for c in (pages.columns if keep is None else keep) if c not in {"host", "path", "rule", "pattern_rule", "verdict"}]
    host, path, rest = url_parts(F.col(quoted(url_col)))
    urls = pages.select(F.col(quoted(url_col)).alias("_url")).where("_url is not null").distinct()
    host_u, path_u, rest_u = url_parts(F.col("_url"))
    lowered = F.concat(host_u, path_u, F.lower(rest_u))
    urls = urls.select("_url", lowered.alias("_text"), F.lower(lowered).alias("_lower"))
    tokens = urls.select("_url", "_text", "_lower", F.explode(F.array_distinct(F.regexp_extract_all("_lower", F.lit(TOKEN), F.lit(0)))).alias("token"))
    rules = rule_table(spark, hosts, patterns)
    few = F.broadcast if len(hosts) + len(patterns) <= BROADCAST_RULES else lambda df: df
    # of each rule's token sets, the one that the fewest URLs have; (set, token) pairs are few
    sets = rules.select("rule_no", F.posexplode("needs").alias("set_no", "choices")).select("rule_no", "set_no", F.explode("choices").alias("token"))
    counts = tokens.join(few(sets.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    weighed = sets.join(counts, "token", "left").groupBy("rule_no", "set_no").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    chosen = weighed.groupBy("rule_no").agg(F.min(F.struct("n", "set_no")).alias("best")).select("rule_no", F.col("best.set_no").alias("set_no"))
    index = sets.join(chosen, ["rule_no", "set_no"]).join(rules.drop("needs"), "rule_no").drop("set_no")
    candidates = tokens.join(few(index), "token").drop("token")
    unfiled = rules.where(F.size("needs") == 0).drop("needs")
    if any(not literal_tokens(r.pattern) for r in patterns):
        always = unfiled.groupBy().agg(F.collect_list(F.struct("rule_no", "kind", "action", "name", "rank", "pattern")).alias("all")).first()["all"]
        listed = F.array(*[F.struct(F.lit(r["rule_no"]).alias("rule_no"), F.lit(r["kind"]).alias("kind"), F.lit(r["action"]).alias("action"), F.lit(r["name"]).alias("name"), F.lit(r["rank"]).alias("rank"), F.lit(r["pattern"]).alias("pattern")) for r in always])
        candidates = candidates.unionByName(urls.withColumn("r", F.explode(listed)).select("_url", "_text", "_lower", "r.*"))
    subject = F.when(F.col("kind") == "host", F.col("_text")).otherwise(F.col("_lower"))
    fits = candidates.where(F.regexp_like(subject, F.col("pattern")))
    best_host = F.max(F.when(F.col("kind") == "host", F.struct("rank", "name", "action")))
    # block sorts after allow
    best_pattern = F.max(F.when(F.col("kind") == "pattern", F.struct("action", "name")))
    of, url, h, p = (fresh(x, pages) for x in ("_of", "_page_url", "_h", "_p"))
    verdicts = fits.groupBy("_url").agg(best_host.alias(h), best_pattern.alias(p)).withColumnRenamed("_url", of)
    joined = pages.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(url_col)).alias(url)).join(verdicts, F.col(url) == F.col(of), "left")
    host, path, _ = url_parts(F.col(url))
    return joined.select(
        *[F.col(quoted(c)) for c in keep],
        host.alias("host"),
        path.alias("path"),
        F.col(h)["name"].alias("rule"),
        F.when(F.col(h).isNull(), F.col(p)["name"]).alias("pattern_rule"),
        F.coalesce(F.col(h)["action"], F.col(p)["action"], F.lit("allow")).alias("verdict"),
    )
