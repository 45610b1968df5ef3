"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. A scan looks
only at blobs that the ledger does not hold for these rules, told by a digest of them, one text for
each blob however many paths carry it; its findings are appended to the ledger
and joined back to all paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidewire.llm.common import map_texts, materialize, quoted, while_writing


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` of the pattern must have ``least`` characters, else the match is dropped.

    ``any_of``: the pattern cannot match a text that, in lower case, holds none of these.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = 0
    any_of: tuple[str, ...] = ()


#: In the order in which kinds are listed at equal starts.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, re.IGNORECASE | re.ASCII, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 16, any_of=("akia",)),
    # a run of hex digits is matched whole or not at all, so its least length can stand in the pattern
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", any_of=("-----begin ",)),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]+", 40, any_of=("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 15, any_of=("xox",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]+", any_of=("eyj",)),
)
FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def spans_of(text: str, rules: tuple[Rule, ...], compiled: list[re.Pattern]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then in the rules' order."""
    lower = text.lower()
    found = []
    for place, (rule, pattern) in enumerate(zip(rules, compiled, strict=True)):
        if rule.any_of and not any(x in lower for x in rule.any_of):
            continue
        for m in pattern.finditer(text):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), place, m.end()))
    return [(rules[place].kind, start, end) for start, place, end in sorted(found)]


def rules_digest(rules: tuple[Rule, ...]) -> str:
    """Names a version of the rules: any change of one, or of their order, gives another."""
    return hashlib.sha256(repr([(*astuple(r)[:4], int(r.flags), r.any_of) for r in rules]).encode()).hexdigest()[:32]


def _scanner(rules: tuple[Rule, ...]) -> Callable[[], Callable[[pa.Array], list[pa.Array]]]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        compiled = [re.compile(r.pattern, r.flags) for r in rules]

        def work(texts: pa.Array) -> list[pa.Array]:
            out, last = [], None
            for t in texts:
                text = t.as_py() or ""
                if text != last:  # rows that repeat a path and its text come one after another
                    found, last = [dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans_of(text, rules, compiled)], text
                out.append(found)
            return [pa.array(out, kind)]

        return work

    return make


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(T.StructType([T.StructField("blob", T.StringType()), T.StructField("findings", FINDINGS), T.StructField("rules_version", T.StringType())])).parquet(path)
    except AnalysisException:
        return None


def scan_secrets(
    docs: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row for each row of docs: its path column, ``blob`` and ``findings``, sorted by start.

    The ledger is a Parquet folder, (blob, findings) partitioned by the digest of the rules; a scan
    appends what it newly found, also for blobs without findings. Null texts are empty.
    Paths may repeat with other texts (versions) or be null. Two scans at the same time may
    both append a blob; reading takes one row a blob.
    """
    spark, rules_version = docs.sparkSession, rules_digest(rules)
    path, text = quoted(path_col), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    addressed = docs.select(F.col(path).alias("path"), text.alias("text"), F.sha2(text, 256).alias("blob"))
    versions = materialize(addressed.select("path", "blob"), "versions")
    had = read_ledger(spark, ledger)
    unseen = versions.groupBy("blob").agg(F.min("path").alias("path"))
    if had is not None:
        unseen = unseen.join(had.where(F.col("rules_version") == rules_version).select("blob"), "blob", "left_anti")
    unseen = unseen.select(F.col("blob").alias("b"), F.col("path").alias("p"))
    texts = addressed.join(unseen, F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")), "left_semi")
    # rows that repeat path and text give one row of the ledger
    new = map_texts(texts, "text", ["blob"], [T.StructField("findings", FINDINGS)], _scanner(rules)).dropDuplicates(["blob"])
    with while_writing(spark):
        new.withColumn("rules_version", F.lit(rules_version)).write.mode("append").partitionBy("rules_version").parquet(ledger)
    held = read_ledger(spark, ledger).where((F.col("rules_version") == rules_version) & (F.size("findings") > 0))
    held = held.select("blob", "findings").dropDuplicates(["blob"])
    joined = versions.join(held, "blob", "left")
    none = F.array().cast(FINDINGS)
    return joined.select(F.col("path").alias(path_col), "blob", F.coalesce("findings", none).alias("findings"))
