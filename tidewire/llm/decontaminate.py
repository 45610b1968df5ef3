"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The benchmark's windows of ``n`` consecutive words are hashed into a sorted set
that is broadcast; one pass over the documents hashes their windows, looks each
one up, verifies the hits word by word, and marks the words they cover. Nothing
of the documents is shuffled. The set is broadcast only below
``max_broadcast_bytes``; a larger benchmark is split by hash into blocks below
that bound, and the documents pass over one block after another.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import Words, byte_view, fresh, map_texts, materialize, quoted, slices, window_hashes

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", SPANS),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
]


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (window, n_words, item): windows of n words; of all words for shorter texts."""

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        def work(texts: pa.Array) -> list[pa.Array]:
            offsets, data = byte_view(texts)
            words, out = Words(data, offsets), []
            for lo, hi in zip(words.rows[:-1], words.rows[1:], strict=True):
                k = min(n, hi - lo)
                out.append([{"window": words.text(i, i + k).decode("utf-8", "surrogateescape"), "k": int(k)} for i in range(lo, hi - k + 1)] if k else [])
            return [pa.array(out, pa.list_(pa.struct([("window", pa.string()), ("k", pa.int32())])))]

        return work

    kind = T.ArrayType(T.StructType([T.StructField("window", T.StringType()), T.StructField("k", T.IntegerType())]))
    items = benchmark.select(F.col(quoted(id_col)).cast("string").alias("item"), F.col(quoted(text_col)).alias("text"))
    found = map_texts(items, "text", ["item"], [T.StructField("w", kind)], make)
    return found.select("item", F.explode("w").alias("w")).select("w.window", "w.k", "item").distinct()


class WindowSet:
    """Sorted window hashes by window length, a bit table before them, and the windows themselves."""

    def __init__(self, rows: list[tuple[str, int, str | None]]):
        self.items: dict[bytes, list[str | None]] = {}
        by_len: dict[int, list[bytes]] = {}
        for window, k, item in rows:
            key = window.encode()
            if key not in self.items:
                by_len.setdefault(k, []).append(key)
            self.items.setdefault(key, []).append(item)
        self.tables = {}
        for k, keys in by_len.items():
            joined = pa.array([x.decode() for x in keys], pa.large_string())
            offsets, data = byte_view(joined)
            words = Words(data, offsets)
            hashes = np.unique(window_hashes(words.hashes(), k)[words.rows[:-1]])
            bits = max(16, min(24, int(math.log2(max(1, len(hashes)))) + 6))
            mask = np.uint64((1 << bits) - 1)
            table = np.zeros(1 << bits, bool)
            table[hashes & mask] = True
            self.tables[k] = (hashes, table, mask)

    def hits(self, k: int, hashes: np.ndarray) -> np.ndarray:
        known, table, mask = self.tables[k]
        maybe = np.flatnonzero(table[hashes & mask])
        place = np.searchsorted(known, hashes[maybe])
        place[place == len(known)] = 0
        return maybe[known[place] == hashes[maybe]]


def _scan(windows: WindowSet, texts: pa.Array) -> list[pa.Array]:
    offsets, data = byte_view(texts)
    counts, spans, items = [], [], []
    for lo, hi in slices(offsets):
        words = Words(data, offsets[lo : hi + 1])
        hashes, rows = words.hashes(), words.rows
        change = np.zeros(len(hashes) + 1, np.int32)
        found: dict[int, set] = {}
        for k in windows.tables:
            for i in windows.hits(k, window_hashes(hashes, k)).tolist():
                row = int(np.searchsorted(rows, i, "right")) - 1
                if i + k <= rows[row + 1] and (got := windows.items.get(words.text(i, i + k))) is not None:
                    change[i] += 1
                    change[i + k] -= 1
                    found.setdefault(row, set()).update(got)
        hit = np.cumsum(change[:-1]) > 0
        for row, (i, j) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
            counts.append(j - i)
            if row in found:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[i:j].view(np.int8), [0]))))
                spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
                items.append(sorted(x for x in found[row] if x is not None))
            else:
                spans.append([])
                items.append([])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return [pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    keep: list[str] | None = None,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_broadcast_bytes: int = 64 << 20,
    words_a_hit: int = 20,
) -> DataFrame:
    """The columns ``keep`` (all, if None) and, for each document, ``n_words``, ``hit_words``
    (spans of word positions, end exclusive), ``item_ids`` (sorted), ``n_hit`` and
    ``contaminated`` (some word hit, and at least one in ``words_a_hit``).

    Null and empty texts have no words and are never contaminated. Items without words
    have no window; items with a null id mark words but are not listed. An empty
    benchmark marks nothing. Repeated rows are judged each on its own.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    windows = materialize(benchmark_windows(benchmark, n, item_col, item_text_col), "windows")
    size = windows.agg(F.sum(F.octet_length("window") * 2 + F.coalesce(F.octet_length("item"), F.lit(0)) + 200)).first()[0] or 0
    blocks = max(1, math.ceil(size / max_broadcast_bytes))
    out, spans_col, items_col = None, fresh("_spans", docs), fresh("_items", docs)
    for block in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # below max_broadcast_bytes

        def make(shared=shared) -> Callable[[pa.Array], list[pa.Array]]:
            known = WindowSet(shared.value)
            return lambda texts: _scan(known, texts)

        if blocks == 1:
            out = map_texts(docs, text_col, keep, FIELDS, make)
        else:
            # each pass adds its block's hits; written out, so that one set at a time is held
            had = [] if out is None else [spans_col, items_col]
            source = docs if out is None else out
            all_cols = list(dict.fromkeys([*keep, text_col]))
            more = map_texts(source, text_col, [*all_cols, *had], FIELDS, make)
            spans = F.concat(spans_col, "hit_words") if had else F.col("hit_words")
            ids = F.array_union(items_col, "item_ids") if had else F.col("item_ids")
            left = [F.col(quoted(c)) for c in all_cols if c not in {f.name for f in FIELDS}]
            out = materialize(more.select(*left, spans.alias(spans_col), ids.alias(items_col), "n_words"), "passes")
    if blocks > 1:
        names = [F.col(quoted(c)) for c in keep if c not in {f.name for f in FIELDS}]
        out = out.select(*names, "n_words", _merged(F.col(spans_col)).alias("hit_words"), F.array_sort(items_col).alias("item_ids"))
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    out = out.withColumn("n_hit", hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * words_a_hit >= F.col("n_words")))


def _merged(spans):
    """Overlapping or touching spans as one, by start."""
    kind = "array<struct<start:int,end:int>>"

    def step(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        touch = (F.size(done) > 0) & (s["start"] <= F.when(F.size(done) > 0, last["end"]).otherwise(-1))
        return F.when(touch, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def remove_hits(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts without the words that windows cover, and without what stands between those words."""
    gap = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
    text = F.col(quoted(text_col))
    parts = F.split(text, f"(?<=[^{gap}])(?=[{gap}])")  # a part a word: what precedes the word, and the word
    kept = F.filter(parts, lambda p, i: ~F.exists("hit_words", lambda s: (i >= s["start"]) & (i < s["end"])))
    return found.withColumn(text_col, F.when(F.size("hit_words") > 0, F.array_join(kept, "")).otherwise(text))
