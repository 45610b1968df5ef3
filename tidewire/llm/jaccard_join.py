"""N-gram Jaccard join by chosen paths.

A document is the set of its word shingles (five words). Equal sets become one
node. In each of several independent runs a node follows sampled tokens: at the
first level it goes to the bucket of its shingle that a random order puts first;
buckets above ``limit`` are split again by further sampled shingles, two a node,
so that a pair that shares a bucket mostly stays together. Small buckets, and
what is left at the last level, are compared by brute force; a bucket that is
still large is cut into tiles, so no task holds it whole. Runs are repeated until
pairs at the threshold are found with the target recall.

Comparing has two steps. Sketches (the sampled shingles of all runs) tell which
nodes may have a partner in a bucket at all; only for those are the full sets
fetched and the Jaccard similarity computed exactly. A pair that meets in several
buckets counts in the first of them only. Tasks return counts and a star for each
group they see, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import Words, by_key, byte_view, components, map_texts, materialize, mix64, quoted, slices, text_key, window_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Shingles sampled at each level of a run.
BRANCHES = (1, 2, 2)


def runs_needed(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met with the target recall."""
    meets = math.prod(1 - (1 - threshold) ** b for b in BRANCHES)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice of texts: sorted distinct shingle hashes, text after text, and the offsets of the texts.

    A text of fewer than n words, but not none, is one shingle.
    """
    offsets, data = byte_view(texts)
    for lo, hi in slices(offsets):
        words = Words(data, offsets[lo : hi + 1])
        hashes, rows = words.hashes(), words.rows
        windows = window_hashes(hashes, n)
        counts = np.diff(rows)
        per_row = np.where(counts >= n, counts - n + 1, 0)
        row = np.repeat(np.arange(len(counts)), per_row)
        at = np.arange(int(per_row.sum())) - np.repeat(np.cumsum(per_row) - per_row, per_row) + np.repeat(rows[:-1], per_row)
        value = windows[at]
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            whole = np.array([window_hashes(hashes[rows[i] : rows[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
            value, row = np.concatenate((value, whole)), np.concatenate((row, short))
        order = np.argsort(value)
        order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
        value, row = value[order], row[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
        yield value, np.searchsorted(row, np.arange(len(counts) + 1))


def _digests(value: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each set; None for an empty one."""
    return [hashlib.blake2b(value[i:j].tobytes(), digest_size=16).digest() if j > i else None for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def _samples(value: np.ndarray, offsets: np.ndarray, many: int) -> np.ndarray:
    """(sets, many): for each of ``many`` random orders of shingles the least shingle of each set, as its rank value."""
    out = np.zeros((len(offsets) - 1, many), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[:-1][full]
        for k in range(many):
            odd = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)
            ranked = (value ^ (value >> np.uint64(29)) ^ odd) * (odd | np.uint64(1))
            ranked ^= ranked >> np.uint64(32)
            out[full, k] = np.minimum.reduceat(ranked * np.uint64(0xD6E8FEB86659FD93), starts)
    return mix64(out)


def sketch(docs: DataFrame, id_col: str, text_col: str, n: int, runs: int) -> DataFrame:
    """(_id, _key, node, n_set, paths): the id and a hash of the text; the digest of the set, its size, and its sampled shingles of all runs and levels."""
    many = runs * sum(BRANCHES)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        def work(texts: pa.Array) -> list[pa.Array]:
            nodes, sizes, paths = [], [], []
            for value, offsets in shingle_sets(texts, n):
                nodes += _digests(value, offsets)
                sizes.append(np.diff(offsets))
                paths += [row.tobytes() for row in _samples(value, offsets, many)]
            return [pa.array(nodes, pa.binary()), pa.array(np.concatenate(sizes), pa.int64()), pa.array(paths, pa.binary())]

        return work

    fields = [T.StructField("node", T.BinaryType()), T.StructField("n_set", T.LongType()), T.StructField("paths", T.BinaryType())]
    text = F.col(quoted(text_col)).cast("string")
    ids = docs.select(F.col(quoted(id_col)).alias("_id"), text.alias("_text"), text_key(text).alias("_key"))
    return map_texts(ids, "_text", ["_id", "_key"], fields, make)


def with_nodes(docs: DataFrame, keep: list[str], text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and ``node``, the digest of each document's shingle set; null without words."""

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        return lambda texts: [pa.array([x for value, offsets in shingle_sets(texts, n) for x in _digests(value, offsets)], pa.binary())]

    return map_texts(docs, text_col, keep, [T.StructField("node", T.BinaryType())], make)


def _token(run: Column, place: Column) -> Column:
    """The sampled shingle of a run at a place, as 8 bytes."""
    return F.substring(F.col("paths"), (run * sum(BRANCHES) + place) * 8 + 1, F.lit(8))


def with_size(members: DataFrame, least: int, heavy: int = 4096) -> DataFrame:
    """Members of leaves of at least ``least`` with the size ``m`` of their leaf. Leaves with more than one in ``heavy``
    of all members, fewer than heavy of them, are broadcast; a join by leaf would deal each to one task."""
    sizes = materialize(members.groupBy("leaf").agg(F.count("*").alias("m")).where(F.col("m") >= least), "sizes")
    total = sizes.agg(F.sum("m")).first()[0] or 0
    large, small = sizes.where(F.col("m") * heavy > total), sizes.where(F.col("m") * heavy <= total)
    return members.join(F.broadcast(large), "leaf").unionByName(members.join(small, "leaf"))


def leaves(nodes: DataFrame, runs: int, limit: int) -> DataFrame:
    """(leaf, node): the buckets of at least two nodes in which each run ends."""
    done = []
    each = F.explode(F.array(*[F.lit(r) for r in range(runs)]))
    level = nodes.select("node", "paths", each.alias("run")).select("node", "run", F.xxhash64("run", _token(F.col("run"), F.lit(0))).alias("leaf"))
    at = BRANCHES[0]
    for depth in range(len(BRANCHES)):
        level = materialize(with_size(materialize(level, "level"), 2), "buckets")
        last = depth == len(BRANCHES) - 1
        done.append(level if last else level.where(F.col("m") <= limit))
        if last:
            break
        large = level.where(F.col("m") > limit).select("leaf", "node", "run").join(nodes.select("node", "paths"), "node")
        places = F.explode(F.array(*[F.lit(at + i) for i in range(BRANCHES[depth + 1])]))
        level = large.withColumn("place", places).select("node", "run", F.xxhash64("leaf", "place", _token(F.col("run"), F.col("place"))).alias("leaf"))
        at += BRANCHES[depth + 1]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("leaf", "node", "m").distinct()


def tiles(members: DataFrame, tile: int) -> DataFrame:
    """Gives each member of a leaf of m nodes its ``part`` of ceil(m / tile), and copies it to each
    pair (part, other part): ``task``, a hash of leaf and pair. Leaves of one tile are one task."""
    parts = F.ceil(F.col("m") / tile).cast("int")
    dealt = members.withColumn("_parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    low, high = F.least("part", "_with"), F.greatest("part", "_with")
    return dealt.withColumns({"task": F.xxhash64("leaf", low, high), "low": low, "high": high}).drop("_with")


class Tile:
    """The nodes of a task: which pairs are to be compared here."""

    def __init__(self, table: pa.Table):
        nodes = table["node"].to_pylist()
        first = {}
        for i, x in enumerate(nodes):
            first.setdefault(x, i)
        pick = sorted(first.values())
        self.nodes = [nodes[i] for i in pick]
        self.pick = np.array(pick)
        self.part = table["part"].to_numpy()[self.pick]
        self.leaf, self.low, self.high = (table[c][0].as_py() for c in ("leaf", "low", "high"))
        self.leaves = [table["leaves"][i].as_py() for i in pick]
        self.size = table["n_set"].to_numpy()[self.pick]

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the two sides; twice the same in a task of one part."""
        return np.flatnonzero(self.part == self.low), np.flatnonzero(self.part == self.high)

    def elsewhere(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(a, b): whether the two share a leaf that comes before this one."""
        out = np.zeros((len(a), len(b)), bool)
        codes: dict[int, int] = {}
        lists = [[codes.setdefault(x, len(codes)) for x in self.leaves[i] if x < self.leaf] for i in range(len(self.nodes))]
        holds: dict[int, tuple[list[int], list[int]]] = {}
        for side, index in enumerate((a, b)):
            for row, i in enumerate(index.tolist()):
                for x in lists[i]:
                    holds.setdefault(x, ([], []))[side].append(row)
        for left, right in holds.values():
            if left and right:
                out[np.ix_(left, right)] = True
        return out


def may_match(batches: Iterable[pa.RecordBatch], many: int, least: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Of each task's nodes those that have a partner here by their sketches, in a pair that belongs here."""
    for table in by_key(batches):
        t = Tile(table)
        a, b = t.sides()
        paths = np.frombuffer(b"".join(table["paths"][i].as_py() for i in t.pick.tolist()), np.uint64).reshape(len(t.pick), many)
        short = (paths & np.uint64(0xFFFF)).astype(np.uint16)
        near = np.zeros((len(a), len(b)), bool)
        for lo in range(0, len(a), 256):
            same = np.zeros((len(a[lo : lo + 256]), len(b)), np.uint8)
            for k in range(many):
                same += short[a[lo : lo + 256], k][:, None] == short[b, k][None, :]
            near[lo : lo + 256] = same >= least
        near &= a[:, None] != b[None, :]
        near &= np.minimum.outer(t.size[a], t.size[b]) >= threshold * np.maximum.outer(t.size[a], t.size[b]) - 1
        if near.any():
            near &= ~t.elsewhere(a, b)
        keep = np.zeros(len(t.nodes), bool)
        keep[a[near.any(1)]] = True
        keep[b[near.any(0)]] = True
        kept = [x for x, k in zip(t.nodes, keep, strict=True) if k]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([t.leaf] * len(kept), pa.int64()), pa.array(kept, pa.binary())], names=["leaf", "node"])


def verify(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each node of a task: its links here (documents, and texts), and the least node of its group here."""
    for table in by_key(batches):
        t = Tile(table)
        a, b = t.sides()
        shared = _intersections([np.frombuffer(table["shingles"][i].as_py(), np.uint64) for i in t.pick.tolist()], a, b)
        weight = table["weight"].to_numpy()[t.pick]
        link = np.zeros(shared.shape, bool)
        for i, x in enumerate(a.tolist()):
            union = (t.size[x] + t.size[b]) - shared[i]
            link[i] = (shared[i] >= threshold * union - 1e-6) & (b != x)
        del shared
        if not link.any():
            continue
        root = _roots(len(t.nodes), a, b, link)
        link &= ~t.elsewhere(a, b)
        texts, documents = np.zeros(len(t.nodes), np.int64), np.zeros(len(t.nodes), np.int64)
        for i, x in enumerate(a.tolist()):
            mine = b[link[i]]
            texts[x] += len(mine)
            documents[x] += weight[mine].sum()
            if t.low != t.high:
                texts[mine] += 1
                documents[mine] += weight[x]
        least: dict[int, bytes] = {}
        for i, r in enumerate(root):
            least[r] = min(least.get(r, t.nodes[i]), t.nodes[i])
        rows = [i for i in range(len(t.nodes)) if texts[i] or root[i] != i]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([t.nodes[i] for i in rows], pa.binary()),
                pa.array([least[root[i]] for i in rows], pa.binary()),
                pa.array(documents[rows], pa.int64()),
                pa.array(texts[rows], pa.int64()),
            ],
            names=["node", "least", "n_links", "n_text_links"],
        )


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a, b): how many shingles two sets share, by products of 0/1 matrices over blocks of the shingles that several sets have."""
    value = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(value)
    value, row = value[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    count = np.diff(np.append(first, len(value)))
    common = int((count == len(sets)).sum())
    useful = (count > 1) & (count < len(sets))
    column = np.repeat((np.cumsum(useful) - 1).astype(np.int32), count)[np.repeat(useful, count)]
    row = row[np.repeat(useful, count)]
    del value, order
    out = np.full((len(a), len(b)), common, np.float32)
    many, step = int(useful.sum()), max(64, (1 << 20) // max(1, len(sets)))
    for lo in range(0, many, step):
        i, j = np.searchsorted(column, (lo, lo + step))
        has = np.zeros((len(sets), min(step, many - lo)), np.float32)
        has[row[i:j], column[i:j] - lo] = 1
        out += has[a] @ has[b].T
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray, link: np.ndarray) -> list[int]:
    """The group of each node, by spreading over links."""
    root = [-1] * n
    of_a, of_b = {int(x): i for i, x in enumerate(a)}, {int(x): i for i, x in enumerate(b)}
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start] = start
        front = [start]
        while front:
            x = front.pop()
            near = []
            if x in of_a:
                near += b[link[of_a[x]]].tolist()
            if x in of_b:
                near += a[link[:, of_b[x]]].tolist()
            for y in near:
                if root[y] < 0:
                    root[y] = start
                    front.append(y)
    return root


def jaccard_groups(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    n: int = SHINGLE,
    recall: float = 0.999,
    limit: int = 128,
    tile: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document: its id, ``node`` (digest of its shingle set), ``class_node`` (the least digest of its class), ``class_id`` (the least id
    of all documents that links join with it), ``text_id`` (the least id with the same set),
    ``n_links`` (other documents at or above the threshold, equal ones too) and
    ``n_text_links`` (other sets at or above it).

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. Fewer than n words
    make one shingle. Documents without words link to nothing; their class is their own id.
    Rows without an id link like all others; a class of only such rows has a null id.
    """
    runs = runs_needed(threshold, recall)
    many = runs * sum(BRANCHES)
    # a pair at the threshold has fewer equal samples with a chance of about 1e-5
    least = max(1, math.floor(many * threshold - 4.3 * math.sqrt(many * threshold * (1 - threshold))))
    drawn = materialize(sketch(docs, id_col, text_col, n, runs), "sketches")
    nodes = drawn.where("node is not null").groupBy("node").agg(
        F.min("_id").alias("text_id"),
        F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_key")).alias("held_by"),
        F.count("*").alias("weight"),
        F.first("n_set").alias("n_set"),
        F.first("paths").alias("paths"),
    )
    nodes = materialize(nodes, "nodes")
    held = materialize(leaves(nodes, runs, limit), "leaves")
    of_node = held.groupBy("node").agg(F.collect_list("leaf").alias("leaves")).join(nodes.select("node", "n_set", "paths"), "node")
    at = tiles(held.join(of_node, "node"), tile).select("task", "leaf", "low", "high", "node", "part", "leaves", "n_set", "paths")
    at = at.repartition("task").sortWithinPartitions("task", "node")
    near = at.mapInArrow(lambda b: may_match(b, many, least, threshold), "leaf long, node binary").distinct()
    near = materialize(near, "near")
    # one text of each wanted set, by id and text, so that rows without an id meet only those with their own text
    wanted = near.select("node").distinct().join(nodes.select("node", "held_by"), "node")
    wanted = wanted.select(F.col("node").alias("_want"), F.col("held_by._id").alias("_want_id"), F.col("held_by._key").alias("_want_key"))
    text = F.col(quoted(text_col)).cast("string")
    texts = docs.select(F.col(quoted(id_col)).alias("_id"), text.alias("_text"), text_key(text).alias("_key"))
    texts = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_want_id")) & (F.col("_key") == F.col("_want_key"))).select("_want", "_text")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, want = 0, batch.column(0).to_pylist()
            for value, offsets in shingle_sets(batch.column(1), n):
                digests = _digests(value, offsets)
                rows = [i for i, x in enumerate(digests) if x is not None and x == want[at + i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[i] for i in rows], pa.binary()), pa.array([value[offsets[i] : offsets[i + 1]].tobytes() for i in rows], pa.binary())],
                    names=["node", "shingles"],
                )
                at += len(digests)

    # rows that repeat id and text bring their set more than once
    sets = texts.mapInArrow(fetch, "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    left = with_size(near, 1)
    every = held.groupBy("node").agg(F.collect_list("leaf").alias("leaves")).join(nodes.select("node", "n_set", "weight"), "node")
    full = left.join(every, "node").join(sets, "node")
    full = tiles(full, tile).select("task", "leaf", "low", "high", "node", "part", "leaves", "n_set", "weight", "shingles")
    full = full.repartition("task").sortWithinPartitions("task", "node")
    found = full.mapInArrow(lambda b: verify(b, threshold), "node binary, least binary, n_links long, n_text_links long")
    found = materialize(found, "links")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("_links"), F.sum("n_text_links").alias("_texts"))
    roots = components(found.select("node", "least"), "node", "least").withColumnRenamed("root", "_root")
    classes = nodes.select("node", "text_id", "weight").join(counts, "node", "left").join(roots, "node", "left").withColumn("_root", F.coalesce("_root", "node"))
    classes = materialize(classes, "classes")
    of_root = classes.groupBy("_root").agg(F.min("text_id").alias("class_id"))
    classes = classes.join(of_root, "_root").select("node", F.col("_root").alias("class_node"), "text_id", "class_id", "weight", "_links", "_texts").withColumnRenamed("node", "_node")
    out = drawn.select("_id", "node").join(classes, F.col("node") == F.col("_node"), "left")
    return out.select(
        F.col("_id").alias(id_col),
        "node",
        "class_node",
        F.coalesce("class_id", F.when(F.col("node").isNull(), F.col("_id"))).alias("class_id"),
        F.coalesce("text_id", F.when(F.col("node").isNull(), F.col("_id"))).alias("text_id"),
        (F.coalesce("_links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).alias("n_links"),
        F.coalesce("_texts", F.lit(0)).cast("long").alias("n_text_links"),
    )
