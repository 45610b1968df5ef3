"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts texts into chunks: where the hash falls
below a bound, at least ``MIN_CHUNK`` bytes after the last cut, at most ``MAX_CHUNK``.
Cuts depend on nearby bytes only, so an insertion shifts no cut beyond its surroundings.
Chunks are deduplicated by a 128-bit digest: the first occurrence in (document, place)
order stays. A later one is an anchor: runs of them that repeat one place of one document
are extended byte by byte to both sides as far as both texts agree, which is less than a chunk.
What is repeated so goes if it has at least ``min_words`` words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import byte_view, discard, map_texts, materialize, quoted, slices, text_key

MIN_CHUNK, MEAN_MORE, MAX_CHUNK = 24, 24, 192
_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 32, 256, dtype=np.uint32)
CHUNKS = T.ArrayType(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
#: How many repeated rows of a document one task writes together.
LOT = 4096


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gear values of it and the 15 before, each shifted left by its distance."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint32(width)
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """The chunk ends of each text, counted from the text's start."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    # 16 bytes of the text before decide nothing: MIN_CHUNK is longer
    ends = np.flatnonzero(gear_hashes(part) < (1 << 32) // MEAN_MORE) + 1
    marks = np.searchsorted(ends, offsets - base, "right")
    ends = ends.tolist()
    out = []
    for row in range(len(offsets) - 1):
        start, stop = int(offsets[row]) - base, int(offsets[row + 1]) - base
        last, mine = start, []
        for e in ends[marks[row] : marks[row + 1]]:
            if e - last < MIN_CHUNK or e >= stop:
                continue
            while e - last > MAX_CHUNK:
                last += MAX_CHUNK
                mine.append(last - start)
            if e - last >= MIN_CHUNK:
                mine.append(e - start)
                last = e
        while stop - last > MAX_CHUNK:
            last += MAX_CHUNK
            mine.append(last - start)
        if stop > last:
            mine.append(stop - start)
        out.append(mine)
    return out


def chunks(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The columns ``keep``, and (digest, start, end) of each chunk, in bytes."""
    kind = pa.struct([("digest", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        def work(texts: pa.Array) -> list[pa.Array]:
            offsets, data = byte_view(texts)
            raw = memoryview(data)
            digests, starts, ends, sizes = [], [], [], [0]
            for lo, hi in slices(offsets):
                for row, mine in enumerate(cuts(data, offsets[lo : hi + 1]), lo):
                    at = int(offsets[row])
                    before = [0, *mine[:-1]] if mine else []
                    digests += [xxhash.xxh3_128_digest(raw[at + s : at + e]) for s, e in zip(before, mine, strict=True)]
                    starts += before
                    ends += mine
                    sizes.append(len(ends))
            rows = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(kind))
            return [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)]

        return work

    return map_texts(docs, text_col, keep, [T.StructField("chunks", CHUNKS)], make)


def runs(again: DataFrame) -> DataFrame:
    """Later occurrences (id, key, start, end, fid, fkey, fstart) joined where they touch and repeat one stretch of one document."""
    spot = F.struct("start", "end", "fkey", "fstart", "fid")
    listed = again.groupBy("id", "key").agg(F.array_sort(F.collect_set(spot)).alias("spots"))  # one document's chunks
    kinds = {f.name: f for f in again.schema.fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), spots.value_lengths().to_numpy())
            start, end, fkey, fstart, fid = spots.flatten().flatten()
            s, e, k, f = (x.to_numpy() for x in (start, end, fkey, fstart))
            code = fid.dictionary_encode().indices.fill_null(-1).to_numpy()
            new = np.ones(len(s), bool)
            new[1:] = (row[1:] != row[:-1]) | (s[1:] != e[:-1]) | (k[1:] != k[:-1]) | (code[1:] != code[:-1]) | (f[1:] - s[1:] != f[:-1] - s[:-1])
            at = np.flatnonzero(new)
            stop = e[np.append(at[1:], len(s)) - 1] if len(at) else e[:0]
            rows = pa.array(row[at])
            here = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), start.take(here), pa.array(stop), fid.take(here), fkey.take(here), fstart.take(here), pa.array((f[at] + stop - s[at]).astype(np.int32))],
                names=["id", "key", "start", "end", "fid", "fkey", "fstart", "fend"],
            )

    names = ["id", "key", "start", "end", "fid", "fkey", "fstart"]
    return listed.mapInArrow(run, T.StructType([kinds[c] for c in names] + [T.StructField("fend", T.IntegerType())]))


def surroundings(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(fid, fkey, at, before, after): the bytes on both sides of each end of the stretches that runs repeat."""
    ends = found.select("fid", "fkey", F.col("fstart").alias("at")).union(found.select("fid", "fkey", "fend")).distinct()
    asked = ends.groupBy("fid", "fkey").agg(F.collect_list("at").alias("asked"))  # at most two for each chunk of the document
    texts = docs.join(asked.hint("merge"), F.col("id").eqNullSafe(F.col("fid")) & (F.col("key") == F.col("fkey"))).select("fid", "fkey", "text", "asked")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = byte_view(batch.column(2))
            row, at, before, after = [], [], [], []
            for i, asked in enumerate(batch.column(3).to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                row += [i] * len(asked)
                at += asked
                before += [raw[max(0, x - MAX_CHUNK) : x] for x in asked]
                after += [raw[x : x + MAX_CHUNK] for x in asked]
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["fid", "fkey", "at", "before", "after"])

    return texts.mapInArrow(run, T.StructType([texts.schema["fid"], texts.schema["fkey"], *(T.StructField(c, k) for c, k in (("at", T.IntegerType()), ("before", T.BinaryType()), ("after", T.BinaryType())))]))


_IN_WORD = np.ones(256, bool)
_IN_WORD[list(b" \t\r\n\v\f")] = False


def _agree(a: bytes, b: bytes) -> int:
    """How many bytes a and b begin with alike."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def _repeated(raw: np.ndarray, spots: list[dict], min_words: int) -> list[tuple[int, int]]:
    """The spans of a text that go: runs extended, joined, drawn in to whole words and characters, and long enough."""
    text, wide = raw.tobytes(), []
    for s in spots:
        lo, hi = s["start"], s["end"]
        lo -= _agree(text[max(0, lo - MAX_CHUNK) : lo][::-1], (s["before"] or b"")[::-1])
        hi += _agree(text[hi : hi + MAX_CHUNK], s["after"] or b"")
        wide.append((lo, hi))
    joined: list[tuple[int, int]] = []
    for lo, hi in sorted(wide):
        if joined and lo <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(hi, joined[-1][1])
        else:
            joined.append((lo, hi))
    out = []
    for lo, hi in joined:
        if lo and _IN_WORD[raw[lo - 1]]:  # a word that begins before stays
            while lo < hi and _IN_WORD[raw[lo]]:
                lo += 1
        if hi < len(raw) and _IN_WORD[raw[hi]]:
            while hi > lo and _IN_WORD[raw[hi - 1]]:
                hi -= 1
        inside = _IN_WORD[raw[lo:hi]]
        if hi > lo and int(inside[0]) + int((inside[1:] & ~inside[:-1]).sum()) >= min_words:
            out.append((lo, hi))
    return out


def dedup_substrings(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: its id, ``text`` without repeated passages, ``n_bytes`` (before),
    ``n_removed`` (bytes) and ``removed`` (spans of bytes of the text before).

    A chunk's first occurrence is that in the document with the least id (nulls first), then the least
    ``text_key``, then the least place: documents that share an id, or have none, are judged each on its own.
    Rows that repeat both id and text are one document; all but one of them lose their texts: they are counted, and their rows
    made anew from the counts.
    Null texts stay null. Spans keep to whole words; a text without blanks is one word, and stays
    unless ``min_words`` is 1. Only chunks that occur twice are joined back; a chunk in a third of all
    documents is counted by partial sums, and its rows are dealt out again by skew handling.
    """
    text = F.col(quoted(text_col)).cast("string")
    base = docs.select(F.col(quoted(id_col)).alias("id"), text_key(text).alias("key"), text.alias("text"))
    each = chunks(base, ["id", "key"], "text").select("id", "key", F.explode("chunks").alias("c")).select("id", "key", "c.*")
    counted = each.groupBy("digest").agg(F.min(F.struct("id", "key", "start")).alias("first"), F.max(F.struct("id", "key", "start")).alias("last"))
    repeated = materialize(counted.where("first != last").select("digest", F.col("first.id").alias("fid"), F.col("first.key").alias("fkey"), F.col("first.start").alias("fstart")), "repeats")
    first = F.col("id").eqNullSafe(F.col("fid")) & (F.col("key") == F.col("fkey")) & (F.col("start") == F.col("fstart"))
    again = each.join(repeated, "digest").where(~first).select("id", "key", "start", "end", "fid", "fkey", "fstart")
    found = materialize(runs(again), "runs")
    discard(repeated)
    # rows that repeat a document give the same surroundings
    near = materialize(surroundings(base, found).dropDuplicates(["fid", "fkey", "at"]), "surroundings")
    sides = [near.select(F.col("fid").alias("_id"), F.col("fkey").alias("_key"), "at", c) for c in ("before", "after")]
    of = lambda at: F.col("fid").eqNullSafe(F.col("_id")) & (F.col("fkey") == F.col("_key")) & (F.col(at) == F.col("at"))
    wide = found.join(sides[0], of("fstart"), "left").drop("_id", "_key", "at").join(sides[1], of("fend"), "left")
    spots = wide.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "end", "before", "after")).alias("spots"))
    spots = materialize(spots, "spots")
    discard(found, near)
    joined = base.join(spots, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").drop("_id", "_key")
    # rows that repeat id and text are told by both, as keys of different texts may be equal; tasks count theirs before the shuffle
    twins = materialize(base.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.lit(True).alias("twin")), "twins")
    joined = joined.join(twins, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("id", "text", "spots", "key", "twin")
    of_twins = joined.where("twin").groupBy("id", "key", F.sha2("text", 256).alias("digest"))
    one = materialize(of_twins.agg(F.count("*").alias("n"), F.first("text").alias("text"), F.first("spots").alias("spots")), "ones")
    judged = joined.where("twin is null").select("id", "text", "spots").unionByName(one.select("id", "text", "spots"))
    fields = [judged.schema["id"], T.StructField("text", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", SPANS)]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = part.column(1)
                offsets, data = byte_view(texts)
                out, gone, taken = [], [], []
                for i, mine in enumerate(part.column(2)):
                    raw = data[offsets[i] : offsets[i + 1]]
                    spans = _repeated(raw, mine.as_py(), min_words) if mine.is_valid else []
                    if spans:
                        parts = [raw[a:b].tobytes() for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True)]
                        out.append(b"".join(parts).decode())
                    else:
                        out.append(texts[i].as_py())
                    gone.append(sum(e - s for s, e in spans))
                    taken.append([{"start": s, "end": e} for s, e in spans])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array(np.diff(offsets)), pa.array(gone, pa.int64()), pa.array(taken, span)], names=[f.name for f in fields])

    stays = judged.mapInArrow(run, T.StructType(fields))
    # the others of each are dealt out in lots, so that no task writes all rows of one document
    lots = one.where("n > 1").select("id", F.octet_length("text").cast("long").alias("size"), (F.col("n") - 1).alias("more"))
    lots = lots.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("more") - 1) / LOT)))).repartition("id", "lot")
    each = lots.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(LOT).cast("long"), F.col("more") - F.col("lot") * LOT))))
    size, whole = F.coalesce("size", F.lit(0).cast("long")), F.array(F.struct(F.lit(0).alias("start"), F.col("size").cast("int").alias("end")))
    gone = each.select("id", F.when(F.col("size").isNotNull(), "").alias("text"), size.alias("n_bytes"), size.alias("n_removed"), F.when(size > 0, whole).otherwise(F.array()).cast(SPANS).alias("removed"))
    return stays.unionByName(gone).withColumnsRenamed({"id": id_col, "text": text_col})
