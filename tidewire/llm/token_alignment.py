"""Alignment of two tokenizers over a corpus, each distinct segment once.

Texts are cut before white-space runs that neither vocabulary can merge across,
which is checked on the vocabularies themselves. What is between two cuts, a
segment, is tokenised and aligned alike wherever it occurs, so that is done once
for each distinct segment of the corpus:

1. Tasks put their documents into blocks of some MB, each stored as one row with its
   distinct segments and, for each document, the numbers of its segments in order.
2. Segments are dealt into buckets by a hash. A bucket encodes its distinct segments by both
   tokenizers and cuts them into groups where tokens of both end at one byte.
3. Links (the last tokens of each group) are counted by id pair over all buckets; the counts
   are joined back to the buckets, whose segments look them up.
4. What a block's segments hold is brought back to it, and it composes its documents.

Only segments are shuffled, never their occurrences, as arrays of one block and
bucket. A segment comes at most once from each block and an id pair once from each
bucket, so however common one is, its rows are no more than there are blocks or
buckets. Buckets are as many as the counted segments ask for.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import discard, materialize, new_folder, quoted, while_writing

#: White space as byte-level pre-tokenizers see it (the Unicode property).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: What stands for a space in the pieces of the second vocabulary.
SPACE_PIECE = "▁"
#: Characters of text in a block: a task holds its distinct segments and the numbers of all of them.
BLOCK_CHARS = 24_000_000
#: Segments, counted once for each block, in a bucket.
BUCKET_SEGMENTS = 200_000
#: A block's segments are stored apart from its documents, as they are read first and then no more.
PARTS = ("segments", "documents")
#: Segments encoded at once.
ENCODED = 16_384


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it shows, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def first_tokenizer(path: str):
    """(tokenizer, bytes of each id) of a byte-level BPE file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        raise ValueError(f"{path}: not a byte-level vocabulary that splits before white space and leaves texts as they are")
    byte = _byte_level()
    vocab = spec["model"]["vocab"]
    if not set(byte) <= set(vocab):
        raise ValueError(f"{path}: some bytes have no token")
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer, table


@lru_cache(maxsize=4)
def second_tokenizer(path: str):
    """(processor, bytes of each id, plain pieces) of a piece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE_PIECE, " ").encode() for i, p in enumerate(pieces)]
    if sum(map(model.is_byte, range(len(pieces)))) != 256:
        raise ValueError(f"{path}: some bytes have no piece")
    if model.normalize("a  b ") != "▁a▁▁b▁":
        raise ValueError(f"{path}: it does not keep white space or adds no space in front")
    plain = [p for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return model, table, plain


def safe_cuts(a_path: str, b_path: str) -> str:
    """The white space before which a text may be cut, if what precedes is not white.

    The first tokenizer splits there before it merges (``first_tokenizer`` checks that it is of that kind). The second
    may merge anything that its pieces hold, so no piece may have the character after another one; for a space,
    after one that is not white.
    """
    first_tokenizer(a_path)
    _, _, pieces = second_tokenizer(b_path)
    inner = {c for p in pieces for c in p[1:]}
    found = [c for c in WHITE if c != " " and c not in inner]
    if not any(re.search(f"[^{SPACE_PIECE}{re.escape(WHITE)}]{SPACE_PIECE}", p) for p in pieces):
        found.append(" ")
    return "".join(found)


def segment_pattern(cuts: str) -> re.Pattern:
    """Matches the segments of a space and a text with something in it that is not white; white space at the end is part of the last."""
    white, cut = f"[{re.escape(WHITE)}]", f"[{re.escape(cuts)}]" if cuts else r"(?!)"
    solid = f"[^{re.escape(WHITE)}]+"
    return re.compile(f"{white}*{solid}(?:(?!{cut}){white}+{solid})*(?:{white}+\\Z)?")


def cut_text(pattern: re.Pattern, text: str) -> list[str]:
    return pattern.findall(" " + text) or [" " + text]


def for_second(segment: str) -> str:
    """What the second tokenizer, which adds a space, is given for a segment."""
    return segment[1:] if segment[0] == " " else segment


def pack(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of ``lengths`` numbers each, seven bits a byte."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(5):
        has = size > k
        out[end[has] - size[has] + k] = (values[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    at = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(lengths)))]
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(raw < 128)[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.concatenate((first, [len(raw)]))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, first)


class _Numbers(dict):
    """Numbers keys in order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _lossy(model, segs: list[str]) -> np.ndarray:
    """Which segments the second tokenizer does not give back: its normalisation changes them."""
    out = np.zeros(len(segs), bool)
    for lo in range(0, len(segs), ENCODED):
        given = [for_second(s) for s in segs[lo : lo + ENCODED]]
        out[lo : lo + ENCODED] = [n.replace(SPACE_PIECE, " ") != " " + g for n, g in zip(model.normalize(given), given, strict=True)]
    return out


def _hashes(segs: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, segs), np.int64, len(segs))


def _one(values: pa.Array) -> pa.ListArray:
    """A row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.Array):
        return column
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _blocks(batches: Iterable[pa.RecordBatch], names: list[str], b_path: str, pattern: re.Pattern, limit: int) -> Iterator[pa.RecordBatch]:
    """Two rows of (block, segs, times, order, docs, part) for each block from batches whose last column is the text: one with the distinct
    segments by hash and how often each occurs; one with the documents and the places among the segments of the numbers in their paths."""
    model = second_tokenizer(b_path)[0]
    number, parts, rows, chars = _Numbers(), [], [], 0

    def block() -> pa.RecordBatch:
        segs, lengths = list(number), np.array([len(p) for p in parts], np.int64)
        ids = np.concatenate([np.zeros(0, np.int32), *parts])
        parts.clear()
        number.clear()
        # a text that does not come back has no tokens at all
        lossy = _lossy(model, segs)
        if lossy.any():
            of_doc = np.repeat(np.arange(len(lengths)), lengths)
            out = np.zeros(len(lengths), bool)
            out[of_doc[lossy[ids]]] = True
            ids, lengths = ids[~out[of_doc]], np.where(out, 0, lengths)
        times = np.bincount(ids, minlength=len(segs))
        # in the paths common segments come first, so that most numbers take one byte or two
        common = np.argsort(-times, kind="stable")[: int((times > 0).sum())]
        rank, place = np.zeros(len(segs), np.int32), np.zeros(len(segs), np.int32)
        rank[common] = np.arange(len(common))
        hashed = common[np.argsort(_hashes([segs[i] for i in common.tolist()]), kind="stable")]
        place[hashed] = np.arange(len(hashed))
        held = pa.Table.from_batches(rows).combine_chunks() if names else None
        docs = pa.StructArray.from_arrays([*[_whole(held.column(i)) for i in range(len(names))], pack(rank[ids], lengths)], names=[*names, "_path"])
        rows.clear()
        listed = [pa.array([segs[i] for i in hashed.tolist()], pa.string()), pa.array(times[hashed], pa.int64()), pa.array(place[common]), docs]
        both = [pa.concat_arrays([x, pa.nulls(1, x.type)] if i < 2 else [pa.nulls(1, x.type), x]) for i, x in enumerate(map(_one, listed))]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().bytes] * 2, pa.binary()), *both, pa.array(PARTS)], names=["block", "segs", "times", "order", "docs", "part"])

    for batch in batches:
        low, kept = 0, pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names)
        for i, text in enumerate(batch.column(len(names))):
            text = text.as_py()
            found = cut_text(pattern, text) if text else []
            parts.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
            chars += len(text or "")
            if chars >= limit:
                rows.append(kept.slice(low, i + 1 - low))
                yield block()
                low, chars = i + 1, 0
        if low < batch.num_rows:
            rows.append(kept.slice(low))
    if parts:
        yield block()


def _dealt(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, block, segs, times) from (block, segs, times), segments in order of their hashes."""
    for batch in batches:
        for i in range(batch.num_rows):
            segs, times = (_whole(batch.column(c).slice(i, 1).flatten()) for c in (1, 2))
            bucket = _hashes(segs.to_pylist()) >> (32 - bits)
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[: len(bucket)]
            edge = pa.array(np.concatenate((first, [len(bucket)])), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[first]), pa.array([batch.column(0)[i].as_py()] * len(first), pa.binary()), *[pa.ListArray.from_arrays(edge, x) for x in (segs, times)]],
                names=["bucket", "block", "segs", "times"],
            )


def align_segments(segs: list[str], a_path: str, b_path: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The groups of each segment as text (``a1,a2|b1;a3|b2,b3``), its numbers of tokens of both kinds and of links, and the ids of all links."""
    (first, a_bytes), (second, b_bytes, _) = first_tokenizer(a_path), second_tokenizer(b_path)
    a_ids = [e.ids for e in first.encode_batch_fast(segs, add_special_tokens=False)]
    b_ids = second.encode([for_second(s) for s in segs], num_threads=1)
    # where a segment does not begin with a space, the one that was added is a token of its own
    b_ids = [ids if s[0] == " " else ids[1:] for s, ids in zip(segs, b_ids, strict=True)]
    a, b = ([i for ids in lists for i in ids] for lists in (a_ids, b_ids))
    a_tokens, b_tokens = list(map(a_bytes.__getitem__, a)), list(map(b_bytes.__getitem__, b))
    raw = "".join(segs).encode()
    if b"".join(a_tokens) != raw or b"".join(b_tokens) != raw:
        raise RuntimeError("tokens do not give the segments back")
    a_end, b_end = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (a_tokens, b_tokens))
    shared = np.intersect1d(a_end, b_end, assume_unique=True)
    a_at, b_at = np.searchsorted(a_end, shared) + 1, np.searchsorted(b_end, shared) + 1
    a_text, b_text = list(map(str, a)), list(map(str, b))
    cut = zip([0, *a_at[:-1].tolist()], a_at.tolist(), [0, *b_at[:-1].tolist()], b_at.tolist(), strict=True)
    groups = [f"{a_text[i] if j == i + 1 else ','.join(a_text[i:j])}|{b_text[k] if m == k + 1 else ','.join(b_text[k:m])}" for i, j, k, m in cut]
    n_a, n_b = (np.array([len(ids) for ids in lists], np.int32) for lists in (a_ids, b_ids))
    # how many groups end by the end of each segment
    edge = np.concatenate(([0], np.searchsorted(a_at, np.cumsum(n_a)) + 1))
    listed = [";".join(groups[i:j]) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return listed, n_a, n_b, np.diff(edge).astype(np.int32), np.array(a, np.int64)[a_at - 1], np.array(b, np.int64)[b_at - 1]


PACK = "bucket long, blocks array<binary>, uses array<int>, use_sizes array<int>, groups array<string>, n_a array<int>, n_b array<int>, n_links array<int>, links array<int>, a array<int>, b array<int>, n array<long>"


def _align_bucket(rows: pa.Table, a_path: str, b_path: str) -> pa.Table:
    """One row: the distinct segments of a bucket aligned, what each block uses of them, and the id pairs that they link."""
    lists = _whole(rows.column("segs"))
    found = lists.flatten().dictionary_encode()
    at = found.indices.to_numpy()
    times = np.bincount(at, weights=_whole(rows.column("times")).flatten().to_numpy(), minlength=len(found.dictionary)).astype(np.int64)
    segs = found.dictionary.to_pylist()
    parts = [align_segments(segs[lo : lo + ENCODED], a_path, b_path) for lo in range(0, len(segs), ENCODED)]
    n_a, n_b, n_links, a, b = (np.concatenate(x) for x in list(zip(*parts, strict=True))[1:])
    pair, links = np.unique(a << 32 | b, return_inverse=True)
    n = np.bincount(links, weights=np.repeat(times, n_links), minlength=len(pair)).astype(np.int64)
    values = {
        "blocks": _whole(rows.column("block")),
        "uses": pa.array(at, pa.int32()),
        "use_sizes": pc.list_value_length(lists),
        "groups": pa.array([g for p in parts for g in p[0]], pa.string()),
        "n_a": pa.array(n_a),
        "n_b": pa.array(n_b),
        "n_links": pa.array(n_links),
        "links": pa.array(links, pa.int32()),
        "a": pa.array(pair >> 32, pa.int32()),
        "b": pa.array(pair & 0xFFFFFFFF, pa.int32()),
        "n": pa.array(n),
    }
    return pa.table([rows.column("bucket").slice(0, 1), *map(_one, values.values())], names=["bucket", *values])


FIT = "block binary, bucket long, groups array<string>, n_a array<int>, n_b array<int>, n_links array<int>, n_best array<int>, count_sum array<long>"


def _score_bucket(packs: pa.Table, pairs: pa.Table) -> pa.Table:
    """For each block what the segments that it has in the bucket hold, in the block's order."""
    of = lambda name: _whole(packs.column(name)).flatten()
    a, b, n, best = (pairs.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n", "best"))
    order = np.argsort(a << 32 | b)  # as the pairs of the pack are
    links, n_links = of("links").to_numpy(), of("n_links")
    edge = np.concatenate(([0], np.cumsum(n_links.to_numpy())))
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[order][links])))[edge])
    values = [of("groups"), of("n_a"), of("n_b"), n_links, pa.array(total(best), pa.int32()), pa.array(total(n), pa.int64())]
    uses, size = of("uses"), of("use_sizes").to_numpy()
    cut = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
    lists = [pa.ListArray.from_arrays(cut, v.take(uses)) for v in values]
    blocks = of("blocks")
    bucket = pa.array([packs.column("bucket")[0].as_py()] * len(blocks), pa.int64())
    return pa.table([blocks, bucket, *lists], names=["block", "bucket", "groups", "n_a", "n_b", "n_links", "n_best", "count_sum"])


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _compose(docs: pa.Table, fits: pa.Table, names: list[str]) -> pa.Table:
    """The documents of one block from what its segments hold."""
    fits = fits.sort_by("bucket")
    order = _whole(docs.column("order")).flatten()
    column = lambda c: _whole(fits.column(c)).flatten().take(order) if len(order) else pa.array([], pa.int64())
    listed = column("groups").to_pylist()
    value = {c: column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in COUNTS if c != "n_groups"}
    value["n_groups"] = value["n_links"]  # every group ends in a link
    held = _whole(docs.column("docs")).flatten()
    paths = held.field("_path")
    out, low, chars, texts, sums = [], 0, 0, [], []

    for i, path in enumerate(paths):
        at = unpack(path.as_py())
        texts.append(";".join([listed[j] for j in at.tolist()]))
        sums.append([int(value[c][at].sum()) for c in COUNTS])
        chars += len(texts[-1])
        if chars > 1 << 23 or i + 1 == len(paths):
            kept = [held.field(n).slice(low, i + 1 - low) for n in names]
            counts = [pa.array([s[k] for s in sums], pa.int64()) for k in range(len(COUNTS))]
            out.append(pa.RecordBatch.from_arrays([*kept, *counts, pa.array(texts, pa.string())], names=[*names, *COUNTS, "groups"]))
            low, chars, texts, sums = i + 1, 0, [], []
    return pa.Table.from_batches(out)


def align_tokens(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    keep: list[str] | None = None,
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    bucket_segments: int = BUCKET_SEGMENTS,
) -> DataFrame:
    """``keep`` (all columns by default) with ``n_a`` and ``n_b`` (tokens of a space and the text), ``n_groups``, ``n_links``,
    ``n_best`` (links whose pair is counted most often in the corpus among those of its second id, ties included),
    ``count_sum`` (over the links, how often the corpus links their pair) and ``groups`` (``a1,a2|b1;a3|b2,b3``).

    ``a_path`` is a byte-level BPE file, ``b_path`` a piece model that adds a space and falls back to bytes; both must be
    readable by all tasks. Groups end where tokens of both end at one byte, so each has one link. Texts that are
    null or empty, or that a tokenizer does not give back byte by byte, have no tokens, and count nowhere: zeros and ''.
    Special tokens' strings are plain text. Equal texts get equal results. A text without white space is one
    segment, however long. Result columns replace columns of their name.
    """
    made = [*COUNTS, "groups"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    names = [f"c{i}" for i in range(len(keep))]  # columns may have any name
    kinds = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep, strict=True)]
    pattern = segment_pattern(safe_cuts(a_path, b_path))
    rows = docs.select(*[F.col(quoted(c)).alias(n) for n, c in zip(names, keep, strict=True)], F.col(quoted(text_col)).cast("string").alias("text"))
    block_type = T.StructType([
        T.StructField("block", T.BinaryType()),
        T.StructField("segs", T.ArrayType(T.StringType())),
        T.StructField("times", T.ArrayType(T.LongType())),
        T.StructField("order", T.ArrayType(T.IntegerType())),
        T.StructField("docs", T.ArrayType(T.StructType([*kinds, T.StructField("_path", T.BinaryType())]))),
        T.StructField("part", T.StringType()),
    ])
    stored, spark = new_folder(docs.sparkSession, "blocks"), docs.sparkSession
    with while_writing(spark):
        rows.mapInArrow(lambda b: _blocks(b, names, b_path, pattern, block_chars), block_type).write.partitionBy("part").parquet(stored)
    blocks, whole = (spark.read.schema(block_type).parquet(stored).where(F.col("part") == p) for p in PARTS)

    segments = blocks.agg(F.sum(F.size("segs"))).first()[0] or 0
    bits = max(0, (segments // bucket_segments).bit_length())
    uses = blocks.select("block", "segs", "times").mapInArrow(lambda b: _dealt(b, bits), "bucket long, block binary, segs array<string>, times array<long>")
    packs = materialize(uses.groupBy("bucket").applyInArrow(lambda rows: _align_bucket(rows, a_path, b_path), PACK), "packs")
    blocks.stored_at = f"{stored}/part={PARTS[0]}"
    discard(blocks)

    own = packs.select("bucket", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("bucket", "p.*")
    total = own.groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    total = total.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    known = own.select(F.col("bucket").alias("of"), "a", "b").join(total, ["a", "b"])
    fits = packs.groupBy("bucket").cogroup(known.groupBy("of")).applyInArrow(_score_bucket, FIT)
    out_type = T.StructType([*kinds, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups", T.StringType())])
    whole = whole.select(F.col("block").alias("of"), "order", "docs").groupBy("of").cogroup(fits.groupBy("block"))
    out = whole.applyInArrow(lambda d, f: _compose(d, f, names), out_type)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *made)
