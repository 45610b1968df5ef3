"""How much likelier a text is with some toxic words in it, by counts of word pieces joined in shards.

Words, and runs of signs, are cut into pieces of up to ``SIZE`` bytes; a key holds all bytes of a
piece, whether it begins its word, and whether it has capitals after a word's first letter.
For each language there are two models with Kneser-Ney discounts: trusted texts, backed off
to equal chances, and toxic ones, backed off to the trusted model. A text gains
``log2(1 - SHARE + SHARE * toxic / trusted)`` bits by each piece, and its ratio is
the sum over the square root of their number: a word that toxic texts overuse counts, one they lack hardly does.

Each text belongs to one of two folds by its hash and is scored by the models of the other fold,
so that the ratios of labelled texts are held-out ones as well. The counts grow with the corpus and
stay in shards: pairs of (text, piece) are joined with them. Pieces with more than one
in ``HEAD`` of the toxic counts, at most HEAD of them, are the skewed keys; those are broadcast. So is a
filter of ``FILTER`` bits, whatever the corpus: pairs whose piece is surely in no toxic text are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import LOWER, WORD_BYTE, byte_view, discard, materialize, mix64, slices

SIZE, SHARE, HEAD, FILTER = 7, 0.02, 1 << 18, 1 << 25
_KIND = np.where(WORD_BYTE, 1, 2)
_KIND[list(b" \t\r\n\v\f")] = 0
_LOWER = np.frombuffer(LOWER, np.uint8).astype(np.uint64)
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all pieces of some texts, and the range of each text among them."""
    base = int(offsets[0])
    part, at = data[base : int(offsets[-1])], offsets - base
    n = len(part)
    kind, index = _KIND[part], np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[at[:-1][at[:-1] < n]] = True
    place = index - np.maximum.accumulate(np.where(fresh, index, 0)) if n else index
    first = np.flatnonzero((kind > 0) & (place % SIZE == 0))
    stops = np.append(np.flatnonzero(fresh), n)
    sizes = np.minimum(stops[np.searchsorted(stops, first, "right")] - first, SIZE) if n else first
    low, upper = np.append(_LOWER[part], np.zeros(SIZE, np.uint64)), np.append(_UPPER[part], np.zeros(SIZE, bool))
    key = (place[first] > 0).astype(np.uint64) << np.uint64(56)
    capitals = np.zeros(len(first), bool)
    for j in range(SIZE):
        here = sizes > j
        key |= np.where(here, low[first + j], np.uint64(0)) << np.uint64(8 * j)
        capitals |= here & upper[first + j] & (place[first] + j > 0)
    return key | capitals.astype(np.uint64) << np.uint64(57), np.searchsorted(first, at)


def _group(lang: str | None, fold: int) -> int:
    """A model: that of a language and a fold."""
    return (xxhash.xxh3_64_intdigest((lang or "").encode(), 1 + (lang is None)) + fold) & 0xFFFFFFFFFFFFFFFF


def _each(texts: pa.Array, langs: pa.Array, other: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each text: row, model of its own or the other fold, distinct keys within the model, and their counts."""
    offsets, data = byte_view(texts)
    names, models = langs.to_pylist(), {}
    for lo, hi in slices(offsets):
        keys, at = pieces(data, offsets[lo : hi + 1])
        for row in range(lo, hi):
            raw = data[offsets[row] : offsets[row + 1]].tobytes()
            which = names[row], (xxhash.xxh3_64_intdigest(raw) & 1) ^ other
            if which not in models:
                models[which] = _group(*which)
            mine, n = np.unique(keys[at[row - lo] : at[row - lo + 1]], return_counts=True)
            yield row, models[which], mix64(mine + mix64(np.array([models[which]], np.uint64))), n


def piece_counts(labelled: DataFrame) -> DataFrame:
    """(model, key, good, bad) from (_text, _lang, _toxic): added up within batches, then by shards of keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(2).to_pylist()
            found = [(np.full(len(n), model, np.uint64), key, np.where(toxic[row], 0, n), np.where(toxic[row], n, 0)) for row, model, key, n in _each(batch.column(0), batch.column(1), False)]
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                rows = pa.table([c.view(np.int64) for c in columns], names=["model", "key", "good", "bad"])
                yield from rows.group_by(["model", "key"]).aggregate([("good", "sum"), ("bad", "sum")]).rename_columns(["model", "key", "good", "bad"]).to_batches()

    local = labelled.select("_text", "_lang", "_toxic").mapInArrow(run, "model long, key long, good long, bad long")
    return local.groupBy("model", "key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def gains(counts: DataFrame, discounts: Callable[[DataFrame], list[float]]) -> tuple[DataFrame, DataFrame]:
    """(key, more, bad) of the pieces that toxic texts have, and (model, rest): a piece gains rest, and ``more`` if it is listed."""
    off = {}
    for c in ("good", "bad"):
        d = discounts(counts.where(F.col(c) > 0).select(F.col(c).alias("n")))
        off[c] = F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])
    totals = counts.groupBy("model").agg(
        F.count("*").alias("kinds"), *[f(x).alias(f"{c}_{n}") for c in off for n, f, x in (("total", F.sum, F.col(c)), ("off", F.sum, off[c]))]
    )
    totals = totals.where("good_total > 0 and bad_total > 0")
    log = lambda likelier: F.log2(F.lit(1 - SHARE) + F.lit(SHARE) * likelier)
    rest = log(F.col("bad_off") / F.col("bad_total"))
    trusted = (F.col("good") - off["good"] + F.col("good_off") / (F.col("kinds") + 1)) / F.col("good_total")
    likelier = (F.col("bad") - off["bad"]) / F.col("bad_total") / trusted + F.col("bad_off") / F.col("bad_total")
    listed = counts.where("bad > 0").join(F.broadcast(totals), "model")  # a row for each language and fold
    return listed.select("key", (log(likelier) - rest).alias("more"), "bad"), totals.select("model", rest.alias("rest"))


def text_key(text: str, doc: str, lang: str) -> Column:
    return F.xxhash64(text, doc, lang)


def ratios(docs: DataFrame, labelled: DataFrame, discounts: Callable[[DataFrame], list[float]]) -> DataFrame:
    """(_of_text, ratio) by the ``text_key`` of docs (_id, _lang, _text); texts of which the models lack counts have no row."""
    spark = docs.sparkSession
    counts = materialize(piece_counts(labelled), "pieces")
    table, rest = gains(counts, discounts)
    table = materialize(table, "gains")
    total = table.agg(F.sum("bad")).first()[0] or 0
    heavy = table.where(F.col("bad") * HEAD > total).select("key", "more").orderBy("key").toArrow()  # fewer than HEAD rows of 16 bytes
    head = spark.sparkContext.broadcast((heavy["key"].to_numpy(), heavy["more"].to_numpy()))
    rare = table.where(F.col("bad") * HEAD <= total).select("key", F.col("more").alias("tail"))
    seen = spark.sparkContext.broadcast(_bits(rare))
    # a row for each language and fold
    known = spark.sparkContext.broadcast({r.model: r.rest for r in rest.collect()})
    found = docs.select("_text", "_lang", text_key("_text", "_id", "_lang").alias("_d")).mapInArrow(_looked_up(head, seen, known), "d long, key long, n long, own double")
    found = found.join(rare, "key", "left")
    own = F.col("own").isNotNull()
    summed = found.groupBy("d").agg(
        F.count_if(own).alias("copies"), F.max(F.when(own, F.col("n"))).alias("n"), F.max("own").alias("own"), F.sum(F.when(~own, F.col("n") * F.col("tail"))).alias("tail")
    )
    gain = F.col("own") + F.coalesce("tail", F.lit(0.0)) / F.col("copies")
    out = materialize(summed.select(F.col("d").alias("_of_text"), F.round(gain / F.sqrt("n"), 6).alias("ratio")), "ratios")
    discard(counts, table)
    return out


def _spots(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) % np.uint64(FILTER)


def _bits(table: DataFrame, chunk: int = 1 << 12) -> np.ndarray:
    """FILTER bits, packed, with those of the table's keys set; tasks send the parts that they set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(FILTER // 8, np.uint8)
        for batch in batches:
            spots = _spots(batch.column(0).to_numpy())
            np.bitwise_or.at(mine, spots >> np.uint64(3), np.uint8(1) << (spots & np.uint64(7)).astype(np.uint8))
        parts = mine.reshape(-1, chunk)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([parts[i].tobytes() for i in used.tolist()], pa.binary())], names=["part", "bits"])

    out = np.zeros((FILTER // 8 // chunk, chunk), np.uint8)
    for row in table.select("key").coalesce(8).mapInArrow(run, "part long, bits binary").toLocalIterator():
        out[row.part] |= np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def _looked_up(head: Broadcast, seen: Broadcast, known: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(d, key, n, own): for each text a row with the number of its pieces and ``own``, what it gains at once, and a row for each of its rarer pieces, n of them.

    The text's row goes by its own key, so that these rows do not meet in one task; what is null or small
    in most rows takes little room in the shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (listed, gain), bits, rests = head.value, seen.value, known.value
        listed = np.append(listed, np.iinfo(np.int64).max)
        gain = np.append(gain, 0.0)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, out = part.column(2).to_pylist(), []
                for row, model, key, n in _each(part.column(0), part.column(1), True):
                    rest = rests.get(model - (1 << 64) if model >> 63 else model)
                    if rest is None or not len(n):
                        continue
                    key, d = key.view(np.int64), ids[row]
                    spot = np.searchsorted(listed, key)
                    heavy = listed[spot] == key
                    at = _spots(key)
                    rare = ~heavy & ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                    once = np.full(int(rare.sum()) + 1, np.nan)
                    once[-1] = n.sum() * rest + (gain[spot] * n)[heavy].sum()
                    out.append((np.full(len(once), d), np.append(key[rare], d), np.append(n[rare], n.sum()), once))
                if out:
                    d, key, n, once = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(key), pa.array(n), pa.array(once, mask=np.isnan(once))], names=["d", "key", "n", "own"])

    return run
