"""Kneser-Ney over whole bytes, with counts that stay in shards and meet the documents by a join.

N-grams are ``ORDER`` bytes long, a model for each of two folds of the trusted texts, so that every text, a trusted
one as well, is scored by the model of the fold that it is not in. Below its order 1 a model goes on to the
chance of the byte's class (``kneser_ney.train``), which is even within the class. The number of n-grams grows with the
corpus; nothing of the table is gathered or broadcast.

Documents are dealt into blocks of about ``BLOCK_BYTES``. A block asks once for each n-gram that it has, so that no n-gram,
however frequent, is asked for more often than there are blocks; the questions are joined with the table by n-gram, and
the answers come back to the block by a second join, where every byte of its texts is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import byte_view, discard, materialize, slices

ORDER, BLOCK_BYTES, SLICE, PAD = 5, 24 << 20, 2 << 20, ord("\n")
#: N-grams that a task counts before it adds them up, and gives them out if they stay more than half as many.
COUNTED = 1 << 21


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ORDER bytes up to each byte of some texts, as numbers; before a text stand PADs."""
    part, first, sizes = data[offsets[0] : offsets[-1]].astype(np.int64), offsets[:-1] - offsets[0], np.diff(offsets)
    out = part.copy()
    for back in range(1, ORDER):
        out[back:] |= part[:-back] << 8 * back
    for i in range(ORDER - 1):  # the first bytes of a text have others' before them
        at = first[sizes > i] + i
        out[at] = _end(out[at], i + 1) | sum(PAD << 8 * back for back in range(i + 1, ORDER))
    return out


def _end(code, size: int):
    return code & ((1 << 8 * size) - 1)


def key(code, size, fold):
    """A string of up to ORDER bytes of a fold's model as one number; for columns and arrays."""
    return code * 16 + size * 2 + fold


def fold(text: str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(1)).cast("int")


def gram_counts(trusted: DataFrame) -> DataFrame:
    """(fold, gram, n) from (_text): added up within tasks, then by shards of grams."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        added = lambda: pa.concat_tables(held).group_by(["fold", "gram"]).aggregate([("n", "sum")]).rename_columns(["fold", "gram", "n"])
        for batch in batches:
            folds = batch.column(1).to_numpy()
            for which in (0, 1):
                offsets, data = byte_view(batch.column(0).filter(pa.array(folds == which)))
                for lo, hi in slices(offsets, SLICE):
                    gram, n = np.unique(codes(data, offsets[lo : hi + 1]), return_counts=True)
                    held.append(pa.table({"fold": pa.array(np.full(len(gram), which, np.int32)), "gram": gram, "n": n}))
            if sum(t.num_rows for t in held) > COUNTED:
                held = [added()]
                if held[0].num_rows > COUNTED // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from added().to_batches()

    local = trusted.select(F.col("_text"), fold("_text").alias("fold")).mapInArrow(run, "fold int, gram long, n long")
    return local.groupBy("fold", "gram").agg(F.sum("n").alias("n"))


def table(trusted: DataFrame, discounts: Callable[[list[int]], list[float]]) -> DataFrame:
    """(key, own, rest) of each string seen: ``own`` is what its last byte has of its own after the others, ``rest`` what is left to shorter contexts after it."""
    spark = trusted.sparkSession
    longest = materialize(gram_counts(trusted), "byte-grams")
    of = lambda size: F.expr(f"gram & (shiftleft(1L, cast(8 * ({size}) as int)) - 1)")
    ends = longest.select("fold", F.explode(F.lit(list(range(2, ORDER + 1)))).alias("size"), "gram").select("fold", "size", of("size").alias("gram")).distinct()
    # in how many contexts a shorter gram was seen
    shorter = ends.groupBy("fold", (F.col("size") - 1).alias("size"), of("size - 1").alias("gram")).agg(F.count("*").alias("n"))
    counts = seen_in = materialize(longest.select("fold", F.lit(ORDER).alias("size"), "gram", "n").unionByName(shorter), "byte-counts")
    seen = counts.groupBy("fold", "size").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()  # two folds, ORDER sizes
    off = spark.createDataFrame([(r.fold, r.size, *discounts([r.n1, r.n2, r.n3, r.n4])) for r in seen], "fold int, size int, d1 double, d2 double, d3 double")
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    counts = counts.join(F.broadcast(off), ["fold", "size"]).select("fold", "size", F.expr("shiftright(gram, 8)").alias("context"), "gram", "n", less.alias("off"))
    totals = materialize(counts.groupBy("fold", "size", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("off")), "byte-totals")
    own = counts.join(totals.select("fold", "size", "context", "total"), ["fold", "size", "context"])
    nothing = F.lit(None).cast("double")
    own = own.select(key(F.col("gram"), F.col("size"), F.col("fold")).alias("key"), ((F.col("n") - F.col("off")) / F.col("total")).alias("own"), nothing.alias("rest"))
    rest = totals.select(key(F.col("context"), F.col("size") - 1, F.col("fold")).alias("key"), nothing.alias("own"), (F.col("off") / F.col("total")).alias("rest"))
    model = materialize(own.unionByName(rest).groupBy("key").agg(F.max("own").alias("own"), F.max("rest").alias("rest")), "byte-model")
    discard(longest, seen_in, totals)
    return model


def asked(gram: np.ndarray, model: int) -> np.ndarray:
    """The keys of all that the chances of some grams are made of: their ends, and the contexts of these."""
    out = [key(np.unique(_end(x, size)), size, model) for x in (gram, gram >> 8) for size in range(ORDER + (x is gram))]
    return np.unique(np.concatenate(out))


def chances(gram: np.ndarray, model: int, keys: np.ndarray, own: np.ndarray, rest: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Of each gram's last byte after the others, from the answers (sorted by key, NaN where there is none) and the chances below order 1."""
    keys, own, rest = np.append(keys, np.iinfo(np.int64).max), np.append(own, np.nan), np.append(rest, np.nan)

    def found(code: np.ndarray, size: int, values: np.ndarray, otherwise: float) -> np.ndarray:
        wanted = key(code, size, model)
        spot = np.searchsorted(keys, wanted)
        got = values[spot]
        return np.where((keys[spot] == wanted) & ~np.isnan(got), got, otherwise)

    out = base
    for size in range(1, ORDER + 1):
        out = found(_end(gram, size), size, own, 0.0) + found(_end(gram >> 8, size - 1), size - 1, rest, 1.0) * out
    return out


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document once for a task, however often it is repeated."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for d in batch.column(0).to_pylist():
            fresh.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def perplexities(docs: DataFrame, model: DataFrame, base: Broadcast, below: Callable[[np.ndarray, np.ndarray], np.ndarray], peak: int) -> DataFrame:
    """(_scored, n_bytes, bits, peak_bits) of docs (_key, _text): bytes, mean cost of a byte, and that of the worst ``peak`` bytes; null of empty texts.

    ``below`` gives the chances below order 1 from the broadcast ``base`` and grams.
    """
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * BLOCK_BYTES)))  # of each fold
    once = docs.select("_key", F.coalesce("_text", F.lit("")).alias("_text")).mapInArrow(_once, "_key long, _text string")
    dealt = once.withColumn("block", (F.pmod(F.col("_key"), F.lit(blocks)) * 2 + fold("_text")).cast("int"))

    def ask(rows: pa.Table) -> pa.Table:
        block, gram = rows.column("block")[0].as_py(), [np.zeros(0, np.int64)]
        for chunk in rows.column("_text").chunks:
            offsets, data = byte_view(chunk)
            gram += [np.unique(codes(data, offsets[lo : hi + 1])) for lo, hi in slices(offsets, SLICE)]
        wanted = asked(np.unique(np.concatenate(gram)), 1 - block % 2)
        return pa.table({"block": pa.array(np.full(len(wanted), block, np.int32)), "key": wanted})

    questions = dealt.select("block", "_text").groupBy("block").applyInArrow(ask, "block int, key long")
    # the table grows with the corpus: never broadcast
    answers = materialize(questions.join(model.hint("merge"), "key").select("block", "key", "own", "rest"), "byte-answers")

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        docs_of, out = [], []
        if rows.num_rows:
            order = np.argsort(answers.column("key").to_numpy())
            keys = answers.column("key").to_numpy()[order]
            own, rest = (np.asarray(answers.column(c).to_numpy(), np.float64)[order] for c in ("own", "rest"))
            other = 1 - rows.column("block")[0].as_py() % 2
        for chunk, of in zip(rows.column("_text").chunks, rows.column("_key").chunks, strict=True):
            offsets, data = byte_view(chunk)
            for lo, hi in slices(offsets, SLICE):
                held = pa.array(codes(data, offsets[lo : hi + 1])).dictionary_encode()
                gram = held.dictionary.to_numpy()
                cost = -np.log2(chances(gram, other, keys, own, rest, below(base.value, gram)))[held.indices.to_numpy()]
                at = offsets[lo : hi + 1] - offsets[lo]
                for i in range(hi - lo):
                    run = np.cumsum(cost[at[i] : at[i + 1]])
                    n = len(run)
                    mean = run[-1] / n if n else np.nan
                    worst = max(run[peak - 1], (run[peak:] - run[:-peak]).max()) / peak if n > peak else mean
                    out.append((n, mean, worst))
            docs_of += of.to_pylist()
        sizes, mean, worst = (np.array(x) for x in zip(*out, strict=True)) if out else (np.zeros(0),) * 3
        shown = lambda x: pa.array(np.round(x.astype(np.float64), 6), mask=sizes == 0)
        return pa.table({"_scored": pa.array(docs_of, pa.int64()), "n_bytes": pa.array(sizes.astype(np.int64)), "bits": shown(mean), "peak_bits": shown(worst)})

    scored = dealt.select("block", "_key", "_text").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "_scored long, n_bytes long, bits double, peak_bits double")
    scored = materialize(scored.dropDuplicates(["_scored"]), "byte-scores")
    discard(answers)
    return scored
