"""Quality classifier: an interpolated modified Kneser-Ney n-gram model.

The model is trained on all trusted documents (good quality, not toxic). Its n-grams are over whole bytes and stay in
shards, which documents meet by joins (``byte_grams``). Below its order 1 stands a second model of the same kind over
``ALPHABET`` classes of bytes, for bytes and contexts that trusted texts of the other fold lack: tasks count its n-grams
locally, the counts are added up in shards by n-gram, and joins of the shards with the totals of their
contexts give every order's discounted probabilities and back-off weights. Its table of costs has one float for
each possible n-gram (10 MB) whatever the corpus, and is broadcast.

A document gets its perplexity, and the perplexity of its worst passage of
``PEAK`` bytes; and, where its language has trusted and toxic labels, the ratio of a toxic to
the trusted model by word pieces (``piece_ratio``). It is rejected if one of the three is
above the quantile that trusted documents of its language have; for both perplexities, the quantile of
the distance from what is usual at the document's length, as means over few bytes vary more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import byte_grams
from tidewire.llm.common import byte_view, discard, materialize, quoted, slices
from tidewire.llm.piece_ratio import ratios, text_key

ALPHABET, ORDER, PEAK = 40, 4, 12
START = 1


def _classes() -> np.ndarray:
    """The class of each byte: letters, and kinds of anything else."""
    out = np.full(256, 7, np.int64)  # other signs
    out[ord("a") : ord("z") + 1] = np.arange(8, 34)
    out[ord("A") : ord("Z") + 1] = 4
    out[ord("0") : ord("9") + 1] = 3
    for signs, kind in (("\n", START), (" \t\r\v\f", 2), (".,", 5), (";:'\"!?-()", 6)):
        out[list(signs.encode())] = kind
    out[128:192] = 34 + np.arange(128, 192) % 5
    out[192:] = 39
    return out


CLASS = _classes()
#: How many bytes a class has.
MEMBERS = np.bincount(CLASS, minlength=ALPHABET)


def _grams(text: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Codes of the n-grams that end at each byte; before the text stand START symbols."""
    symbols = np.concatenate((np.full(order - 1, START), CLASS[text]))
    n, out = len(text), np.zeros(len(text), np.int64)
    for j in range(order):
        out = out * ALPHABET + symbols[j : j + n]
    return out


def gram_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(gram, n): added up within tasks, then by shards of grams."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**ORDER, np.int64)
        for batch in batches:
            offsets, data = byte_view(batch.column(0))
            for lo, hi in slices(offsets, 4 << 20):
                parts = [_grams(data[offsets[i] : offsets[i + 1]]) for i in range(lo, hi)]
                total += np.bincount(np.concatenate(parts), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    local = texts.select(F.col(quoted(text_col)).cast("string")).mapInArrow(run, "gram long, n long")
    return local.groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """What is taken off counts of 1, 2, and 3 or more."""
    return discounts_of([x or 0 for x in counts.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()])


def discounts_of(n: list[int]) -> list[float]:
    """The same from how many have counts of 1, 2, 3 and 4."""
    y = n[0] / max(1, n[0] + 2 * n[1])
    found = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i * y for i in (1, 2, 3)]
    return [min(max(d, 0.05 * i), 0.95 * i) for i, d in zip((1, 2, 3), found, strict=True)]


def train(trusted: DataFrame, text_col: str) -> np.ndarray:
    """Bits that each n-gram's last symbol costs after the others: float32, ALPHABET ** ORDER of them."""
    counts = materialize(gram_counts(trusted, text_col), "grams")
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # in how many contexts a gram was seen
        shorter = by_order[k + 1].select((F.col("gram") % ALPHABET**k).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        by_order[k] = materialize(shorter, "grams")
    cost = np.full(ALPHABET, 1.0 / ALPHABET)
    for k in range(1, ORDER + 1):
        counts, d = by_order[k], _discounts(by_order[k])
        context = F.floor(F.col("gram") / ALPHABET)
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        totals = materialize(counts.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("off")), "totals")
        joined = counts.withColumn("context", context).join(totals, "context")
        # at most ALPHABET ** k rows of 12 bytes, whatever the corpus
        table = joined.select(F.col("gram").cast("int").alias("gram"), ((F.col("n") - off) / F.col("total")).alias("own")).toArrow()
        left = totals.select(F.col("context").cast("int").alias("context"), (F.col("off") / F.col("total")).alias("rest")).toArrow()
        rest = np.ones(ALPHABET ** (k - 1))
        rest[left["context"].to_numpy()] = left["rest"].to_numpy()
        shorter = cost if k == 1 else np.tile(cost, ALPHABET)  # by gram: the chance after the shorter context
        cost = shorter.reshape(-1, ALPHABET)
        cost *= rest[:, None]
        cost = cost.reshape(-1)
        for chunk in table.to_batches():
            cost[chunk.column(0).to_numpy()] += chunk.column(1).to_numpy()
        del table, left
        discard(totals)
    discard(*by_order.values())
    return -np.log2(cost).astype(np.float32)


def class_chances(cost: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Of the last byte of each n-gram over bytes: that of its class after the classes before, even within the class."""
    code = np.zeros(len(gram), np.int64)
    for back in range(ORDER - 1, -1, -1):
        code = code * ALPHABET + CLASS[gram >> 8 * back & 255]
    return 2.0 ** -cost[code].astype(np.float64) / MEMBERS[CLASS[gram & 255]]


def upper_quantiles(scores: DataFrame, group: str, value: str, q: float, step: float = 1e-3) -> DataFrame:
    """(group, value): the least multiple of ``step`` that at least a share q of the group's values do not exceed.

    Values are counted by multiples of step first, so a hot group is a few thousand rows.
    """
    counted = scores.where(F.col(value).isNotNull()).groupBy(group, F.ceil(F.col(value) / step).alias("_v")).agg(F.count("*").alias("_n"))
    each = Window.partitionBy(group)
    up = each.orderBy("_v")
    ranked = counted.select(group, "_v", F.sum("_n").over(up).alias("_upto"), F.sum("_n").over(each).alias("_all"))
    return ranked.where(F.col("_upto") >= F.col("_all") * q).groupBy(group).agg((F.min("_v") * step).alias(value))


def by_length(scores: DataFrame, value: str, enough: int = 30) -> DataFrame:
    """(_lang, low, high, base, slope, wide, more) from trusted scores: of n bytes, ``value`` is usually base + slope * log2(n),
    n held within 2 ** low and 2 ** high, with a variance of wide + more / n. Of less than ``enough`` documents, a mean and variance 1.
    """
    x, y = F.log2("n_bytes"), F.col(value)
    some = scores.where(y.isNotNull())
    line = some.groupBy("_lang").agg(F.count("*").alias("_n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(y).alias("_mean"), F.regr_slope(y, x).alias("slope"))
    line = line.join(some.groupBy("_lang").agg(F.avg(x).alias("_x")), "_lang")
    line = line.withColumn("slope", F.when(F.col("_n") >= enough, F.coalesce("slope", F.lit(0.0))).otherwise(0.0))
    line = line.select("_lang", "_n", "low", "high", "slope", (F.col("_mean") - F.col("slope") * F.col("_x")).alias("base"))
    off = F.pow(y - F.col("base") - F.col("slope") * x, 2)
    left = some.join(F.broadcast(line), "_lang").groupBy("_lang").agg(F.avg(off).alias("_all"), F.regr_slope(off, 1 / F.col("n_bytes")).alias("_more"), F.regr_intercept(off, 1 / F.col("n_bytes")).alias("_wide"))
    fits = (F.col("_n") >= enough) & (F.col("_all") > 0)
    return line.join(left, "_lang").select(
        "_lang",
        "low",
        "high",
        "base",
        "slope",
        F.when(fits, F.greatest(F.coalesce("_wide", "_all"), F.col("_all") / 20)).otherwise(1.0).alias("wide"),
        F.when(fits, F.greatest(F.coalesce("_more", F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("more"),
    )


def usual(fit: str) -> tuple[Column, Column]:
    """What is usual at a document's length by the struct ``fit`` of ``by_length``, and the standard deviation."""
    f = F.col(fit)
    x = F.greatest(F.least(F.log2(F.greatest("n_bytes", F.lit(1))), f["high"]), f["low"])
    return f["base"] + f["slope"] * x, F.sqrt(f["wide"] + f["more"] / F.greatest("n_bytes", F.lit(1)))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    keep: list[str] | None = None,
    quantile: float = 0.995,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
    label_id_col: str = "doc_id",
) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``n_bytes``, ``perplexity``, ``peak_perplexity``,
    ``threshold``, ``peak_threshold``, ``toxic_ratio``, ``ratio_threshold`` and ``kept``.

    Trusted are documents of which all labels say quality 1 and toxic 0. A language without
    trusted documents, or null, takes the thresholds of all trusted documents together; with
    no trusted document at all, everything but empty texts is kept. Null and empty texts
    have no perplexity and are not kept. Toxic are documents with a label toxic 1; a language
    without toxic or trusted ones has no ratio and is judged by perplexity alone. Repeated rows are judged alike.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    judged_by = labels.groupBy(F.col(quoted(label_id_col)).alias("_good")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = judged_by.where("q = 1 and t = 0").select("_good")
    texts = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text"))
    # labels grow with the corpus: never broadcast
    trusted = texts.join(good.hint("merge"), F.col("_id") == F.col("_good"), "left_semi")
    costs = spark.sparkContext.broadcast(train(trusted, "_text"))
    ids = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(lang_col)).alias("_lang"), F.col(quoted(text_col)).alias("_text"))
    marked = judged_by.where("t = 1 or (q = 1 and t = 0)").select("_good", (F.col("t") == 1).alias("_toxic"))
    labelled = ids.join(marked.hint("merge"), F.col("_id") == F.col("_good")).select("_text", "_lang", "_toxic")
    by_text = ratios(ids, labelled, _discounts)
    keyed = ids.withColumn("_key", text_key("_text", "_id", "_lang"))
    model = byte_grams.table(trusted, discounts_of)
    bits = byte_grams.perplexities(keyed, model, costs, class_chances, PEAK)
    discard(model)
    by_text = bits.join(by_text, F.col("_scored") == F.col("_of_text"), "left").drop("_of_text")
    by_text = materialize(by_text, "by-text")
    scores = keyed.select("_id", "_lang", "_key").join(by_text, F.col("_key") == F.col("_scored")).drop("_key", "_scored")
    scores = materialize(scores, "scores")
    of_good = scores.join(good, F.col("_id") == F.col("_good"), "left_semi")
    both = materialize(of_good.unionByName(of_good.withColumn("_lang", F.lit("\0all"))).where("_lang is not null"), "good")
    for value in ("bits", "peak_bits"):
        fit = materialize(by_length(both, value), "fit")
        fit = fit.select(F.col("_lang").alias("_fit_of"), F.struct(*[c for c in fit.columns if c != "_lang"]).alias(f"_{value}"))
        both = both.join(F.broadcast(fit), F.col("_lang") == F.col("_fit_of"), "left").drop("_fit_of")  # a row for each language
        middle, spread = usual(f"_{value}")
        both = both.withColumn(f"far_{value}", (F.col(value) - middle) / spread)
    both = materialize(both.drop("_id"), "trusted")
    limits = both.groupBy("_lang").agg(F.first("_bits", True).alias("_fit"), F.first("_peak_bits", True).alias("_fit_peak"))
    for value in ("far_bits", "far_peak_bits", "ratio"):
        limits = limits.join(upper_quantiles(both, "_lang", value, quantile), "_lang", "left")
    limits = materialize(limits.withColumnsRenamed({"far_bits": "_most", "far_peak_bits": "_most_peak", "ratio": "_most_ratio"}), "limits")
    fields = ["_fit", "_fit_peak", "_most", "_most_peak"]
    overall = limits.where(F.col("_lang") == "\0all").select(*[F.col(c).alias(f"_all{c}") for c in fields])
    limits = limits.withColumnRenamed("_lang", "_of")
    made = {"n_bytes", "perplexity", "peak_perplexity", "threshold", "peak_threshold", "toxic_ratio", "ratio_threshold", "kept"}
    keep = [c for c in keep if c not in made]
    held = {c: f"_keep{i}" for i, c in enumerate(keep)}  # whatever the columns are called
    if set(keep) <= {id_col, lang_col}:
        judged = scores.withColumns({held[c]: F.col(x) for c, x in ((id_col, "_id"), (lang_col, "_lang")) if c in held})
    else:
        own = {"_id": id_col, "_lang": lang_col, "_text": text_col}
        wide = docs.select(*[F.col(quoted(c)).alias(x) for c, x in held.items()], *[F.col(quoted(c)).alias(x) for x, c in own.items()]).withColumn("_key", text_key("_text", "_id", "_lang"))
        judged = wide.drop("_text", "_id").join(by_text, F.col("_key") == F.col("_scored"))
    judged = judged.join(F.broadcast(limits), F.col("_lang") == F.col("_of"), "left").join(F.broadcast(overall), F.lit(True), "left")
    judged = judged.withColumns({c: F.coalesce(c, f"_all{c}") for c in fields})
    limit = lambda fit, far: usual(fit)[0] + F.col(far) * usual(fit)[1]
    most, peak = limit("_fit", "_most"), limit("_fit_peak", "_most_peak")
    power = lambda bits: F.round(F.pow(F.lit(2.0), bits), 6)
    below = F.coalesce((F.col("bits") <= most) & (F.col("peak_bits") <= peak), F.lit(True))
    below &= F.coalesce(F.col("ratio") <= F.col("_most_ratio"), F.lit(True))
    return judged.select(
        *[F.col(x).alias(c) for c, x in held.items()],
        "n_bytes",
        power(F.col("bits")).alias("perplexity"),
        power(F.col("peak_bits")).alias("peak_perplexity"),
        power(most).alias("threshold"),
        power(peak).alias("peak_threshold"),
        F.col("ratio").alias("toxic_ratio"),
        F.col("_most_ratio").alias("ratio_threshold"),
        ((F.col("n_bytes") > 0) & below).alias("kept"),
    )
