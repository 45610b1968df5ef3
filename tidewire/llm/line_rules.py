"""Quality rules, line first.

Every line of a text is held against rules of punctuation, navigation and
boilerplate, and goes if it fails one; a document that loses too large a share of
its words in this way is rejected, as is one that fails the document rules (too
few words, or too many of them in repeated windows). Lines are judged in Arrow
batches, a slice of texts at a time; nothing is shuffled, and no rule looks beyond
its document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import byte_view, fresh, map_texts, quoted, slices

#: Words are runs of anything but space and tab to carriage return, which is what bytes.split cuts at.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: A line reads like text if a word of it ends a sentence; closing quotes and brackets may follow.
SENTENCE_END = rf"""[.!?:;…。！？؟।]["'”’»)\]]*([{SPACE}]|\z)"""
#: A word that ends in what parts the entries of a menu, or the steps of a path, from each other.
SEPARATOR = rf"[|>»›·•/–-]([{SPACE}]|\z)"
#: Phrases of page furniture, in any case.
BOILERPLATE = (
    r"all rights reserved|terms of (use|service)|privacy policy|use of cookies|(accept|uses|use) cookies|enable javascript|lorem ipsum"
    r"|click here|sign up for our|subscribe to our|share (this )?on (facebook|twitter)|powered by"
)
WINDOW = 8

_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _up_to(marked: np.ndarray) -> np.ndarray:
    """How many are marked before each place."""
    return np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))


def repeated_words(data: bytes, window: int = WINDOW) -> int:
    """Words of a text that lie in a window found there twice or more; windows are compared word by word."""
    words = data.split()
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int32)
    if len(number) == len(words):
        return 0
    # equal windows have equal sums; those that share a sum are then compared in full
    sums, wide = np.zeros(n, np.uint64), ids.astype(np.uint64) + np.uint64(1)
    wide ^= wide << np.uint64(29)
    for k in range(window):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + n]
    order = np.argsort(sums)
    same = sums[order][1:] == sums[order][:-1]
    if not same.any():
        return 0
    shared = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    rows = np.lib.stride_tricks.sliding_window_view(ids, window)[shared]
    _, which, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = shared[times[which.ravel()] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def judge_lines(lines: pa.Array, n_words: np.ndarray, n_symbols: np.ndarray, max_symbols: float = 0.1, max_separators: float = 0.2) -> np.ndarray:
    """Which lines fail a rule: no sentence ends in it, symbols come to more than ``max_symbols`` a word, more than
    ``max_separators`` of the words end in a separator, or it has a boilerplate phrase. Lines without words pass."""
    ends = pc.match_substring_regex(lines, SENTENCE_END).to_numpy(zero_copy_only=False)
    menu = pc.count_substring_regex(lines, SEPARATOR).to_numpy(zero_copy_only=False) > n_words * max_separators
    furniture = pc.match_substring_regex(lines, BOILERPLATE, ignore_case=True).to_numpy(zero_copy_only=False)
    return (n_words > 0) & (~ends | (n_symbols > n_words * max_symbols) | menu | furniture)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_words")


def _measure(window: int):
    def work(texts: pa.Array) -> list[pa.Array]:
        texts = texts.fill_null("")
        parts: list[list[np.ndarray]] = []
        cleaned: list[pa.Array] = []
        for lo, hi in slices(byte_view(texts)[0]):
            part = texts.slice(lo, hi - lo)
            split = pc.split_pattern(part, "\n")
            first = split.offsets.to_numpy() - split.offsets[0].as_py()
            lines = split.flatten()
            edge, data = byte_view(lines)
            data = data[edge[0] : edge[-1]]
            edge = edge - edge[0]
            inside = _IN_WORD[data]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            # lines lie end to end here, so the first byte of one begins a word whatever the line before it ended in
            starts = edge[:-1][edge[:-1] < len(data)]
            begins[starts] = inside[starts]
            words, symbols = np.diff(_up_to(begins)[edge]), np.diff(_up_to(_SYMBOL[data])[edge])
            chars = np.diff(_up_to(inside & ((data & 0xC0) != 0x80))[edge])
            fails = judge_lines(lines, words, symbols)
            of_text = lambda of_line: np.diff(_up_to(of_line)[first])
            raw = [t.as_py() for t in part.cast(pa.large_binary())]
            worded = [[line for line in t.split(b"\n") if line.strip()] for t in raw]
            repeats = np.array([len(x) - len(set(x)) for x in worded], np.int64)
            windows = np.array([repeated_words(t, window) for t in raw], np.int64)
            parts.append([of_text(words), of_text(chars), of_text(symbols), repeats, windows, of_text(words > 0), of_text(fails), of_text(words * fails)])
            stay = pa.array(_up_to(~fails)[first], pa.int32())
            cleaned.append(pc.binary_join(pa.ListArray.from_arrays(stay, lines.filter(pa.array(~fails))), "\n").cast(pa.string()))
        counts = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return [*[pa.array(c, pa.int64()) for c in counts], pa.concat_arrays(cleaned)]

    return work


def clean_lines(
    docs: DataFrame,
    keep: list[str] | None = None,
    text_col: str = "text",
    min_words: int = 20,
    max_repeated: float = 0.3,
    max_lost: float = 0.5,
    window: int = WINDOW,
) -> DataFrame:
    """``keep`` (all columns by default) with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``n_lines`` (with a word), ``n_failed_lines``, ``lost_words`` (in failed lines), ``cleaned`` (the text without
    failed lines; lines without words stay), ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeated`` of them in repeated windows.
    ``kept``: not base_failed, and no more than ``max_lost`` of the words lost. Null texts are empty, so they
    have no words and fail. Equal texts get equal results, in any order and number. A task holds the lines and
    words of one slice of texts (1 MB, or one longer text). Result columns replace columns of their name.
    """
    made = [*COUNTS, "cleaned", "base_failed", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    text = fresh("_text_", docs)
    fields = [*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("cleaned", T.StringType())]
    renamed = docs.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text_col)).cast("string").alias(text))
    out = map_texts(renamed, text, keep, fields, lambda: _measure(window))
    share = lambda x: F.col("n_words") * F.lit(str(x)).cast("decimal(10,6)")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > share(max_repeated))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost_words") <= share(max_lost)))
