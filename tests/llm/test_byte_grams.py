import math
import random

import numpy as np
import pytest

from tests.llm.test_kneser_ney import say
from tidewire.llm import byte_grams as bg
from tidewire.llm import kneser_ney as kn


def brute(texts, base):
    """Interpolated modified Kneser-Ney over bytes by its definition; ``base``: the chance of a gram below order 1."""
    counts = [None, {}, {}, {}, {}, {}]
    for t in texts:
        s = b"\n" * 4 + t
        for i in range(4, len(s)):
            counts[5][s[i - 4 : i + 1]] = counts[5].get(s[i - 4 : i + 1], 0) + 1
    for k in (4, 3, 2, 1):
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    off = [None] + [kn.discounts_of([sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4)]) for k in range(1, 6)]

    def p(g, whole):
        k = len(g)
        if k == 0:
            return base(whole)
        follow = [c for h, c in counts[k].items() if h[:-1] == g[:-1]]
        if not follow:
            return p(g[1:], whole)
        take, own = (lambda c: off[k][min(c, 3) - 1]), counts[k].get(g, 0)
        return ((own - take(own)) if own else 0) / sum(follow) + sum(map(take, follow)) / sum(follow) * p(g[1:], whole)

    return lambda g: p(g, g)


def test_bits_are_those_of_the_definition(spark, monkeypatch):
    """Bytes that one class holds are told apart, the counts met by joins are those of the other fold, and blocks do not matter."""
    rng = random.Random(1)
    trusted = [say(rng, 9) for _ in range(10)] + ["ÄÖ ÜÜ ABBA ABBA 1234", "\n\nlines\n"]
    texts = [*trusted[:3], "ABBA", "BAAB", "then 42!", "Ünknown ÄÖ", "", None, "x", trusted[-1], trusted[0]]
    frame = spark.createDataFrame([(t,) for t in trusted], "_text string")
    folds = {r._text: r.f for r in spark.createDataFrame([(t,) for t in trusted + texts], "_text string").select("_text", bg.fold("_text").alias("f")).collect()}
    assert set(folds[t] for t in trusted) == {0, 1}
    cost = kn.train(frame, "_text")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 3, "_key long, _text string")
    model, shared = bg.table(frame, kn.discounts_of), spark.sparkContext.broadcast(cost)
    got = {r._scored: r for r in bg.perplexities(docs, model, shared, kn.class_chances, 3).collect()}
    monkeypatch.setattr(bg, "BLOCK_BYTES", 16)
    monkeypatch.setattr(bg, "SLICE", 8)
    assert {r._scored: r for r in bg.perplexities(docs, model, shared, kn.class_chances, 3).collect()} == got and len(got) == len(texts)

    def base(g):
        code = 0
        for b in g[-4:]:
            code = code * kn.ALPHABET + int(kn.CLASS[b])
        return 2.0 ** -float(cost[code]) / (kn.CLASS == kn.CLASS[g[-1]]).sum()

    of = [brute([t.encode() for t in trusted if folds[t] == f], base) for f in (0, 1)]
    for i, t in enumerate(texts):
        s = b"\n" * 4 + (t or "").encode()
        bits = [-math.log2(of[1 - folds[t]](s[j - 4 : j + 1])) for j in range(4, len(s))]
        assert got[i].n_bytes == len(bits)
        if not bits:
            assert got[i].bits is None and got[i].peak_bits is None
            continue
        assert got[i].bits == pytest.approx(np.mean(bits), abs=1e-4)
        assert got[i].peak_bits == pytest.approx(max(np.mean(bits[j : j + 3]) for j in range(max(1, len(bits) - 2))), abs=1e-4)


def test_capitals_and_letters_beyond_ascii_are_told_apart(spark, docs_of):
    """Junk that differs from trusted texts only within classes of bytes is not kept."""
    rng = random.Random(6)
    say_loud = lambda words: " ".join(rng.choice(words) for _ in range(40))
    good = [say_loud(["THE", "ON", "ING", "ER", "ÄÖÜ"]) for _ in range(300)]
    junk = [say_loud(["QXZ", "JK", "VWQ", "ZX", "ÐÞÝ"]) for _ in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    rows = kn.classify(docs_of(good + junk), labels, keep=["doc_id"]).orderBy("doc_id").collect()
    assert np.mean([r.kept for r in rows[150:300]]) > 0.9
    assert not any(r.kept for r in rows[300:])


def test_tables_go_when_they_are_read_no_more(spark):
    """Of what classify writes on the way, the counts, the models and the answers are not kept to the end."""
    from pathlib import Path

    from tidewire.llm.common import scratch_dir

    folder = Path(scratch_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} and more", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 5 and 1, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    assert kn.classify(docs, labels).count() == 60
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert not left & {"grams", "totals", "byte-grams", "byte-counts", "byte-totals", "byte-model", "byte-answers", "pieces", "gains"}
