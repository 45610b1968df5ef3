import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import kneser_ney as kn
from tidewire.llm import piece_ratio as pr

LABELS = "doc_id long, quality int, toxic int"


def say(rng, n):
    return " ".join("".join(rng.choice(["the", "er", "on", "ing", "at", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def brute_model(texts):
    """Interpolated modified Kneser-Ney by its definition, as a function of context and symbol."""
    counts = [None, {}, {}, {}, {}]
    for t in texts:
        s = [kn.START] * 3 + [int(kn.CLASS[b]) for b in t.encode()]
        for i in range(3, len(s)):
            g = tuple(s[i - 3 : i + 1])
            counts[4][g] = counts[4].get(g, 0) + 1
    for k in (3, 2, 1):
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    off = [None]
    for k in range(1, 5):
        n = [sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4)]
        y = n[0] / max(1, n[0] + 2 * n[1])
        d = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i * y for i in (1, 2, 3)]
        off.append([min(max(x, 0.05 * i), 0.95 * i) for i, x in enumerate(d, 1)])

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / kn.ALPHABET
        follow = [c for h, c in counts[k].items() if h[:-1] == g[:-1]]
        if not follow:
            return p(g[1:])
        total, take = sum(follow), lambda c: off[k][min(c, 3) - 1]
        own = counts[k].get(g, 0)
        return ((own - take(own)) if own else 0) / total + sum(map(take, follow)) / total * p(g[1:])

    return p


def test_model_is_kneser_ney(spark):
    rng = random.Random(1)
    texts = [say(rng, 12) for _ in range(8)]
    cost = kn.train(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    p = brute_model(texts)
    for text in (*texts[:2], "then 42!", "Ünknown"):
        s = [kn.START] * 3 + [int(kn.CLASS[b]) for b in text.encode()]
        grams = kn._grams(np.frombuffer(text.encode(), np.uint8))
        for i in range(3, len(s)):
            assert cost[grams[i - 3]] == pytest.approx(-math.log2(p(tuple(s[i - 3 : i + 1]))), rel=1e-4)
    chances = 2.0 ** -cost.reshape(-1, kn.ALPHABET).astype(float)
    assert np.allclose(chances.sum(1), 1, atol=1e-3)


def test_held_out(spark, docs_of):
    rng = random.Random(2)
    good = [say(rng, rng.randint(20, 80)) for _ in range(400)]
    junk = [t.upper().replace(" ", "### ") for t in good[:40]]
    toxic = [t.replace(" ", " zzkwq ", 3) for t in good[40:80]]
    texts = good + junk + toxic
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(i, 0, 0) for i in range(400, 410)] + [(3, 0, 0)], LABELS)
    rows = kn.classify(docs_of(texts), labels).orderBy("doc_id").collect()
    assert np.mean([r.kept for r in rows[200:400]]) > 0.97
    assert np.mean([r.kept for r in rows[400:]]) < 0.03


def test_edges(spark, docs_of):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, None, None)], LABELS)
    docs = docs_of(["the other one.", "ing", None, "", "x" * 300_000], ids=[0, 0, 1, None, 4], langs=["en", None, "en", "de", "de"]).withColumns({"kept": F.lit("mine"), "bits": F.lit(1)})
    rows = kn.classify(docs, labels, keep=["doc_id", "lang", "kept", "n_chars"]).collect()
    by = {r.n_chars: r for r in rows}
    assert by[14].kept is True and by[0].kept is False and by[300_000].kept is False
    assert by[300_000].threshold is not None
    assert len(rows) == 5
    none = spark.createDataFrame([], LABELS)
    assert sorted(r.kept for r in kn.classify(docs, none, keep=["doc_id"]).collect()) == [False, False, True, True, True]
    assert kn.classify(docs_of([]), none).collect() == []


def test_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), round(rng.random() * 9, 5)) for _ in range(500)]
    got = {r.g: r.v for r in kn.upper_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", 0.9).collect()}
    for g in "ab":
        values = sorted(v for x, v in rows if x == g)
        assert got[g] == pytest.approx(values[math.ceil(0.9 * len(values)) - 1], abs=1.1e-3)


def test_toxic_words_of_each_language(spark, docs_of):
    """Words that toxic texts overuse, made of the same syllables as clean ones, are found in texts without labels."""
    rng = random.Random(4)
    texts, langs, labels = [], [], []
    for lang, bad in (("de", "theing"), ("es", "atreon")):
        for i in range(240):
            toxic = i % 4 == 0
            words = say(rng, 80).split()
            for _ in range(8 if toxic else 0):
                words.insert(rng.randrange(len(words)), bad + rng.choice(["on", "er", "at", "re"]))
            if i < 160:
                labels.append((len(texts), 1, int(toxic)))
            texts.append(" ".join(words))
            langs.append(lang)
    frame = docs_of(texts, langs=langs)
    rows = kn.classify(frame, spark.createDataFrame(labels, LABELS), keep=["doc_id"]).orderBy("doc_id").collect()
    for first in (160, 400):
        assert np.mean([r.kept for r in rows[first : first + 80 : 4]]) < 0.15
        assert np.mean([r.kept for i, r in enumerate(rows[first : first + 80]) if i % 4]) > 0.9


def test_pieces_hold_all_bytes():
    text = "Élan abcdefghij ABCdef, über 42!!".encode()
    keys, at = pr.pieces(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    held = [(int(k) & (1 << 56) - 1).to_bytes(7, "little").rstrip(b"\0") for k in keys]
    assert b"".join(held) == text.lower().replace(b" ", b"").replace("É".encode().lower(), "É".encode())
    assert [int(k) >> 56 for k in keys] == [0, 0, 1, 2, 0, 0, 0, 0] and at.tolist() == [0, 8]


def test_short_clean_texts_stay(spark, docs_of):
    """Means over few bytes vary more: short clean texts are kept as often as long ones, and long junk has no looser bar."""
    rng = random.Random(5)
    good = [say(rng, 2 if i % 2 else 150) for i in range(800)]
    mixed = [" ".join(w.upper() if i % 8 == 0 else w for i, w in enumerate(say(rng, 150).split())) for _ in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], LABELS)
    rows = kn.classify(docs_of(good + mixed), labels, keep=["doc_id"]).orderBy("doc_id").collect()
    assert np.mean([r.kept for r in rows[401:800:2]]) > 0.95
    assert all(r.perplexity > r.threshold for r in rows[800:])
    assert rows[401].threshold > rows[400].threshold
