import random

import pytest
from pyspark.sql import functions as F

from tidewire.llm.mixing import mix


def fill(sizes, weights, total, most):
    """Water-filling as it is told: clamp what is above its cap, share the rest by weight, until none is above."""
    capped = set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        open_weight = sum(w for i, w in enumerate(weights) if i not in capped)
        target = [most * s if i in capped else left * weights[i] / open_weight for i, s in enumerate(sizes)]
        above = {i for i in range(len(sizes)) if i not in capped and target[i] > most * sizes[i]}
        if not above:
            return target
        capped |= above


def test_targets_and_taken(spark, docs_of):
    rng = random.Random(3)
    texts, sources = [], []
    for s, n in (("b", 40), ("a", 3), ("é", 90), ("Z", 300), (None, 12), ("c", 5)):
        for _ in range(n):
            texts.append(" ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 30))))
            sources.append(s)
    docs = docs_of(texts, sources=sources)
    rows = mix(docs).collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
    order = sorted((s for s in size if s is not None)) + [None]
    want = fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2)
    taken = {}
    for r in rows:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(want[order.index(r.source)])
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.copies * r.size + r.part_words
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in zip(order, want, strict=True):
        assert abs(taken[s] - t) <= 1
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mix(docs.repartition(7)).collect()), key=repr)


def test_edges(spark, docs_of):
    assert mix(docs_of([])).collect() == []
    rows = mix(docs_of([None, "", "  \t\n", "a b"], ids=[1, 1, None, None], sources=[None, "x", "x", "x"])).collect()
    assert sorted((r.size, r.taken > 0) for r in rows) == [(0, False), (0, False), (0, False), (2, True)]
    only_empty = mix(docs_of([None, ""])).collect()
    assert [(r.size, r.target, r.taken) for r in only_empty] == [(0, 0.0, 0)] * 2
    clash = docs_of(["a b c", "a b c"], ids=[5, 5]).withColumns({"size": F.lit("x"), "target": F.lit(1), "_order": F.lit(2)})
    assert sum(r.taken for r in mix(clash).collect()) == 9
