import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_decontaminate import words
from tidewire.llm.common import components
from tidewire.llm.jaccard_join import BRANCHES, jaccard_groups, runs_needed


def brute(ids, texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    n = len(texts)
    link = lambda i, j: i != j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    near = [[j for j in range(n) if link(i, j)] for i in range(n)]
    for i in range(n):
        for j in near[i]:
            root[find(i)] = find(j)
    out = []
    for i in range(n):
        mine = [ids[j] for j in range(n) if find(j) == find(i) and ids[j] is not None]
        out.append((ids[i], min(mine, default=None), len(near[i]), len({sets[j] for j in near[i]} - {sets[i]})))
    return Counter(out)


def corpus(seed, n):
    rng = random.Random(seed)
    say = lambda k: [rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz é ß".split()) + str(rng.randint(0, 40)) for _ in range(k)]
    shared = say(40)
    texts = []
    for _ in range(n):
        base = say(rng.randint(30, 120)) + (shared if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = say(1)[0]
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("limit,tile", [(128, 1024), (4, 5)])
def test_against_brute_force(spark, docs_of, limit, tile):
    texts = corpus(4, 40) + [None, "", "...", "one two", "One, two!", "one two three", "a b c d e"]
    ids = list(range(100, 100 + len(texts)))
    rows = jaccard_groups(docs_of(texts, ids=ids), limit=limit, tile=tile).collect()
    want = brute(ids, texts)
    assert sum(n for (_, _, links, _), n in want.items() if links) > 40
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in rows) == want


def test_edges(spark, docs_of):
    assert jaccard_groups(docs_of([])).collect() == []
    texts, ids = ["a b c d e f"] * 3 + ["z", None, "a b c d e f"], [None, None, 7, 7, None, 3]
    rows = jaccard_groups(docs_of(texts, ids=ids).withColumns({"node": F.lit(1), "n_set": F.lit("x")})).collect()
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in rows)
    assert got == Counter({(None, 3, 3): 2, (7, 3, 3): 1, (3, 3, 3): 1, (7, 7, 0): 1, (None, None, 0): 1})
    long = " ".join(str(i) for i in range(150_000))
    rows = jaccard_groups(docs_of([long, long + " more words at the end"])).collect()
    assert [r.n_links for r in rows] == [1, 1]


def test_runs():
    meets = 1.0
    for b in BRANCHES:
        meets *= 1 - 0.2**b
    for recall in (0.9, 0.99, 0.9999):
        assert 1 - (1 - meets) ** runs_needed(0.8, recall) >= recall


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 150)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5), (None, 1)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_lower_threshold(spark, docs_of):
    """At 0.5, sets of which one holds the other link down to half its size."""
    texts = []
    for d in range(12):
        long = [f"w{d}x{i}" for i in range(104)]
        texts += [" ".join(long), " ".join(long[: 70 if d % 2 else 40])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = {i: sum(2 * len(a & b) >= len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    rows = jaccard_groups(docs_of(texts), threshold=0.5).collect()
    assert {r.doc_id: r.n_links for r in rows} == want and sum(want.values()) == 12


def test_rows_without_ids_cost_no_more(spark, docs_of):
    """2,000 rows in near-copy pairs: as fast without ids as with them, and the same links."""
    import time

    rng = random.Random(8)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(1000)]
    texts = [" ".join(w) for w in base] + [" ".join([*w, "more"]) for w in base]
    took, links = [], []
    for ids in (list(range(2000)), [None] * 2000, [7] * 2000):
        began = time.monotonic()
        links.append(sorted(r.n_links for r in jaccard_groups(docs_of(texts, ids=ids)).collect()))
        took.append(time.monotonic() - began)
    assert links[0] == [1] * 2000 == links[1] == links[2]
    assert max(took[1:]) < 2 * took[0] + 5


def test_repeated_rows_without_ids(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    rows = jaccard_groups(docs_of([text] * 30 + [text + " more"] * 20, ids=[None] * 50)).collect()
    assert len(rows) == 50 and {r.n_links for r in rows} == {49} and len({r.class_node for r in rows}) == 1
