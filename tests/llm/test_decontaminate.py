import random
import re

from pyspark.sql import functions as F

from tidewire.llm.decontaminate import find_contamination, remove_hits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(texts, items):
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for item, body in items:
            b = words(body)
            k = min(13, len(b))
            for i in range(len(b) - k + 1) if k else ():
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == b[i : i + k]:
                        hit |= set(range(j, j + k))
                        ids.add(item)
        out.append((len(w), len(hit), sorted(str(i) for i in ids if i is not None), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_against_brute_force(spark, docs_of):
    rng = random.Random(5)
    vocab = ["Ab", "été", "c3", "Dd", "ß", "x", "Y", "漢字"]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(1, say(30)), (2, say(14)), (10, say(13)), (3, "été c3 x x"), (4, ""), (5, None), (6, "Solo"), (7, items_body := say(20)), (8, items_body)]
    texts = [None, "", "...", "solo", say(5)]
    for _ in range(25):
        piece = words(rng.choice(items)[1])
        cut = rng.randint(0, max(0, len(piece) - 13))
        texts.append(say(rng.randint(0, 200)) + " " + "-".join(piece[cut : cut + rng.randint(10, 25)]).upper().replace("ÉTÉ", "été").replace("SS", "ß") + " " + say(rng.randint(0, 40)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    assert sum(w[3] for w in want) > 5
    for limit in (1 << 20, 3000):  # one broadcast, and blocks
        rows = find_contamination(docs_of(texts), bench, keep=["doc_id"], max_broadcast_bytes=limit).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in rows] == want


def test_spans_are_removed(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    found = find_contamination(docs_of(["zero One, TWO three! four", "clean", None]), bench)
    assert [r.text for r in remove_hits(found).orderBy("doc_id").collect()] == ["zero! four", "clean", None]
    assert set(found.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}


def test_edges(spark, docs_of):
    bench = spark.createDataFrame([(None, "a b"), (2, "a b")], "item_id long, text string")
    rows = find_contamination(docs_of(["a b", "a b"], ids=[None, None]).withColumn("n_hit", F.lit("mine")), bench).collect()
    assert [(r.n_hit, r.item_ids) for r in rows] == [(2, ["2"])] * 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in find_contamination(docs_of(["a b"]), none).collect()] == [False]
    assert find_contamination(docs_of([]), bench).collect() == []
    long = "x y " * 200_000
    r = find_contamination(docs_of([long + "a b"]), bench, keep=["doc_id"]).first()
    assert (r.n_words, r.n_hit) == (400_002, 2)
