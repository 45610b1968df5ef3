"""The pipeline's stages in a row on a small corpus with planted cases, and each stage against brute force."""

import random

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard_join import brute as linked

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice(["the", "er", "on", "ing", "at", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."
    texts = [say(rng.randint(40, 90)) for _ in range(200)]
    items = [(i, say(16)) for i in range(5)]
    texts += [texts[i] for i in range(10)]  # copies: 200-209
    texts += [f"{texts[i]} at" for i in range(10, 20)]  # near copies: 210-219
    texts += [f"{say(20)} {items[i % 5][1]} {say(20)}" for i in range(5)]  # contaminated: 220-224
    texts += [say(40).upper().replace(" ", "!! ") for _ in range(10)]  # junk: 225-234
    texts += ["", None]
    return texts, items


def test_stages(spark, docs_of, tmp_path):
    texts, items = corpus()
    docs = docs_of(texts, sources=["ab"[i % 2] for i in range(len(texts))])
    root = str(tmp_path)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(i, 0, 0) for i in range(225, 230)], LABELS).write.parquet(f"{root}/labels.parquet")
    now, kept = spark.read.parquet(f"{root}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, root).write.parquet(f"{root}/stage{i}")
        now = spark.read.parquet(f"{root}/stage{i}")
        kept.append([(r.doc_id, r.text) for r in now.collect()])
        if i < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
    first = {i for i, _ in kept[0]}
    assert not first & set(range(225, 237)) and len(first & set(range(225))) >= 215
    ids, words = zip(*sorted(kept[0]), strict=True)
    classes = {}
    for (doc, cls, _, _), _ in linked(list(ids), list(words)).items():
        classes.setdefault(cls, []).append(doc)
    assert sorted(i for i, _ in kept[1]) == sorted(min(x) for x in classes.values())
    before = sorted(kept[1])
    clean = [i for (i, _), (*_, bad) in zip(before, contaminated([t for _, t in before], items), strict=True) if not bad]
    assert sorted(i for i, _ in kept[2]) == clean and not set(clean) & set(range(220, 225))
    assert {i for i, _ in kept[3]} <= set(clean)
    size = lambda rows: sum(len((t or "").split()) for _, t in rows)
    assert abs(size(kept[3]) - 1.5 * size(kept[2])) < 200
    assert sorted(kept[4]) == sorted(kept[3]) and "shard" in now.columns
    assert corpus_pipeline.run(spark, root).count() == len(kept[4])


def test_empty_tables(spark, docs_of, tmp_path):
    root = str(tmp_path)
    docs_of([]).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{root}/labels.parquet")
    assert corpus_pipeline.run(spark, root).collect() == []


def test_repeated_rows_and_missing_ids(spark, docs_of):
    long = "one two three four five six seven"
    docs = docs_of([long, long, "other words here to stay for now", None, None, "", long], ids=[5, 5, None, 9, None, 8, 7])
    rows = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in rows) == [((False, 5), long), ((False, 8), ""), ((False, 9), ""), ((True, 0), ""), ((True, 0), "other words here to stay for now")]


def test_mixture_without_ids(spark, docs_of):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefghij", k=10)) + f" {i}" for i in range(300)]
    docs = docs_of(texts, ids=[None] * 300, sources=[None] * 100 + ["a"] * 100 + ["b"] * 100)
    rows = corpus_pipeline.mixture(spark, docs, "").collect()
    # weights 5, 2, 1 and twice their size at most: a and b, then none, of 3,300 words
    assert abs(len(rows) - 450) <= 3 and {r.text for r in rows} <= set(texts)
    same = docs_of(["ten words are in this text and all the same"] * 100, ids=[None] * 100)
    assert abs(len(corpus_pipeline.mixture(spark, same, "").collect()) - 150) <= 1
