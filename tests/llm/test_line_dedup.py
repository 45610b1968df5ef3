import random

import pytest
from pyspark.sql import functions as F

from tidewire.llm.line_dedup import dedup_lines, prefixes, with_partner, without_lines, word_set


def brute(texts, t=(4, 5)):
    seen, out = [], []
    for text in texts:
        gone = []
        for i, line in enumerate(text.split("\n") if text is not None else []):
            w = frozenset(x for x in line.lower().translate(str.maketrans("\t\r\f\v", "    ")).split(" ") if x)
            if not w:
                continue
            if any(t[1] * len(w & s) >= t[0] * len(w | s) for s in seen):
                gone.append(i)
            seen.append(w)
        out.append(gone)
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    texts = []
    for _ in range(60):
        mine = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(lines).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            mine.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        texts.append("\n".join(mine))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, docs_of, seed):
    texts = [*corpus(seed), None, "", "\n\n", " \t ", "Same words", "words  SAME\twords", "x" * 100_000]
    rows = dedup_lines(docs_of(texts)).orderBy("doc_id").collect()
    want = brute(texts)
    assert [list(r.removed) for r in rows] == want
    assert [r.n_lines for r in rows] == [len(t.split("\n")) if t is not None else 0 for t in texts]
    assert sum(map(len, want)) > 50


def test_texts_and_edges(spark, docs_of):
    docs = docs_of(["a b c\nnew line\n\na b c", "a b d e f g", None], ids=[4, 5, None]).withColumns({"node": F.lit(1), "removed": F.lit("x")})
    judged = dedup_lines(docs)
    rows = {r.doc_id: r for r in judged.collect()}
    assert rows[4].removed == [3] and rows[None].removed == [] and rows[5].removed == []
    got = without_lines(docs.drop("removed"), judged)
    assert sorted(r.text or "" for r in got.collect()) == ["", "a b c\nnew line\n", "a b d e f g"]
    assert dedup_lines(docs_of([])).collect() == []


@pytest.mark.parametrize("shared", [1, None])
def test_documents_that_share_an_id(spark, docs_of, shared):
    texts = ["the same line here\nfirst of its own", "the same line here\nsecond of another kind", "totally different line"]
    docs = docs_of([*texts, texts[2]], ids=[shared] * 4)
    # clashes with helper columns
    docs = docs.withColumns({c: F.lit(7) for c in ("_of", "_key", "_gone", "_rows", "_nth", "id", "key", "_id", "word", "first")})
    judged = dedup_lines(docs)
    got = sorted(r.text for r in without_lines(docs, judged).collect())
    assert len(got) == 4 and got.count("totally different line") == 1 and got.count("") == 1
    assert sum("the same line here" in x for x in got) == 1
    assert any("first of its own" in x for x in got) and any("second of another kind" in x for x in got)
    assert sorted(r.n_rows for r in judged.collect()) == [1, 1, 2]


def test_group_around_no_common_pivot(spark, docs_of):
    """Hundreds of lines around an unseen one: most do not match the earliest, and brute force decides."""
    rng = random.Random(5)
    base = [f"common{i}" for i in range(30)]
    texts = []
    for _ in range(150):
        mine = list(base)
        for _ in range(rng.randint(1, 4)):
            mine[rng.randrange(30)] = f"own{rng.randrange(10**6)}"
        texts.append(" ".join(mine))
    rows = dedup_lines(docs_of(texts)).orderBy("doc_id").collect()
    assert [list(r.removed) for r in rows] == brute(texts)


def test_no_python_in_the_tasks(spark, docs_of, monkeypatch):
    docs = docs_of(["a b c d e f g h i j", "x y\na b c d e f g h i j k", None])

    def refused(*_, **__):
        raise AssertionError("runs Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, refused)
    monkeypatch.setattr(F, "udf", refused)
    assert {r.doc_id: list(r.removed) for r in dedup_lines(docs).collect()} == {0: [], 1: [1], 2: []}


@pytest.mark.parametrize("t", [(1, 2), (9, 10)])
def test_pairs_at_the_threshold_share_a_token(spark, t):
    """Also sets of few words, which often have too few runs, and lengths on both sides of a class's end."""
    rng, rows = random.Random(7), []
    for i in range(400):
        both = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice([2, 3, 4, 5, 9, 17, 33, 60, 70, 130]))]
        own = (len(both) * t[1]) // t[0] - len(both)  # shared * t[1] >= t[0] * all
        cut = rng.randint(0, own)
        words = [f"o{rng.randrange(10**9)}" for _ in range(own)]
        rows += [(i, " ".join(both + words[:cut])), (i, " ".join(both + words[cut:]))]
    made = spark.createDataFrame(rows, "pair int, line string").select("pair", prefixes(word_set(F.col("line")), t[0] / t[1]).alias("p"), word_set(F.col("line")).alias("w"))
    two = made.groupBy("pair").agg(F.collect_list("p").alias("p"), F.collect_list("w").alias("w"))
    bad = two.where(~F.arrays_overlap(F.col("p")[0], F.col("p")[1]) & (F.col("w")[0] != F.col("w")[1]))
    assert two.count() == 400 and bad.count() == 0


def test_semi_join_has_one_exchange(spark, tmp_path):
    spark.createDataFrame([(1, 2, [1, 2])], "node long, sig long, prefix array<int>").write.parquet(f"{tmp_path}/nodes")
    joined = with_partner(spark.read.parquet(f"{tmp_path}/nodes"), 0.8)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = joined.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert "ReusedExchange" in plan
