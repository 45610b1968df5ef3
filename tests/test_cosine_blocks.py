import numpy as np

from tidewire.operators import semantic


def test_few_similarities_at_once_change_nothing(spark, monkeypatch):
    """Tasks compute at most CELLS similarities at a time; what they have seen bounds what they give out, vectors with NaN bound nothing."""
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=8).tolist() for _ in range(120)]
    rows = rows + rows[:20] + [[float("nan")] * 8] * 9 + [[0.0] * 8] + [rng.normal(size=3).tolist() for _ in range(15)]
    kind = "embedding array<double>"
    items = spark.createDataFrame(list(enumerate(rows)), f"item_id long, {kind}").repartition(2)
    queries = spark.createDataFrame([(i, r) for i, r in enumerate(rows) if i % 3 == 0], f"query_id long, {kind}")
    monkeypatch.setattr(semantic, "CELLS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {(r.query_id, r["rank"]): r for r in semantic.cosine_top_k(queries, items, 4, 0.1).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for q in range(0, len(rows), 3):
        scored = []
        for i, r in enumerate(rows):
            a, b = np.array(rows[q]), np.array(r)
            if len(a) == len(b) and (n := np.linalg.norm(a) * np.linalg.norm(b)) and a @ b / n >= 0.1:
                scored.append((-round(float(a @ b / n), 9), i))
        want |= {(q, at + 1): -s for at, (s, _) in enumerate(sorted(scored)[:4])}
    assert set(got) == set(want) and all(abs(got[k].similarity - want[k]) < 1e-8 for k in want)
