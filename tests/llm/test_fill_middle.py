"""Fill-in-the-middle against a plain version."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.llm import queries
from tidewire.llm.fill_middle import fill_middle, restored

TEXTS = [
    "One two, three.\nFour!", "", None, "a", "\x01", "\x02", "\x021\x01\x022\x02\x01a1", "x<P>y", "<S>", "ends in <M>", "<", "<P", "ab<", ">S>", "no letters: 123 ...",
    "\U0001f600a\U0001f600b é ß c", "$1 \\1 $0 \\", "word " * 20_000, "z" * 50_000, "same text", "same text", "<<S" * 40,
]


def plain(text, doc_id, seed="1"):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(docs, rows):
    made = fill_middle(docs, ["doc_id"]).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made), key=repr)
    assert got == sorted(((i, *plain(t, i), t or "") for t, i in rows), key=repr)
    return made


def test_against_plain_version(docs_of):
    rows = [(t, i + 100 * k) for i, t in enumerate(TEXTS) for k in range(12)] + [("no id here", None)] * 3
    made = check(docs_of([t for t, _ in rows], [i for _, i in rows]), rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab<PSM>\x01\x0212 \n\U0001f600é$\\"), max_size=25), min_size=1, max_size=30))
def test_any_text(docs_of, texts):
    check(docs_of(texts), [(t, i) for i, t in enumerate(texts)])


def test_shares(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    share = {r.form: r["count"] / 20_000 for r in fill_middle(docs).groupBy("form").count().collect()}
    assert abs(share["plain"] - 0.1) < 0.01 and abs(share["spm"] - 0.18) < 0.01


def test_empty_table_columns_and_plan(spark, docs_of):
    assert fill_middle(docs_of([])).collect() == []
    odd = docs_of(["a b c"]).withColumns({c: F.lit(7) for c in ("n", "_n", "_text", "_hash", "_marked", "form", "_form", "body", "output")})
    row = fill_middle(odd).first()
    assert (row.n, row._n, row._text, row.body) == (5, 7, 7, 7) and row.output == plain("a b c", 0)[4]
    plan = fill_middle(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_query(spark, docs_of, tmp_path):
    docs_of(TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = queries.op11_fill_middle(spark, str(tmp_path)).collect()
    want = {i: plain(t, i) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) for r in rows} == {i: (*w[:4], sha(w[4])) for i, w in want.items()}
    assert all(r.restored_sha256 == sha(TEXTS[r.doc_id] or "") for r in rows)
