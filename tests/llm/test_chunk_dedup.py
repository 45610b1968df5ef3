import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm.chunk_dedup import MAX_CHUNK, MIN_CHUNK, cuts, dedup_substrings


def say(rng, n):
    return " ".join("".join(rng.choice("abcdeéfghijß") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_cuts_resist_insertions():
    rng = random.Random(1)
    text = say(rng, 3000).encode()
    ends = lambda raw: cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    plain = ends(text)
    sizes = np.diff([0, *plain])
    assert plain[-1] == len(text) and sizes[:-1].min() >= MIN_CHUNK and sizes.max() <= MAX_CHUNK
    moved = {e - 7 for e in ends(text[:5000] + b"inserts" + text[5000:]) if e > 5600}
    assert moved == {e for e in plain if e > 5593}


def test_repeated_passages_go(spark, docs_of):
    rng = random.Random(2)
    passages = [say(rng, 60) for _ in range(6)]
    texts = [say(rng, rng.randint(20, 200)) for _ in range(40)]
    clean = list(range(0, 40, 2))
    holders = {p: [] for p in range(6)}
    for i in range(1, 40, 2):
        p = rng.randrange(6)
        at = rng.randint(0, len(texts[i]))
        texts[i] = f"{texts[i][:at]} {passages[p]} {texts[i][at:]}"
        holders[p].append(i)
    rows = dedup_substrings(docs_of(texts)).orderBy("doc_id").collect()
    for i in clean:
        assert rows[i].text == texts[i] and rows[i].n_removed == 0
    for p, ids in holders.items():
        for i in ids[:1]:
            assert passages[p] in rows[i].text
        for i in ids[1:]:
            assert passages[p][10:-10] not in rows[i].text and rows[i].n_removed > len(passages[p].encode()) - 20
            assert set(rows[i].text.split()) <= set(texts[i].split()) | {w for w in rows[i].text.split() if len(w) < 12}


def test_edges(spark, docs_of):
    rng = random.Random(3)
    text = say(rng, 100)
    rows = dedup_substrings(docs_of([None, "", text, text, text], ids=[None, 0, 1, 1, 2]).withColumn("removed", F.lit(1))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.text, r.n_removed > 0))
    assert by[None] == [(None, False)] and by[0] == [("", False)]
    assert sorted(by[1]) == [("", True), (text, False)]  # one row of the two is the document
    assert by[2] == [("", True)]
    assert dedup_substrings(docs_of([])).collect() == []
    long = dedup_substrings(docs_of([(text + " ") * 3000])).first()
    assert long.n_removed > 0.9 * long.n_bytes
    emoji = "😀é" * 200
    assert [r.text for r in dedup_substrings(docs_of([emoji, "x " + emoji])).orderBy("doc_id").collect()][0].encode()


@pytest.mark.parametrize("shared", [1, None])
def test_documents_that_share_an_id(spark, docs_of, shared):
    rng = random.Random(4)
    passage = say(rng, 80)
    texts = [say(rng, 50) + " " + passage, say(rng, 90) + " " + passage, say(rng, 120)]
    docs = docs_of(texts, ids=[shared] * 3).withColumns({c: F.lit(1) for c in ("_id", "_key", "key", "id", "spots", "_text_")})
    got = {r.text for r in dedup_substrings(docs).collect()}
    assert texts[2] in got and sum(passage in t for t in got) == 1
    own = [t[: -len(passage) - 1] for t in texts[:2]]
    assert all(any(t.startswith(o) for t in got) for o in own)


def repeated_words(texts, n=50):
    """For each word of each text: whether an earlier text, or an earlier place, has n words in a row that hold it."""
    seen, out = set(), []
    for t in texts:
        w = t.split(" ")
        hit = [False] * len(w)
        for i in range(len(w) - n + 1):
            gram = tuple(w[i : i + n])
            if gram in seen:
                hit[i : i + n] = [True] * n
            seen.add(gram)
        out.append(hit)
    return out


def test_against_brute_force(spark, docs_of):
    """Passages of 51 to 90 words, short ones too, in changing surroundings: what goes is what a scan of all word windows finds."""
    rng = random.Random(6)
    short = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(n))
    passages = [say(rng, rng.randint(51, 90)) for _ in range(30)] + [short(rng.randint(51, 90)) for _ in range(30)]
    texts = [" ".join([say(rng, rng.randint(1, 60)), rng.choice(passages), say(rng, rng.randint(1, 60)), rng.choice(passages)]) for _ in range(120)]
    rows = dedup_substrings(docs_of(texts)).orderBy("doc_id").collect()
    missed = more = total = 0
    for text, hit, r in zip(texts, repeated_words(texts), rows, strict=True):
        at, gone = 0, [(s.start, s.end) for s in r.removed]
        for word, want in zip(text.split(" "), hit, strict=True):
            size = len(word.encode())
            got = any(s <= at and at + size <= e for s, e in gone)
            total, missed, more = total + want, missed + (want and not got), more + (got and not want)
            at += size + 1
    assert total > 4000 and missed <= 0.01 * total and more <= 0.01 * total


def test_one_of_many_equal_rows_stays(spark, monkeypatch):
    from tidewire.llm import chunk_dedup

    monkeypatch.setattr(chunk_dedup, "LOT", 7)
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(None, long)] * 30 + [(5, "short")] * 8 + [(5, "other")] * 2 + [(6, None)] * 3 + [(7, "")] * 9 + [(8, "é one")]
    got = chunk_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got if r.text) == [(False, 5, "other"), (False, 5, "short"), (False, 8, "é one"), (True, 0, long)]
    assert len(got) == len(rows) and sum(r.text is None for r in got) == 3
    gone = [r for r in got if r.n_removed]
    assert len(gone) == 29 + 7 + 1 and all(r.text == "" and [tuple(s) for s in r.removed] == [(0, r.n_bytes)] and r.n_removed == r.n_bytes for r in gone)
    assert all(r.n_bytes == len((r.text or "").encode()) and r.removed == [] for r in got if not r.n_removed)
