"""Alignment of two tokenizers against encoding and walking over every whole text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.llm.token_alignment import WHITE, align_tokens, cut_text, first_tokenizer, pack, safe_cuts, second_tokenizer, segment_pattern, unpack

vocabularies = pytest.importorskip("public_tokenizers")
A, B = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")


def whole(text):
    """[(a ids, b ids)] of the groups of one text, encoded whole; none if it does not come back."""
    (first, a_bytes), (second, b_bytes, _) = first_tokenizer(A), second_tokenizer(B)
    if not text:
        return []
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    raw = (" " + text).encode()
    if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
        return []
    groups, now, i, j, x, y = [], ([], []), 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a) or j == len(b):
            now[0].append(a[i])
            x += len(a_bytes[a[i]])
            i += 1
        else:
            now[1].append(b[j])
            y += len(b_bytes[b[j]])
            j += 1
        if x == y and now[0] and now[1]:
            groups.append(now)
            now = ([], [])
    assert now == ([], [])
    return groups


def plain(texts):
    docs = [whole(t) for t in texts]
    links = [[(g[0][-1], g[1][-1]) for g in d] for d in docs]
    n = Counter(x for d in links for x in d)
    most = {}
    for (_, b), k in n.items():
        most[b] = max(most.get(b, 0), k)
    listed = lambda d: ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in d)
    return [
        (sum(len(g[0]) for g in d), sum(len(g[1]) for g in d), len(d), len(d), sum(n[x] == most[x[1]] for x in own), sum(n[x] for x in own), listed(d))
        for d, own in zip(docs, links, strict=True)
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
TEXTS = [
    "The cat sat on the mat.", "", None, " ", "  ", "\n", "a", "a ", "a  ", " a", "  a  b ", "a\nb", "a\n\n b\t\tc\r\nd", "\r", "x;\r y", "x　y 　 z w", "▁", "has ▁ in it",
    "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll I'M 12345 6.5e-7", "naïve café Ünïcödé 漢字かな 한국어 \U0001f600\U0001f601 é", "\x00\x01\x1c \x1f", "﻿bom", "z" * 3000, "ab" * 2000 + " ",
    "The cat sat on the mat.", "the the the the", "    indented\n        more\n\ttab", "word " * 4000, " line par ​ zero", "!!! ??? ...   ---", "a\x0bb\x0cc\x85d",
]


def got(df):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize(("chars", "bucket"), [(1, 200_000), (500, 3), (16_000_000, 200_000)])
def test_against_whole_texts(docs_of, chars, bucket):
    want = plain(TEXTS)
    assert got(align_tokens(docs_of(TEXTS), A, B, ["doc_id"], block_chars=chars, bucket_segments=bucket)) == dict(enumerate(want))
    assert want[16][:3] == (0, 0, 0) and want[17][:3] == (0, 0, 0) and want[0] == want[25]


def test_mixtures(docs_of):
    rng = random.Random(3)
    pool = ["a", "the", "ing", "Straße", "é", "漢", "\U0001f600", " ", "  ", "\n", "\t", "\r", "　", "▁", ".", "'s", "12", ";", "\x1c", "\xa0", "<s>"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(30))) for _ in range(400)]
    assert got(align_tokens(docs_of(texts), A, B, ["doc_id"], block_chars=700)) == dict(enumerate(plain(texts)))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab'.1 " + WHITE), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_segments_make_up_the_text(text):
    pattern = segment_pattern(safe_cuts(A, B))
    segments = cut_text(pattern, text) if text else []
    assert "".join(segments) == (" " + text if text else "")
    first = first_tokenizer(A)[0]
    ids = [i for s in segments for i in first.encode(s, add_special_tokens=False).ids]
    assert not text or ids == first.encode(" " + text, add_special_tokens=False).ids


def test_cuts_are_checked():
    cuts = safe_cuts(A, B)
    assert " " in cuts and "\n" in cuts and "\r" not in cuts
    with pytest.raises(ValueError):
        safe_cuts(vocabularies.path("word_bpe_49k.json"), B)


def test_pack():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 268435456, 2**31 - 1])
    rows = pack(values, np.array([0, 3, 0, 7]))
    assert [unpack(r).tolist() for r in rows.to_pylist()] == [[], values[:3].tolist(), [], values[3:].tolist()]


def test_repeats_nulls_and_columns(spark, docs_of):
    assert align_tokens(docs_of([]), A, B).collect() == []
    only = align_tokens(docs_of([None, ""]), A, B).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in only] == [(0, 0, 0, 0, 0, 0, "")] * 2
    texts = ["same words here"] * 50 + [None] * 3
    rows = align_tokens(docs_of(texts, [None] * 53).withColumns({c: F.lit(7) for c in ("n_a", "block", "_path", "groups", "seg")}), A, B).collect()
    want = plain(texts)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(want) and all(r.block == r._path == r.seg == 7 for r in rows)


def test_query(spark, docs_of, tmp_path):
    from tidewire.llm import queries

    docs_of(TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op13_token_alignment(spark, str(tmp_path)).collect()}
    for i, w in enumerate(plain(TEXTS)):
        assert tuple(rows[i][c] for c in COLUMNS[:6]) == w[:6]
        assert rows[i].groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[2] else "")
