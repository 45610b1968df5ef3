"""Line rules and repeated windows against plain versions."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.llm.line_rules import BOILERPLATE, clean_lines, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "The river ran past the old mill, and nobody saw it. They walked on for hours until it was dark."


def fails(line):
    words = WORD.findall(line)
    if not words:
        return False
    sentence = any(re.search(r"""[.!?:;…。！？؟।]["'”’»)\]]*\Z""", w) for w in words)
    symbols = sum(c in "#*$%&|<>" for c in line)
    menu = sum(w[-1] in "|>»›·•/–-" for w in words)
    furniture = re.search(BOILERPLATE, line, re.I | re.A)
    return not sentence or symbols > 0.1 * len(words) or menu > 0.2 * len(words) or bool(furniture)


def plain(text):
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    worded = [x for x in lines if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {p for i, w in enumerate(windows) if seen[w] > 1 for p in range(i, i + 8)}
    bad = [x for x in lines if fails(x)]
    lost = sum(len(WORD.findall(x)) for x in bad)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(worded) - len(set(worded)), "n_repeat_words": len(covered), "n_lines": len(worded), "n_failed_lines": len(bad),
        "lost_words": lost, "cleaned": "\n".join(x for x in lines if not fails(x)), "base_failed": failed, "kept": not failed and 2 * lost <= len(words),
    }


TEXTS = [
    GOOD, "", None, " \t\r\n\n \x0b\x0c", "one", GOOD + "\n" + GOOD, "Home | News | Sport | Weather\n" + GOOD, "a » b » c\n" + GOOD + "\nAll Rights Reserved. 2024 by us.",
    "word " * 30, "one two three four five six seven eight nine " * 40, "Ating. " * 5000, "no end here\n" * 4 + GOOD, "no end here at all, ever\n" * 4 + GOOD,
    "né so ü. " * 12, "$$$ &&& ### " * 9 + ".", "x\n" * 300 + "y.", "\n".join(f"Line {i} is its own line, as it says." for i in range(3000)), "ends \"here.\"\nand (here.)\nnot here)",
    "z" * 200_000 + ".", "a b c d e f g h a b c d e f g h", "a b c d e f g a b c d e f g", "Trailing line \n",
]


def check(docs, texts):
    rows = {r.doc_id: r for r in clean_lines(docs, ["doc_id"]).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = plain(t)
        assert {k: rows[i][k] for k in want} == want, t and t[:80]


def test_against_plain_version(docs_of):
    check(docs_of(TEXTS), TEXTS)


def test_mixtures(docs_of):
    rng = random.Random(5)
    pool = ["a", "b", "c.", "|", "$", "dé", "\n", "\n", "\t", "cookies", "accept", "e!", "\x0b", "/", "-", "\r"]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(0, 400))) for _ in range(300)]
    check(docs_of(texts), texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_words(words):
    assert repeated_words(" ".join(words).encode()) == plain(" ".join(words))["n_repeat_words"]


def test_verdicts(docs_of):
    menu = "Home | About | News | Contact | Imprint | Help | Shop | More"
    texts = [GOOD, "\n".join([menu] * 2 + [GOOD] * 1), "\n".join([menu + f" | {i}" for i in range(5)] + [GOOD])]
    got = {r.doc_id: (r.kept, r.cleaned) for r in clean_lines(docs_of(texts)).collect()}
    assert got[0] == (True, GOOD) and got[2] == (False, GOOD)


def test_empty_table_columns_and_plan(spark, docs_of):
    assert clean_lines(docs_of([])).collect() == []
    odd = docs_of([GOOD, None]).withColumns({c: F.lit(7) for c in ("n_words", "kept", "_text_", "cleaned", "mine")})
    rows = clean_lines(odd).orderBy("doc_id").collect()
    assert (rows[0].n_words, rows[0].kept, rows[0]._text_, rows[0].mine, rows[0].text) == (20, True, 7, 7, GOOD) and not rows[1].kept
    assert "Exchange" not in clean_lines(odd)._jdf.queryExecution().executedPlan().toString()
