import pytest

from tidewire.operators import matching
from tidewire.operators.matching import Matcher, Text, entity_terms, match_documents


def term(surface, language="en", exact_only=False, source="canonical"):
    return {"surface": surface, "language": language, "exact_only": exact_only, "source": source}


def match(terms, title, body, exclusions=()):
    return Matcher(list(terms), list(exclusions)).match(Text(title), Text(body))


def kinds(found):
    return [h["match_type"] for h in found["hits"]]


@pytest.mark.parametrize(
    "terms,title,body,exclusions,want",
    [
        ([term("Harbour Line")], "Harbour Line opens", "", [], "exact"),
        ([term("Harbour Line")], "", "the HARBOUR LINE opens", [], "case_insensitive_en"),
        ([term("أحمد الصباح", "ar")], "", "قال احمد الصباح اليوم", [], "arabic_normalized"),
        ([term("شركة", "ar"), term("الخطوط", "ar", source="alias")], "", "هذه الخُطوط", [], "alias"),
        ([term("Harbour Lines")], "", "a harbour line a", [], "controlled_fuzzy"),
        ([term("Harbour Line")], "", "nothing here", [], None),
    ],
)
def test_layers(terms, title, body, exclusions, want):
    found = match(terms, title, body, exclusions)
    assert (found is None) if want is None else (want in kinds(found) and kinds(found)[0] == want)


def test_exclusion_comes_first():
    found = match([term("Harbour Line")], "Harbour Line", "a Water-Park story", ["water park"])
    assert found == {"excluded": True, "phrase": "water park", "hits": []}
    assert match([term("Harbour Line")], "nothing", "water park", ["water park"])["excluded"]


def test_order_dedupe_and_limit():
    found = match([term("ab cd"), term("AB cd")], "x", "ab cd AB CD " * 8)
    assert len(found["hits"]) == 10 and kinds(found) == ["exact"] * 8 + ["case_insensitive_en"] * 2
    # hits without offsets share a key: one fuzzy hit a field, whatever the terms
    found = match([term("harbour lines"), term("harbour liner")], None, "harbour line harbour linez")
    assert kinds(found).count("controlled_fuzzy") == 1


def test_exact_only_stops_fuzzy_alone():
    assert match([term("Harbour Lines", exact_only=True)], "", "harbour line") is None
    assert kinds(match([term("Harbour Lines", exact_only=True)], "", "harbour, LINES")) == ["arabic_normalized"]


def test_offsets():
    hit = match([term("Straße", "de")], "", "eine STRASSE, eine Straße")["hits"][0]
    assert (hit["start"], hit["end"]) == (19, 25)


def test_on_frames(spark):
    entities = spark.createDataFrame([(1, "Harbour Line", None), (2, None, "الخطوط")], "entity_id long, name_en string, name_ar string")
    aliases = spark.createDataFrame([(1, 0, "HL", "en", True), (2, 0, " ", "ar", False)], "entity_id long, pos int, alias_text string, language string, exact_only boolean")
    terms = entity_terms(entities, aliases)
    assert [(r.entity_id, r.pos, r.source) for r in terms.orderBy("entity_id", "pos").collect()] == [(1, 0, "canonical"), (1, 2, "alias"), (2, 1, "canonical")]
    docs = spark.createDataFrame([(1, "t", "on the harbour line"), (2, None, None), (3, "HL", "stop words")], "doc_id long, title string, body string")
    vetoes = spark.createDataFrame([(1, "stop words")], "entity_id long, phrase string")
    rows = match_documents(docs, terms, vetoes).orderBy("doc_id").collect()
    assert [(r.doc_id, r.entity_id, r.excluded, r.match_type) for r in rows] == [(1, 1, False, "case_insensitive_en"), (3, 1, True, None)]
    assert match_documents(docs, terms.limit(0), vetoes).collect() == match_documents(docs.limit(0), terms, vetoes).collect() == []


def test_pieces_of_a_term():
    import difflib
    import random

    from tidewire.operators.matching import FUZZY_RATIO, edits, fuzzy_pieces

    rng = random.Random(1)
    near = 0
    for _ in range(4000):
        term = "".join(rng.choice("abc d") for _ in range(rng.randint(6, 30)))
        gram = list(term)
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(gram) + 1)
            gram[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        gram = "".join(gram)
        if difflib.SequenceMatcher(None, gram, term).ratio() >= FUZZY_RATIO:
            near += 1
            d = edits(len(term), len(gram))
            pieces = [p for p in fuzzy_pieces(term) if p[2] == d]
            assert "".join(p for p, _, _ in pieces) == term and len(pieces) == d + 1
            assert any(gram[at : at + len(p)] == p for p, o, _ in pieces for at in range(max(0, o - d), o + d + 1))
    assert near > 800


def test_grams_near_spots():
    import random

    import numpy as np

    from tidewire.operators.matching import BODY, FuzzyTerms, fuzzy_pieces, near_grams, packed

    rng = random.Random(6)
    vocab = ["harbour", "harbor", "line", "lines", "liner", "a", "port", "ports", "portal", "المطار", "مطار"]
    terms = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    for _ in range(60):
        tokens = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        text = " ".join(tokens)
        spots = {t: [packed(at, o, d, BODY) for p, o, d in fuzzy_pieces(t) for at in range(len(text)) if text.startswith(p, at)] for t in terms if len(t) >= 6}
        spots = {t: np.array(places) for t, places in spots.items() if places}
        assert near_grams(tokens, spots) == FuzzyTerms(terms).find(tokens)


def plain_fuzzy(term, tokens):
    import difflib

    out, wide = [], len(term.split())
    for i in range(len(tokens)):
        for n in (wide, wide + 1):
            gram = " ".join(tokens[i : i + n])
            if gram != term and (r := difflib.SequenceMatcher(None, gram, term).ratio()) >= 0.92:
                out.append((r, gram))
    return sorted(out, key=lambda x: -x[0])[:3] if len(term) >= 6 else []


def test_fuzzy_against_a_plain_loop():
    import random

    from tidewire.operators.matching import FuzzyTerms

    rng = random.Random(4)
    vocab = ["harbour", "harbor", "line", "lines", "liner", "a", "port", "ports", "portal", "المطار", "مطار"]
    terms = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    found = 0
    for _ in range(60):
        tokens = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        got = FuzzyTerms(terms).find(tokens)
        for t in terms:
            assert got.get(t, []) == plain_fuzzy(t, tokens)
            found += len(got.get(t, []))
    assert found > 200


def test_frames_against_a_plain_loop(spark):
    import random

    rng = random.Random(8)
    vocab = ["Harbour", "harbor", "Line", "lines", "liner", "a", "PORT", "ports", "portal", "Straße", "STRASSE", "المطار", "x-y"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [(i, say(rng.randint(0, 4)), say(rng.randint(0, 40))) for i in range(60)]
    entities = {e: ([term(say(rng.randint(1, 3)), exact_only=rng.random() < 0.3, source=rng.choice(["canonical", "alias"])) for _ in range(rng.randint(1, 3))], [say(3)] if rng.random() < 0.3 else []) for e in range(20)}
    rows = [(e, i, t["surface"], t["language"], t["exact_only"], t["source"]) for e, (ts, _) in entities.items() for i, t in enumerate(ts)]
    frame = spark.createDataFrame(rows, "entity_id long, pos int, surface string, language string, exact_only boolean, source string")
    vetoes = spark.createDataFrame([(e, x) for e, (_, xs) in entities.items() for x in xs], "entity_id long, phrase string")
    got = {(r.doc_id, r.entity_id): r for r in match_documents(spark.createDataFrame(docs, "doc_id long, title string, body string"), frame, vetoes).collect()}
    want = {(d, e): m for d, title, body in docs for e, (ts, xs) in entities.items() if (m := match(ts, title, body, xs)) is not None}
    assert set(got) == set(want) and len(want) > 300
    for key, m in want.items():
        assert got[key].excluded == m["excluded"] and got[key].phrase == m["phrase"]
        assert [h.asDict() for h in got[key].evidence] == m["hits"]


def test_evidence_is_given_out_in_parts(spark, monkeypatch):
    """A task does not hold the evidence of all documents of a frame; parts change no row."""
    docs = spark.createDataFrame([(i, "Acme Corp", f"Beta Works and acme corp number {i}") for i in range(40)], "doc_id long, title string, body string").coalesce(1)
    terms = spark.createDataFrame([(e, 0, n, "en", True, "canonical") for e, n in enumerate(("Acme Corp", "Beta Works"))], "entity_id long, pos int, surface string, language string, exact_only boolean, source string")
    none = spark.createDataFrame([], "entity_id long, phrase string")
    found = lambda: sorted(map(repr, matching.match_documents(docs, terms, none).collect()))
    whole = found()
    monkeypatch.setattr(matching, "GIVEN_ROWS", 7)
    assert len(whole) == 80 and found() == whole


def evidence_of(spark, docs, names):
    terms = spark.createDataFrame([(e, 0, n, "en", False, "canonical") for e, n in enumerate(names)], "entity_id long, pos int, surface string, language string, exact_only boolean, source string")
    frame = spark.createDataFrame(docs, "doc_id long, title string, body string")
    return sorted(map(repr, match_documents(frame, terms, spark.createDataFrame([], "entity_id long, phrase string")).collect()))


def test_pieces_joined_or_held(spark, monkeypatch):
    """Few fuzzy terms are looked up in the tasks, many are joined; the evidence is the same, however texts are put together."""
    import random

    rng = random.Random(9)
    vocab = ["Harbour", "harbor", "Line", "lines", "liner", "a", "PORT", "ports", "portal", "المطار", "مطار", "x-y", "été"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs, names = [(i, say(rng.randint(0, 4)), say(rng.randint(0, 40))) for i in range(50)], [say(rng.randint(1, 3)) for _ in range(15)]
    held = evidence_of(spark, docs, names)
    assert sum("controlled_fuzzy" in r for r in held) > 20
    monkeypatch.setattr(matching, "PIECED_CHARS", 100)
    assert evidence_of(spark, docs, names) == held
    monkeypatch.setattr(matching, "HELD_PIECES", 0)
    assert evidence_of(spark, docs, names) == held


def test_few_pieces_pass_the_filter(monkeypatch):
    """Of pieces that no name has, hardly any leave the task; a name's piece has three bits for that, not one."""
    import numpy as np
    import pyarrow as pa

    class Frame:
        sparkSession = sparkContext = property(lambda self: self)

        def broadcast(self, value):
            return type("Shared", (), {"value": value})()

        def mapInArrow(self, run, schema):
            return run

    text = "".join(chr(97 + i * i % 23) + chr(97 + i % 26) + chr(97 + i // 7 % 25) for i in range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([""]), pa.array([text])], names=["doc", "title", "body"])

    def passed(shifts):
        monkeypatch.setattr(matching, "FILTER_SHIFTS", shifts)
        size, bits = 1 << 16, np.zeros(1 << 13, np.uint8)
        for n in range(4000):
            key = matching._key(f"{n:08d}", matching.BODY) & (1 << 64) - 1
            for shift in shifts:
                bits[(key >> shift & size - 1) >> 3] |= 1 << (key >> shift & 7)
        rows = matching.text_pieces(Frame(), {matching.BODY: [8]}, bits)([batch])
        return len({text[at : at + 8] for b in rows for at in b.column(b.schema.get_field_index("at")).to_pylist()})

    different = len({text[i : i + 8] for i in range(len(text) - 7)})
    shifts = matching.FILTER_SHIFTS
    assert passed(shifts) * 150 < different and passed((0,)) * 30 > different
