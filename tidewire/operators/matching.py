"""Lexical matching of monitored entities in documents.

``entity_terms`` makes the terms; ``existence`` answers which entity's names occur
where, by one automaton; ``match_documents`` gives the full evidence: layers exact, case-
insensitive, normalised and fuzzy, an exclusion veto before them, and the ten best
hits. Which entity may be in which document is found by a join of pieces of names with pieces of
texts, and only such pairs are looked at; no task holds all entities, and the pieces of all fuzzy terms only if they are HELD_PIECES at most.
"""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewire.functions.text import ALEFS, ARABIC_DIGITS, DIACRITICS, TATWEEL, normalize_text
from tidewire.session import checkpointed

#: How match types rank, and the limits of fuzzy matching and of evidence.
RANK = {"exact": 5, "case_insensitive_en": 4, "arabic_normalized": 3, "alias": 3, "controlled_fuzzy": 1}
FUZZY_RATIO, FUZZY_CHARS, FUZZY_BEST, HITS_KEPT = 0.92, 6, 3, 10
_MARKS = re.compile(DIACRITICS)
_FOLD = str.maketrans(dict.fromkeys(ALEFS, "ا") | dict(zip(ARABIC_DIGITS, "0123456789", strict=True)) | {TATWEEL: None})
_FOLDED = re.compile(f"[{''.join(map(chr, _FOLD))}]")


def normalized(text: str | None) -> str:
    """What functions.text.normalize_text gives, for one string."""
    t = unicodedata.normalize("NFKC", text or "").strip().lower()
    if not t.isascii():
        t = _MARKS.sub("", t)
        t = t.translate(_FOLD) if _FOLDED.search(t) else t
    return " ".join(re.sub(r"[^\w\s]", " ", t).split())


#: Words of texts repeat, so what they fold to is remembered.
_folded_word = lru_cache(maxsize=1 << 16)(normalized)


def entity_terms(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, pos, surface, language, exact_only, source): the English name, the Arabic name, then aliases as stored."""
    names = entities.select(
        "entity_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("pos"), F.col("name_en").alias("surface"), F.lit("en").alias("language")),
                F.struct(F.lit(1).alias("pos"), F.col("name_ar").alias("surface"), F.lit("ar").alias("language")),
            )
        ).alias("t"),
    ).select("entity_id", "t.*", F.lit(False).alias("exact_only"), F.lit("canonical").alias("source"))
    more = aliases.select("entity_id", (F.col("pos") + 2).alias("pos"), F.col("alias_text").alias("surface"), "language", "exact_only", F.lit("alias").alias("source"))
    return names.unionByName(more).where(F.trim("surface") != "")


def existence(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(id, entity_id, surface, exact_hits, folded_hits): how often each term occurs, as written and in
    lower case, without overlaps. Pairs without a hit are left out.

    One automaton of all terms is broadcast below ``max_broadcast_bytes`` (in blocks beyond it), and
    each text is run through it once, whatever the number of terms.
    """
    import ahocorasick

    spark = docs.sparkSession
    size = terms.agg(F.sum(F.octet_length("surface") * 40 + 100)).first()[0] or 0
    blocks = max(1, -(-size // max_broadcast_bytes))
    kinds = (docs.schema[id_col].dataType.simpleString(), terms.schema["entity_id"].dataType.simpleString())
    out = None
    for block in range(blocks):
        part = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("surface"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([(r.entity_id, r.surface) for r in part.select("entity_id", "surface").distinct().collect()])

        def run(frames: Iterable[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            by_lower: dict[str, list] = {}
            for entity, surface in shared.value:
                by_lower.setdefault(surface.lower(), []).append((entity, surface))
            automaton = ahocorasick.Automaton()
            for low in by_lower:
                automaton.add_word(low, low)
            automaton.make_automaton()
            for frame in frames:
                found = []
                for doc_id, text in zip(frame[id_col], frame[text_col], strict=True):
                    lower = (text or "").lower()
                    for low in {x for _, x in automaton.iter(lower)} if by_lower else ():
                        n = lower.count(low)
                        found += [(doc_id, entity, surface, text.count(surface), n) for entity, surface in by_lower[low]]
                yield pd.DataFrame(found, columns=[id_col, "entity_id", "surface", "exact_hits", "folded_hits"])

        mine = docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kinds[0]}, entity_id {kinds[1]}, surface string, exact_hits long, folded_hits long")
        out = mine if out is None else out.unionByName(mine)
    return out


def surroundings(text: str, start: int, end: int, around: int = 80) -> str:
    """What functions.text.match_window gives, for one string."""
    lo, hi = max(0, start - around), min(len(text), end + around)
    return ("…" if lo else "") + text[lo:hi].strip() + ("…" if hi < len(text) else "")


class Text:
    """A field of a document, and what is made of it once for all entities."""

    def __init__(self, raw: str | None):
        self.raw = raw or ""
        self.lower = self.raw.lower()
        self.folded = normalized(self.raw)

    @cached_property
    def words(self) -> list[tuple[int, int, str]]:
        return [(m.start(), m.end(), _folded_word(m.group())) for m in re.finditer(r"\S+", self.raw)]

    @cached_property
    def places(self) -> dict[str, list[int]]:
        """Where the words stand, by what they fold to."""
        out: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            out.setdefault(w[2], []).append(i)
        return out

    @cached_property
    def tokens(self) -> list[str]:
        return self.folded.split()


class FuzzyTerms:
    """Terms held against all runs of words of a text at once.

    The ratio of two strings is at most twice the characters that they share, in whatever order, over
    both lengths, and each kind of character that only one of them has is one not shared; only pairs
    that pass both are compared in full.
    """

    def __init__(self, terms: Iterable[str]):
        self.terms = sorted({t for t in terms if len(t) >= FUZZY_CHARS})
        self.sizes = np.array([len(t) for t in self.terms], np.int64)
        self.counts = np.array([self._counts(t, np.zeros(len(t), np.int64), 1)[0] for t in self.terms], np.int64).reshape(-1, 64)
        self.kinds = self._kinds(self.counts)
        wide: dict[int, list[int]] = {}
        for k, t in enumerate(self.terms):
            for n in (len(t.split()), len(t.split()) + 1):
                wide.setdefault(n, []).append(k)
        self.by_width = {n: np.array(ks) for n, ks in wide.items()}

    @staticmethod
    def _counts(text: str, row: np.ndarray, rows: int) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) & 63
        return np.bincount(row * 64 + codes, minlength=rows * 64).reshape(rows, 64)

    @staticmethod
    def _kinds(counts: np.ndarray) -> np.ndarray:
        """A bit for each kind of character."""
        return ((counts > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def find(self, tokens: list[str]) -> dict[str, list[tuple[float, str]]]:
        """For each term the three most alike runs of as many words, or one more; of equal ones the first."""
        n_tokens, found = len(tokens), {}
        if not n_tokens or not self.terms:
            return {}
        sizes = np.array([len(t) for t in tokens])
        counts = self._counts("".join(tokens), np.repeat(np.arange(n_tokens), sizes), n_tokens)
        upto, kinds = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(counts, axis=0))), self._kinds(counts)
        size_upto = np.concatenate(([0], np.cumsum(sizes)))
        start, judge = np.arange(n_tokens), difflib.SequenceMatcher()
        for width, ks in self.by_width.items():
            stop = np.minimum(start + width, n_tokens)
            long = size_upto[stop] - size_upto[start] + stop - start - 1
            held = kinds.copy()
            for more in range(1, width):
                held[:-more] |= kinds[more:] | np.uint64(1 << 32)  # the blank between words
            both = long[:, None] + self.sizes[ks][None, :]
            i, j = np.nonzero(np.bitwise_count(held[:, None] ^ self.kinds[ks][None, :]) <= (1 - FUZZY_RATIO) * both + 1e-9)
            for lo in range(0, len(i), 1 << 14):
                a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
                grams = upto[stop[a]] - upto[start[a]]
                grams[:, 32] += stop[a] - start[a] - 1  # blanks between words
                shared = np.minimum(grams, self.counts[ks[b]]).sum(1)
                near = 2 * shared >= FUZZY_RATIO * both[a, b] - 1e-9
                for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                    term, gram = self.terms[ks[y]], " ".join(tokens[x : x + width])
                    if gram != term:
                        judge.set_seqs(gram, term)
                        if (r := judge.ratio()) >= FUZZY_RATIO:
                            found.setdefault(term, []).append((-r, x, width, gram))
        return {term: [(-r, gram) for r, _, _, gram in sorted(hits)[:FUZZY_BEST]] for term, hits in found.items()}


class Matcher:
    """Finds one entity's terms in a document's title and body."""

    def __init__(self, terms: list[dict], exclusions: list[str]):
        self.terms = [t | {"folded": normalized(t["surface"]), "lower": t["surface"].lower()} for t in terms]
        self.exclusions = [(x, normalized(x)) for x in exclusions]

    def fuzzy_terms(self) -> set[str]:
        return {t["folded"] for t in self.terms if not t["exact_only"]}

    def match(self, title: Text, body: Text, fuzzy: dict[str, dict] | None = None) -> dict | None:
        """None without a hit; else excluded, phrase, and hits from best to worst. ``fuzzy``: what FuzzyTerms found in each field."""
        if self.exclusions:
            whole = f"{title.folded} {body.folded}".strip()
            phrase = next((raw for raw, x in self.exclusions if x and x in whole), None)
            if phrase is not None:
                return {"excluded": True, "phrase": phrase, "hits": []}
        if fuzzy is None:
            own = FuzzyTerms(self.fuzzy_terms())
            fuzzy = {"title": own.find(title.tokens), "body": own.find(body.tokens)}
        hits: dict[tuple, dict] = {}
        for field, text in (("title", title), ("body", body)):
            if text.raw:
                for hit in self._hits(field, text, fuzzy[field]):
                    hits.setdefault((hit["match_type"], field, hit["start"], hit["end"]), hit)
        if not hits:
            return None
        best = sorted(hits.values(), key=lambda h: (-RANK[h["match_type"]], -h["score"]))  # stable: ties stay in order
        return {"excluded": False, "phrase": None, "hits": best[:HITS_KEPT]}

    def _hits(self, field: str, text: Text, fuzzy: dict) -> Iterator[dict]:
        for term in self.terms:

            def hit(kind: str, score: float, start: int | None = None, end: int | None = None, matched: str | None = None, term=term) -> dict:
                return {"match_type": kind, "field": field, "start": start, "end": end, "score": score, "term": term["surface"], "matched": matched or term["surface"], "normalized": matched if kind == "controlled_fuzzy" else term["folded"], "span": surroundings(text.raw, start, end) if start is not None else ""}

            if term["surface"] in text.raw:
                for m in re.finditer(re.escape(term["surface"]), text.raw):
                    yield hit("exact", 1.0, m.start(), m.end())
            if term["lower"] in text.lower and (term["language"] == "en" or re.search("[A-Za-z]", term["surface"])):
                for m in re.finditer(re.escape(term["lower"]), text.lower):
                    seen = text.raw[m.start() : m.end()]
                    if seen != term["surface"]:
                        yield hit("case_insensitive_en", 0.99, m.start(), m.end(), seen)
            if term["folded"] and term["folded"] in text.folded:
                kind, score = ("alias", 0.96) if term["source"] == "alias" else ("arabic_normalized", 0.97)
                words = term["folded"].split()
                wide, placed = len(words), False
                # a window that folds to the term begins with a word that does so to its first words, or to nothing
                firsts = sorted(i for n in range(wide + 1) for i in text.places.get(" ".join(words[:n]), ()))
                for i in firsts[: bisect_left(firsts, len(text.words[: len(text.words) - wide + 1]))]:
                    window = text.words[i : i + wide]
                    if " ".join(w[2] for w in window if w[2]) == term["folded"]:
                        placed = True
                        yield hit(kind, score, window[0][0], window[-1][1], text.raw[window[0][0] : window[-1][1]])
                if not placed:
                    yield hit(kind, score)
            if not term["exact_only"]:
                yield from (hit("controlled_fuzzy", round(r, 4), matched=g) for r, g in fuzzy.get(term["folded"], ()))


#: Pieces of texts are told apart by 64-bit hashes; false meetings only cost a second look.
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Whole names are found by their beginnings, of the largest of these lengths that they have.
HEADS = (16, 8, 4, 3, 2, 1)
#: Characters of texts that are cut into pieces at once (few enough for a processor's cache), and spots given out together.
PIECED_CHARS, GIVEN_SPOTS = 1 << 16, 1 << 18
#: The filter that texts' pieces pass first has 16 bits for each piece of a name, and at most this many (8 MB). A piece sets those at these parts of its hash.
FILTER_BITS, FILTER_SHIFTS = 1 << 26, (0, 19, 38)
#: Rows of evidence that a task holds before it gives them out: one is up to HITS_KEPT hits with their surroundings, and a frame has 10,000 documents.
GIVEN_ROWS = 500
#: Entities whose names a task keeps ready between documents.
HELD_MATCHERS = 1 << 12
#: A piece or an entity that very many documents have is dealt to so many places.
SALTS = 16
RAW, LOWER, FOLDED, TITLE, BODY = range(5)
FIELDS = {TITLE: "title", BODY: "body"}
#: Pieces of fuzzy terms up to which every task holds them and looks texts' pieces up itself; more of them are joined.
HELD_PIECES = 1 << 18
SPOT = "doc long, key long, at int, term string, field string, ratio double, gram string, nth int"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
GRAM_COLUMNS = ("doc", "term", "field", "ratio", "gram", "nth")


def _filled(**columns) -> pa.RecordBatch:
    """Rows of ``SPOT`` with these columns, the others null."""
    kinds, n = {name: _KINDS[kind] for name, kind in map(str.split, SPOT.split(", "))}, len(columns["doc"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))


def edits(term: int, gram: int) -> int | None:
    """How many characters at most two strings of these lengths do not share, if their ratio is FUZZY_RATIO or more; None if it cannot be.

    The ratio is 2M / (term + gram) for M shared characters, so M is at least 0.46 of both lengths.
    """
    shared = math.ceil(round(FUZZY_RATIO / 2 * (term + gram), 9))
    return term + gram - 2 * shared if shared <= min(term, gram) else None


def fuzzy_pieces(term: str) -> list[tuple[str, int, int]]:
    """(piece, offset, d): for each number d of characters not shared that some length of gram allows, the term in d + 1 pieces.

    Every character not shared, in the term or in the gram, breaks one piece at most, so one of them stands whole in the gram,
    at its offset plus or minus d.
    """
    out = []
    for d in sorted({d for n in range(1, 2 * len(term)) if (d := edits(len(term), n)) is not None}):
        cut = [len(term) * i // (d + 1) for i in range(d + 2)]
        out += [(term[lo:hi], lo, d) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def piece_keys(text: str, lengths: Iterable[int], kind: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the hashes of the pieces from every place on."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    total, step, wanted = np.zeros(len(codes), np.uint64), np.uint64(1), set(lengths)
    for length in range(1, max(wanted, default=0) + 1):
        left = len(codes) - length + 1
        if left <= 0:
            return
        total = total[:left] + codes[length - 1 :] * step
        step = np.uint64(int(step) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)
        if length in wanted:
            yield length, _mixed(total + np.uint64((length * 8 + kind) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)).view(np.int64)


def _key(piece: str, kind: int) -> int:
    return int(next(piece_keys(piece, [len(piece)], kind))[1][0])


def term_index(packs: DataFrame) -> DataFrame:
    """(key, kind, length, entity_id, term, offset, edits) of packs (entity_id, terms, phrases): heads of names and phrases as written, in lower case and
    normalised, and the pieces of fuzzy terms, for titles and bodies."""
    kind = packs.schema["entity_id"].dataType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = set()
            for entity, terms, phrases in zip(frame["entity_id"], frame["terms"], frame["phrases"], strict=True):
                matcher = Matcher([r if isinstance(r, dict) else r.asDict() for r in terms], list(phrases))
                heads = [(form, t[name]) for t in matcher.terms for form, name in ((RAW, "surface"), (LOWER, "lower"), (FOLDED, "folded"))]
                for form, text in heads + [(FOLDED, x) for _, x in matcher.exclusions]:
                    if text:
                        head = text[: next(n for n in HEADS if n <= len(text))]
                        rows.add((_key(head, form), form, len(head), entity, None, 0, 0))
                for term in matcher.fuzzy_terms():
                    for piece, offset, d in fuzzy_pieces(term) if len(term) >= FUZZY_CHARS else ():
                        rows |= {(_key(piece, field), field, len(piece), entity, term, offset, d) for field in (TITLE, BODY)}
            yield pd.DataFrame(list(rows), columns=["key", "kind", "length", "entity_id", "term", "offset", "edits"])

    return packs.mapInPandas(run, f"key long, kind int, length int, entity_id {kind}, term string, offset int, edits int")


def text_pieces(docs: DataFrame, lengths: dict[int, list[int]], bits: np.ndarray, fuzzy: pa.Table | None = None) -> DataFrame:
    """(doc, key, at) of docs (doc, title, body): pieces of the lengths asked for that pass the filter; of names' heads one a document,
    of fuzzy pieces every place in the normalised field. With ``fuzzy`` (key, term, offset, edits, sorted by key), fuzzy pieces are looked up
    at once, and rows are (doc, term, field, ratio, gram, nth) instead: the best grams of each term in each field."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    known = None if fuzzy is None else docs.sparkSession.sparkContext.broadcast(fuzzy)
    mask = np.uint64(len(bits) * 8 - 1)

    def passing(key: np.ndarray, held: np.ndarray) -> np.ndarray:
        at = None
        for shift in FILTER_SHIFTS:
            bit = ((key if at is None else key[at]).view(np.uint64) >> np.uint64(shift)) & mask
            fits = np.flatnonzero(held[(bit >> np.uint64(3)).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            at = fits if at is None else at[fits]
        return at

    def cut(docs_of: np.ndarray, forms: list[tuple[str, ...]], pieces: tuple | None, near: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
        held = shared.value
        for kind, texts in enumerate(zip(*forms, strict=True)):
            # texts end to end, with a character between them that no piece has
            first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
            text, spots = "\0".join(texts), []
            for _, key in piece_keys(text, lengths.get(kind, ()), kind):
                at = passing(key, held)
                if pieces and kind > FOLDED:
                    low, high = (np.searchsorted(pieces[0], key[at], side) for side in ("left", "right"))
                    many = high - low
                    spots.append((np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum()), np.repeat(at, many)))
                    continue
                if len(at):
                    row, key = np.searchsorted(first, at, "right") - 1, key[at]
                    if kind <= FOLDED:
                        known, number = np.unique(key, return_inverse=True)
                        once = np.unique(row * len(known) + number)
                        yield docs_of[once // len(known)], known[once % len(known)], np.zeros(len(once), np.int64)
                    else:
                        yield docs_of[row], key, at - first[row]
            if spots:
                (_, which, offset, d, terms), (row, at) = pieces, (np.concatenate(c) for c in zip(*spots, strict=True))
                for doc, term, best in _grams_at(text, first, terms, which[row], at, offset[row], d[row]):
                    near += [(docs_of[doc], term, FIELDS[kind], ratio, gram, n) for n, (ratio, gram) in enumerate(best)]

    def given(found: list[tuple[np.ndarray, ...]], near: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            doc, key, at = (np.concatenate(c) for c in zip(*found, strict=True))
            yield _filled(doc=doc, key=key, at=at)
        if near:
            yield _filled(**dict(zip(GRAM_COLUMNS, zip(*near, strict=True), strict=True)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, near, pieces = [], [], None
        if known is not None and known.value.num_rows:
            term = known.value["term"].combine_chunks().dictionary_encode()
            number = (known.value[c].to_numpy().astype(np.int64) for c in ("key", "offset", "edits"))
            key, offset, d = number
            pieces = key, term.indices.to_numpy().astype(np.int64), offset, d, _features(term.dictionary.to_pylist())
        for batch in batches:
            docs_of, forms, chars, low = batch.column(0).to_numpy(), [], 0, 0
            for i, (title, body) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                title, body = Text(title.as_py()), Text(body.as_py())
                whole = f"{title.folded} {body.folded}".strip()
                forms.append((f"{title.raw}\0{body.raw}", f"{title.lower}\0{body.lower}", whole, title.folded, body.folded))
                chars += len(forms[-1][0])
                if chars >= PIECED_CHARS or i + 1 == batch.num_rows:
                    found += cut(docs_of[low : i + 1], forms, pieces, near)
                    forms, chars, low = [], 0, i + 1
                    if sum(len(f[0]) for f in found) + len(near) >= GIVEN_SPOTS:
                        yield from given(found, near)
                        found, near = [], []
        yield from given(found, near)

    return docs.mapInArrow(run, SPOT)


def packed(at, offset, edits, kind):
    """A spot in one number, of columns or arrays: the place in the text, the piece's offset and d, and the field."""
    return ((at * 65_536 + offset) * 256 + edits) * 8 + kind


def near_grams(tokens: list[str], spots: dict[str, np.ndarray]) -> dict[str, list[tuple[float, str]]]:
    """As ``FuzzyTerms.find``, for grams near spots only: of each term, where in the text its pieces stand (``packed``)."""
    if not spots or not tokens:
        return {}
    which, places = np.repeat(np.arange(len(spots)), [len(p) for p in spots.values()]), np.concatenate(list(spots.values()))
    return {term: best for _, term, best in _grams_at(" ".join(tokens), np.zeros(1, np.int64), _features(list(spots)), which, *_unpacked(places))}


def _unpacked(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the text, offset and d of ``packed`` spots."""
    return places >> 27, places >> 11 & 65_535, places >> 3 & 255


@lru_cache(maxsize=1 << 14)
def _feature(term: str) -> tuple[int, int, int]:
    return len(term), len(term.split()), int(FuzzyTerms._kinds(FuzzyTerms._counts(term, np.zeros(len(term), np.int64), 1))[0])


def _features(names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and of each its characters, words and kinds of characters (see ``FuzzyTerms``)."""
    chars, words, kinds = zip(*map(_feature, names), strict=True)
    return names, np.array(chars), np.array(words), np.array(kinds, np.uint64)


def _grams_at(text: str, first: np.ndarray, terms: tuple, which: np.ndarray, at: np.ndarray, offset: np.ndarray, d: np.ndarray) -> Iterator[tuple[int, str, list[tuple[float, str]]]]:
    """(row, term, its best grams) of normalised texts end to end, a character between them, from spots: number of the term, place, and the piece's offset and d."""
    names, chars, words, term_kinds = terms
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    turns = np.flatnonzero(np.diff(np.concatenate(([False], (codes != 32) & (codes != 0), [False]))))
    starts, stops = turns[::2], turns[1::2]
    if not len(starts) or not len(at):
        return
    text_of = np.searchsorted(first, starts, "right") - 1
    until = np.append(np.searchsorted(starts, first[1:]), len(starts))[text_of]  # the text's last token, and one
    kinds = np.bitwise_or.reduceat(np.append(np.uint64(1) << (codes & np.uint32(63)).astype(np.uint64), np.uint64(0)), turns)[::2]
    low, high = np.searchsorted(starts, at - offset - d), np.searchsorted(starts, at - offset + d, "right")
    many = high - low
    row = np.repeat(np.arange(len(many)), many)
    begin, of, allowed, found = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many), which[row], d[row], []
    for more in (0, 1):
        stop = np.minimum(begin + words[of] + more, until[begin])
        long, size = stops[stop - 1] - starts[begin], chars[of]
        shared = np.ceil(np.round(FUZZY_RATIO / 2 * (long + size), 9))
        fits = np.flatnonzero((long + size - 2 * shared == allowed) & (shared <= np.minimum(long, size)))  # as ``edits``
        i, k, stop, both = begin[fits], of[fits], stop[fits], (long + size)[fits]
        held = kinds[i]
        for n in range(1, int((stop - i).max(initial=0))):
            held = np.where(i + n < stop, held | kinds[np.minimum(i + n, len(starts) - 1)] | np.uint64(1 << 32), held)  # the blank between words
        fits = np.bitwise_count(held ^ term_kinds[k]) <= (1 - FUZZY_RATIO) * both + 1e-9
        # one number for term, first token and width, as equal grams are found by several pieces
        found.append((k[fits] * len(starts) + i[fits]) * 4096 + words[k[fits]] + more)
    hits: dict[tuple[int, str], list] = {}
    judge, last = difflib.SequenceMatcher(), -1
    for x in np.unique(np.concatenate(found)).tolist():
        k, i, width = x // 4096 // len(starts), x // 4096 % len(starts), x % 4096
        gram = text[starts[i] : stops[min(i + width, int(until[i])) - 1]]
        if gram != names[k]:
            if k != last:
                judge.set_seq2(names[k])
                last = k
            judge.set_seq1(gram)
            if judge.quick_ratio() >= FUZZY_RATIO and (r := judge.ratio()) >= FUZZY_RATIO:
                hits.setdefault((int(text_of[i]), names[k]), []).append((-r, i, width, gram))
    for (doc, term), best in hits.items():
        yield doc, term, [(-r, gram) for r, _, _, gram in sorted(best)[:FUZZY_BEST]]


HIT = "struct<match_type:string,field:string,start:int,end:int,score:double,term:string,matched:string,normalized:string,span:string>"


def match_documents(docs: DataFrame, terms: DataFrame, exclusions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, entity_id, excluded, phrase, match_type, score, evidence) for documents with title and body.

    ``terms`` as entity_terms gives them, ``exclusions`` (entity_id, phrase). A document meets an entity only if it has the
    first characters (up to 16) of one of its names or phrases, or one of the d + 1 pieces into which a fuzzy term is cut (see
    ``fuzzy_pieces``: for a name of 18 characters, three of six for most grams). So the pairs looked at are at most the occurrences of
    pieces times the names that share a piece, and of them those grams are compared in full that stand where the piece
    says and share enough characters. Common pieces and entities are dealt to SALTS places.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    entity = terms.schema["entity_id"].dataType.simpleString()
    listed = F.sort_array(F.collect_list(F.struct("pos", "surface", "language", "exact_only", "source")))
    packs = terms.groupBy("entity_id").agg(listed.alias("terms")).join(exclusions.groupBy("entity_id").agg(F.collect_list("phrase").alias("phrases")), "entity_id", "left")
    packs = packs.withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))
    index = checkpointed(term_index(packs), "terms")
    lengths: dict[int, list[int]] = {}
    for r in index.select("kind", "length").distinct().collect():  # no more than the longest name has characters
        lengths.setdefault(r.kind, []).append(r.length)
    size = min(FILTER_BITS, max(1 << 10, 1 << (index.count() * 16).bit_length()))
    spread = F.explode(F.array(*[F.shiftrightunsigned("key", n).bitwiseAND(F.lit(size - 1)).cast("int") for n in FILTER_SHIFTS]))
    places = index.select(spread.alias("bit")).distinct().toArrow().column("bit").to_numpy()
    bits = np.zeros(size // 8, np.uint8)
    np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))

    # documents are told apart by a hash of all they are; two that share it only look at each other's candidates as well
    keyed = docs.select(F.col(id_col), "title", "body").withColumn("doc", F.xxhash64(id_col, "title", "body"))
    # repeated rows are cut once, and stored rows are dealt to all tasks, however few groups of rows a file has
    of_terms = index.where("term is not null").select("key", "term", "offset", "edits").distinct()
    few = of_terms.count() <= HELD_PIECES
    spots = text_pieces(keyed.select("doc", "title", "body").distinct(), lengths, bits, of_terms.orderBy("key").toArrow() if few else None)
    spots = checkpointed(spots, "spots") if few else spots
    salts = F.explode(F.lit(list(range(SALTS))))
    dealt = spots.where("key is not null").select("doc", "key", "at").withColumn("salt", F.pmod(F.col("doc"), F.lit(SALTS)).cast("int"))
    # a fuzzy term's pieces meet texts once, however many entities have it
    pieces = index.select("key", "kind", F.when(F.col("term").isNull(), F.col("entity_id")).alias("entity_id"), "term", "offset", "edits").distinct()
    met = dealt.join(pieces.withColumn("salt", salts), ["key", "salt"])
    met = met.select("doc", "entity_id", "kind", "term", packed(F.col("at").cast("long"), F.col("offset"), F.col("edits"), F.col("kind")).alias("place"))
    met = met if few else checkpointed(met, "met")

    # fuzzy terms first: the grams near the pieces, and which of them are alike enough
    if few:
        grams = spots.where("term is not null").select(*GRAM_COLUMNS)
    else:
        asked = met.where("term is not null").groupBy("doc").agg(F.collect_list(F.struct("term", "place")).alias("asked"))
        grams = checkpointed(keyed.join(asked, "doc").select("doc", "title", "body", "asked").mapInArrow(_alike, "doc long, term string, field string, ratio double, gram string, nth int").distinct(), "grams")

    alike = grams.select("doc", "term").distinct().join(index.where("term is not null").select("term", "entity_id").distinct(), "term").select("doc", "entity_id")
    pairs = met.where("term is null").select("doc", "entity_id").union(alike).distinct().withColumn("salt", F.pmod(F.col("doc"), F.lit(SALTS)).cast("int"))
    known = pairs.join(packs.withColumn("salt", salts), ["entity_id", "salt"])
    by_doc = known.groupBy("doc").agg(F.collect_list(F.struct("entity_id", "terms", "phrases")).alias("found"))
    fuzzy = grams.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("field", "term", "nth", "ratio", "gram"))).alias("fuzzy"))
    whole = keyed.join(by_doc, "doc").join(fuzzy, "doc", "left").select(F.col(id_col).alias("id"), "title", "body", "found", "fuzzy")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[object, Matcher] = {}

        def given(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(made)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)

        out = []
        for batch in batches:
            ids, titles, bodies, found, fuzzy = (batch.column(i) for i in range(5))
            packs, packs_from = found.values, found.offsets.to_pylist()
            entities, terms, phrases = packs.field("entity_id"), packs.field("terms"), packs.field("phrases")
            names = entities.to_pylist()
            for i in range(batch.num_rows):
                title, body = Text(titles[i].as_py()), Text(bodies[i].as_py())
                alike: dict[str, dict] = {"title": {}, "body": {}}
                for x in fuzzy[i].as_py() or ():
                    alike[x["field"]].setdefault(x["term"], []).append((x["ratio"], x["gram"]))
                for j in range(packs_from[i], packs_from[i + 1]):
                    matcher = matchers.get(names[j])
                    if matcher is None:
                        if len(matchers) >= HELD_MATCHERS:
                            matchers.clear()
                        matcher = matchers[names[j]] = Matcher(terms[j].as_py(), phrases[j].as_py())
                    got = matcher.match(title, body, alike)
                    if got is not None:
                        best = got["hits"][0] if got["hits"] else {}
                        out.append((ids[i].as_py(), names[j], got["excluded"], got["phrase"], best.get("match_type"), best.get("score"), got["hits"]))
                        if len(out) >= given_rows:
                            yield given(out)
                            out = []
        if out:
            yield given(out)

    given_rows = GIVEN_ROWS
    shape = f"{id_col} {kind}, entity_id {entity}, excluded boolean, phrase string, match_type string, score double, evidence array<{HIT}>"
    made = to_arrow_schema(StructType.fromDDL(shape))
    return whole.mapInArrow(run, shape)


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, term, field, ratio, gram, nth): the best grams of each fuzzy term in each field of (doc, title, body, asked)."""
    for batch in batches:
        out: list[tuple] = []
        docs, titles, bodies, asked = (batch.column(i) for i in range(4))
        rows, terms, places = asked.offsets.to_pylist(), asked.values.field("term"), asked.values.field("place").to_numpy()
        for i in range(batch.num_rows):
            lo, hi = rows[i], rows[i + 1]
            held, mine = terms.slice(lo, hi - lo).dictionary_encode(), places[lo:hi]
            names, which = held.dictionary.to_pylist(), held.indices.to_numpy()
            for kind, name, text in ((TITLE, "title", titles[i]), (BODY, "body", bodies[i])):
                of_field = mine & 7 == kind
                folded = normalized(text.as_py()) if of_field.any() else ""
                for _, term, best in _grams_at(folded, np.zeros(1, np.int64), _features(names), which[of_field], *_unpacked(mine[of_field])) if folded else ():
                    out += [(docs[i].as_py(), term, name, ratio, gram, n) for n, (ratio, gram) in enumerate(best)]
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc", "term", "field", "ratio", "gram", "nth"])


def vetoed_documents(docs: DataFrame, exclusions: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents of which the normalised text has an exclusion phrase; a few phrases, broadcast by Spark's size check."""
    folded = docs.withColumn("_folded", normalize_text(text_col))
    return folded.join(exclusions, F.contains("_folded", normalize_text("phrase"))).drop("_folded")
