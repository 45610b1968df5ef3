"""Text functions on columns. Built-ins only, but for NFKC and stable JSON, which are Arrow-batched."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arabic diacritics, alef forms and digits that normalisation folds.
DIACRITICS = r"[ؐ-ًؚ-ٰٟۖ-ۭ]"
ALEFS = "إأآٱ"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
TATWEEL = "ـ"
#: Phrases of page chrome that mark a body as junk.
JUNK_MARKERS = ("عدد اليوم", "ماستر كلاس", "أرشيف القبس", "كتاب القبس", "معرض الصور")
MIN_BODY_CHARS = 80


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold_text(text: Column | str) -> Column:
    """``normalize_text`` for text that is in NFKC already; null becomes empty."""
    t = F.lower(F.trim(F.coalesce(col(text), F.lit(""))))
    t = F.regexp_replace(F.replace(t, F.lit(TATWEEL), F.lit("")), DIACRITICS, "")
    t = F.translate(t, ALEFS + ARABIC_DIGITS, "ا" * len(ALEFS) + "0123456789")
    # letters and numbers of any script stay, marks and signs become blanks
    return collapse(F.regexp_replace(t, r"[^\p{L}\p{N}_\p{IsWhite_Space}]", " "))


def normalize_text(text: Column | str) -> Column:
    """NFKC, lower case, Arabic folding, signs to blanks, blanks collapsed."""
    return fold_text(nfkc(F.coalesce(col(text), F.lit(""))))


def title_fingerprint(title: Column | str) -> Column:
    return F.sha2(normalize_text(title), 256)


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))), 256)


def clip(text: Column | str, n: int) -> Column:
    """Trimmed, and cut to n characters of which the last is an ellipsis."""
    t = strip(col(text))
    return F.when(F.length(t) > n, F.concat(strip(F.substring(t, 1, n - 1)), F.lit("…"))).otherwise(t)


def snippet(text: Column | str, n: int = 220) -> Column:
    return clip(collapse(F.coalesce(col(text), F.lit(""))), n)


def match_window(text: Column, start: Column, end: Column, around: int = 80) -> Column:
    """The match and what stands around it, with an ellipsis on each side that is cut."""
    lo, hi = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(text))
    middle = strip(F.substring(text, lo + 1, hi - lo))
    return F.concat(F.when(lo > 0, "…").otherwise(""), middle, F.when(hi < F.length(text), "…").otherwise(""))


def is_junk_body(body: Column | str) -> Column:
    t = strip(F.coalesce(col(body), F.lit("")))
    hits = sum((F.contains(t, F.lit(m)).cast("int") for m in JUNK_MARKERS), F.lit(0))
    return (F.length(t) == 0) | (hits >= 3) | ((F.length(t) < MIN_BODY_CHARS) & (hits >= 1))


def body_ok(body: Column | str) -> Column:
    return (F.length(strip(F.coalesce(col(body), F.lit("")))) >= MIN_BODY_CHARS) & ~is_junk_body(body)


def should_replace(new: Column | str, old: Column | str) -> Column:
    """Whether a new body takes the place of an old one."""
    return body_ok(new) | ~body_ok(old)


def query_text(*parts: Column | str) -> Column:
    """Parts joined by a bar, blank ones left out; an array gives its elements."""
    return F.concat_ws(" | ", *[F.when(F.trim(col(p)) != "", F.trim(col(p))) for p in parts])


def article_text(title: Column | str, body: Column | str) -> Column:
    return F.concat_ws("\n", *[F.when(F.trim(col(p)) != "", col(p)) for p in (title, body)])


def xml_escape(text: Column | str) -> Column:
    t = col(text)
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(raw), F.lit(name))
    return t


def strip_fences(text: Column | str) -> Column:
    """JSON out of a Markdown code fence."""
    return F.trim(F.regexp_replace(F.trim(col(text)), r"^```(json)?\s*|\s*```$", ""))


#: Key parts whose values are secret.
SECRET_KEYS = ("password", "secret", "token", "api_key", "dsn", "authorization")


def redact(values: Column | str) -> Column:
    """A map with *** for values whose key names a secret."""
    return F.transform_values(col(values), lambda k, v: F.when(F.regexp_like(F.lower(k), F.lit("|".join(SECRET_KEYS))), F.lit("***")).otherwise(v))


#: Header names whose values are secret.
SECRET_HEADERS = ("authorization", "cookie", "set-cookie", "x-api-key")


def redact_headers(headers: Column | str) -> Column:
    return F.transform_values(col(headers), lambda k, v: F.when(F.lower(k).isin(*SECRET_HEADERS), F.lit("***")).otherwise(v))


@F.pandas_udf(T.StringType())
def stable_json(values: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no blanks and ASCII escapes."""
    return values.map(lambda v: json.dumps(json.loads(v), sort_keys=True, separators=(",", ":")), na_action="ignore")


def checked_enrichment(raw: Column | str) -> Column:
    """Model output as a struct: known labels only, importance in 0..1 (0.5 if none), five topics of 80 characters, a summary of 1200."""
    parsed = F.from_json(strip_fences(raw), "summary string, sentiment string, importance double, topics array<string>")
    sentiment = F.lower(F.trim(parsed["sentiment"]))
    topics = F.filter(F.transform(F.coalesce(parsed["topics"], F.array().cast("array<string>")), lambda t: F.substring(F.trim(t), 1, 80)), lambda t: t != "")
    return F.struct(
        F.substring(F.trim(F.coalesce(parsed["summary"], F.lit(""))), 1, 1200).alias("summary"),
        F.when(sentiment.isin("positive", "negative", "neutral", "mixed"), sentiment).otherwise("neutral").alias("sentiment"),
        F.least(F.greatest(F.coalesce(parsed["importance"], F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("importance"),
        F.slice(topics, 1, 5).alias("topics"),
    )
