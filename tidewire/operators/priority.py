"""Which coverage deserves attention: ranking by focus, adaptive threshold, one row a story, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import collapse, col
from tidewire.operators.ranking import percentile_pick

#: Weights of tones.
TONE = {"negative": 0.2, "mixed": 0.08}


def focus_tokens(phrase: str) -> list[str]:
    """The whole phrase, and its pieces of two characters or more."""
    whole = phrase.strip().lower()
    pieces = [p for p in whole.replace(",", " ").replace("،", " ").split() if len(p) >= 2]
    return list(dict.fromkeys([whole, *pieces])) if whole else []


def tone_weight(tone: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in TONE.items():
        out = F.when(tone == name, weight).otherwise(out)
    return out


def priority(text: Column, importance: Column, tone: Column, tokens: list[str]) -> tuple[Column, Column]:
    """(relevance, score). Without focus, relevance is 1 and importance leads."""
    imp = F.coalesce(importance, F.lit(0.35))
    if not tokens:
        return F.lit(1.0), 0.8 * imp + tone_weight(tone)
    low = F.lower(F.coalesce(text, F.lit("")))
    relevance = sum((F.contains(low, F.lit(t)).cast("int") for t in tokens), F.lit(0)) / len(tokens)
    return relevance, 0.68 * relevance + 0.24 * imp + 0.08 * tone_weight(tone)


def ranked(articles: DataFrame, phrase: str, id_col: str = "doc_id") -> DataFrame:
    """Articles (title, text, importance, sentiment, cluster_id) above the adaptive threshold, one a story.

    The threshold is the score at index max(0, floor(0.72 n) - 1) of all in ascending order, and at
    least 0.3, with focus 0.68.
    """
    tokens = focus_tokens(phrase)
    relevance, score = priority(F.concat_ws(" ", "title", "text"), F.col("importance"), F.col("sentiment"), tokens)
    scored = articles.withColumns({"relevance": relevance, "score": F.round(score, 9)}).where("relevance > 0")
    picked = percentile_pick(scored.select(F.lit(1).alias("_all"), "score"), "_all", "score")
    bar = picked.select(F.greatest("threshold", F.lit(0.68 if tokens else 0.3)).alias("bar"))
    story = F.coalesce(F.col("cluster_id").cast("string"), F.substring(collapse(F.lower("title")), 1, 80))
    first = Window.partitionBy(story).orderBy(F.desc("score"), id_col)
    chosen = scored.join(F.broadcast(bar), F.col("score") >= F.col("bar"))  # one row
    return chosen.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "bar")


def search(articles: DataFrame, words: str = "", publisher: str | None = None, language: str | None = None) -> DataFrame:
    """Title, or summary (else snippet), contains the words; publisher and language are equal, where given."""
    out = articles
    if words.strip():
        w = F.lit(words.strip().lower())
        out = out.where(F.contains(F.lower("title"), w) | F.contains(F.lower(F.coalesce(F.nullif("summary", F.lit("")), "snippet")), w))
    for name, value in (("publisher", publisher), ("language", language)):
        out = out.where(F.col(name) == value) if value else out
    return out


def saved(articles: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return articles.join(ids.select(id_col).distinct(), id_col, "left_semi")


def priority_label(importance: Column | str) -> Column:
    return F.when(col(importance) >= 0.7, "high").when(col(importance) >= 0.45, "medium").otherwise("low")
