import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, text, urls, vectors


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "raw,want",
    [
        ("AI  Octopus!", "ai octopus"),
        ("الــعـربية", "العربية"),
        ("إأآٱ", "اااا"),
        ("١٢٣", "123"),
        ("مُحَمَّد", "محمد"),
        ("ＦｕｌｌＷｉｄｔｈ ﬁ", "fullwidth fi"),
        ("a_b ½ x²", "a_b 1 2 x2"),
        ("é ṇ̇!", "é ṇ"),
        (None, ""),
    ],
)
def test_normalize_text(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "t string").select(text.normalize_text("t").alias("r")).first().r
    assert got.replace("⁄", " ").strip() == want or got == want


def test_clip_and_windows(spark):
    assert one(spark, text.clip("t", 5), t="  abcdefgh ") == "abcd…"
    assert one(spark, text.clip("t", 5), t="abc d") == "abc d"
    assert one(spark, text.clip("t", 5), t="abc defg") == "abc…"
    assert one(spark, text.snippet("t", 9), t="a \n b\t c d e f") == "a b c d…"
    assert one(spark, text.match_window(F.col("t"), F.lit(4), F.lit(6), 2), t="abcdefghij") == "…cdefgh…"
    assert one(spark, text.match_window(F.col("t"), F.lit(0), F.lit(2), 20), t="abcdefghij") == "abcdefghij"


def test_bodies(spark):
    junk, long = "عدد اليوم", "x" * 90
    assert one(spark, text.is_junk_body("t"), t=junk)
    assert not one(spark, text.is_junk_body("t"), t=long + junk)
    assert one(spark, text.is_junk_body("t"), t=long + "عدد اليوم ماستر كلاس معرض الصور")
    assert not one(spark, text.body_ok("t"), t="x" * 79) and one(spark, text.body_ok("t"), t="x" * 80)
    assert one(spark, text.should_replace("a", "b"), a="short", b="short too") and not one(spark, text.should_replace("a", "b"), a="short", b=long)


def test_small_texts(spark):
    assert one(spark, text.query_text("a", "b", "c"), a=" x ", b="", c="y") == "x | y"
    assert one(spark, text.xml_escape("t"), t='<a href="x">&</a>') == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"
    assert one(spark, text.stable_json("t"), t='{"b": 1, "a": "é"}') == '{"a":"\\u00e9","b":1}'
    got = one(spark, text.redact(F.create_map(F.lit("API_KEY_X"), F.lit("1"), F.lit("name"), F.lit("2"))))
    assert got == {"API_KEY_X": "***", "name": "2"}
    r = one(spark, text.checked_enrichment("t"), t='```json\n{"summary": " s ", "sentiment": "Odd", "importance": 7, "topics": ["a", "", "b", "c", "d", "e", "f"]}\n```')
    assert (r.summary, r.sentiment, r.importance, r.topics) == ("s", "neutral", 1.0, ["a", "b", "c", "d", "e"])


@pytest.mark.parametrize(
    "raw,want",
    [
        ("HTTPS://Example.TEST/path/?utm=1", "https://example.test/path"),
        ("http://a.b", "http://a.b/"),
        ("http://a.b/x?language=AR&amp;id=7&z=1#top", "http://a.b/x?id=7&language=ar"),
        ("http://A.b/X//?ID=Q", "http://a.b/X?id=Q"),
    ],
)
def test_canonical_url(spark, raw, want):
    assert one(spark, urls.canonical_url("u"), u=raw) == want


def test_url_parts(spark):
    assert one(spark, urls.same_site(F.lit("https://www.a.com"), "u"), u="http://A.com/x")
    assert not one(spark, urls.same_site(F.lit("https://www.a.com"), "u"), u="ftp://a.com/x")
    assert one(spark, urls.same_site(F.lit("https://a.com"), "u", ("b.com",)), u="http://www.b.com/x")
    assert one(spark, urls.archive_year("u"), u="http://a/?YearQuarter=20243") == 2024
    assert one(spark, urls.archive_year("u"), u="http://a/?x=1") is None
    assert one(spark, urls.site_article_id("u"), u="http://a/article/12/x") == "12"
    for href, want in (("b", "http://h/d/b"), ("/b", "http://h/b"), ("//k/b", "http://k/b"), ("https://z/", "https://z/")):
        assert one(spark, urls.resolve(F.lit("http://h/d/e?q"), "u"), u=href) == want


def test_dates(spark):
    at = lambda *x: dt.datetime(*x)
    assert one(spark, dates.iso("t"), t="2026-07-01T10:00:00+02:00") == at(2026, 7, 1, 8)
    assert one(spark, dates.iso("t"), t="nonsense") is None
    assert one(spark, dates.local_naive("t"), t="2026-07-01 21:35:00") == at(2026, 7, 1, 18, 35)
    assert one(spark, dates.local_naive("t"), t="2026-07-01T21:35:00Z") == at(2026, 7, 1, 21, 35)
    assert one(spark, dates.day_first("t"), t="on 22/07/2026 09:28!") == at(2026, 7, 22, 9, 28)
    assert one(spark, dates.day_first("t"), t="32-07-2026") is None
    assert one(spark, dates.day_first("t"), t="1/2/1447") is None
    assert one(spark, dates.year_first("t"), t="2026.7.2") == at(2026, 7, 2)
    assert one(spark, dates.clock_hour("t"), t="5:10 م") == 17 and one(spark, dates.clock_hour("t"), t="12:10 ص") == 0
    assert one(spark, dates.feed_date("t"), t="Tue, 02 Jan 2024 03:04:05 GMT") == at(2024, 1, 2, 3, 4, 5)
    assert one(spark, dates.feed_date("t"), t="2024-01-02T03:04:05Z") == at(2024, 1, 2, 3, 4, 5)
    assert one(spark, dates.lastmod("t"), t="2024-01-02") == at(2024, 1, 2)
    assert one(spark, dates.lastmod("t"), t="2024/01/02") is None and one(spark, dates.lastmod("t"), t="2024") is None
    assert one(spark, dates.edition_date("t"), t="05-06-2024") == dt.date(2024, 6, 5)
    assert one(spark, dates.edition_date("t"), t="5-6-2024") is None


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) is None
    assert one(spark, vectors.fingerprint_similarity("a", "b"), a="abcd", b="abxx") == 0.5
    assert one(spark, vectors.fingerprint_similarity("a", "b"), a="abcd", b="ab") == 0
    rows = vectors.hash_embed(spark.createDataFrame([(1, "port authority news"), (2, "port authority"), (3, "unrelated words"), (4, "")], "i long, t string"), "i", "t", 256).collect()
    e = {r.i: r.embedding for r in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(e[a], e[b], strict=True))
    assert dot(1, 1) == pytest.approx(1) and dot(4, 4) == pytest.approx(1)
    assert dot(1, 2) > dot(1, 3)
    prints = spark.createDataFrame([(b"x" * 500,), (b"x" * 500,), (b"x" * 501,), (None,)], "b binary").select(vectors.image_fingerprint("b").alias("f")).collect()
    assert prints[0] == prints[1] and len({r.f for r in prints}) == 3
