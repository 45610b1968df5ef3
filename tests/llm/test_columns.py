"""Every operator takes tables with columns of any name."""

import pytest
from pyspark.sql import functions as F

from tidewire.llm.decontaminate import find_contamination
from tidewire.llm.jaccard_join import jaccard_groups
from tidewire.llm.kneser_ney import classify
from tidewire.llm.mixing import mix
from tidewire.llm.url_filter import judge_urls
from tidewire.llm.webp import decode_media, encode_media

NAMES = "_id _key _text _text_ _media_ _lang _of _most _most_peak _most_ratio _fit _fit_peak _good _toxic _keep0 _keep1 _spans _items _url _page_url _h _p h p token _size _times _copy _nth _want node paths run leaf w window k".split()


@pytest.fixture
def odd(docs_of):
    texts = ["one two three four five six", "one two three four five six", None, "", "seven eight nine ten eleven"]
    return docs_of(texts).withColumns({c: F.lit(f"mine{i}") for i, c in enumerate(NAMES)})


def same(df, names=NAMES):
    rows = df.collect()
    assert len(rows) == 5 and all(r[c] == f"mine{NAMES.index(c)}" for r in rows for c in names)


def test_names(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    same(find_contamination(odd, bench))
    same(find_contamination(odd, bench, max_broadcast_bytes=100))
    labels = spark.createDataFrame([(0, 1, 0), (4, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    same(classify(odd, labels))
    same(judge_urls(odd.withColumn("url", F.lit("http://a.net/x")), "url"))
    media = encode_media(odd, odd.columns)
    same(media)
    same(decode_media(media, media.columns))
    assert mix(odd).count() == jaccard_groups(odd).count() == 5
