"""Stages keep columns whatever they are called."""

from __future__ import annotations

from pyspark.sql import functions as F

from convmem.llm import line_dedup, near_copies, pii, simhash, toxicity
from tests.llm.corpus import frame

ODD = ["_stay", "stay", "id", "row", "_m_lower", "_m_words", "_raw", "_score", "_insults", "_features", "_pii_spans", "text_", "spans", "key"]


def odd(spark):
    return frame(spark).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ODD})


def kept_whole(before, after):
    assert after.columns == before.columns
    rows = after.where("doc_id is not null").collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in ODD)


def test_every_stage(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").withColumn("_raw", F.lit(1))
    kept_whole(docs, toxicity.accepted(docs, labels, threshold=1.1))
    kept_whole(docs, line_dedup.cleaned(docs))
    kept_whole(docs, simhash.one_of_each(docs))
    kept_whole(docs, near_copies.one_of_each(docs))
    kept_whole(docs, pii.redacted(docs))
