"""The clean-up against its SQL on texts that the two engines could take differently."""

from __future__ import annotations

import os

import duckdb

from convmem.plans import catalog

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_cleanup_on_odd_texts(spark, tmp_path):
    """Blank texts are entries as any other, and a dotted capital I is an i."""
    texts = ["", " ", "   ", "\n", None, "THİS is", "thİs", "THİSX", "undİ", "x und", "thiṡ", "UND\n", "an end"] * 4
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    os.symlink(EVENTS, tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(f"create view events as from '{EVENTS}'")
    want = sorted(con.sql(catalog.oracle_sql()["d3_cleanup"]).fetchall())
    assert sorted(tuple(r) for r in catalog.queries()["d3_cleanup"](spark, str(tmp_path)).collect()) == want
    assert {a for _, a in want} == {"deleted", "done", "kept"}
