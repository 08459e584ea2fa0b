"""The pipeline's stages on a small corpus: decisions take effect, clean documents stay."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from tests.llm.corpus import frame, texts


def test_stages(spark, tmp_path):
    rnd = np.random.default_rng(11)
    prose = lambda n: " ".join(f"w{rnd.integers(0, 400)}" for _ in range(n))
    rows = [(i, t) for i, t in texts() if i is not None]
    rows += [(1000 + i, prose(60) + (" you idiot scum " + prose(10) if i % 4 == 0 else "")) for i in range(200)]
    rows += [(2000, prose(50) + " mail joe@mail.org now"), (2001, prose(80)), (2002, None)]
    labels = [(1000 + i, 1, int(i % 4 == 0)) for i in range(200)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            seen.append({r.doc_id: r.text for r in docs.collect()})
    toxic, lines, simhash, pii = seen
    assert not any(1000 + i in toxic for i in range(0, 200, 4)) and all(1000 + i in toxic for i in range(1, 200, 4))
    assert lines.keys() == toxic.keys() and lines[60] == "the same line of many words again\n"
    assert 2001 in simhash and simhash.keys() < lines.keys()
    assert pii[2000].endswith("mail [EMAIL] now") and pii[2001] == toxic[2001]
    assert {r.doc_id for r in docs.select("doc_id").collect()} == pii.keys()
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_run_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "pii", "best_fit_packing"]
