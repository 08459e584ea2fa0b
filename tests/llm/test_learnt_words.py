"""The learnt lexicons rest on all labelled rows outside the held-out fold and have no bound of size."""

from __future__ import annotations

import random
import zlib

from convmem.llm import toxicity
from tests.llm.corpus import frame


def _word(i: int) -> str:
    return "".join(chr(ord("a") + i // 26**k % 26) for k in range(3)) + "qx"


def _held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_all_words_over_chance_are_learnt(spark):
    rnd = random.Random(3)
    # Each of 200 words is in six toxic rows and in no other.
    texts = [(f"{_word(i % 200)} common words here", 1) for i in range(1200)] + [(f"plain{rnd.randint(0, 9)} common words here", 0) for _ in range(12_000)]
    rows = spark.createDataFrame(texts, "text string, toxic int")
    assert set(toxicity.learnt(rows).sure) >= {_word(i) for i in range(200)}


def test_words_outside_the_sample_are_learnt(spark):
    ids = [i for i in range(3000) if not _held_out(i)]
    toxic = set(ids[::10])
    docs = [(i, "zzarqh is common here" if i in toxic else "this is common here") for i in ids]
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in ids], "doc_id bigint, quality int, toxic int")
    known, some = toxicity._known(labels, 20)
    assert {r.doc_id for r in known.collect()} == set(ids) and 0 < some.count() < 60
    scorer = toxicity.learn(frame(spark, docs), labels, 20)
    assert "zzarq" in scorer.lexicon.sure
    # As many documents as all labelled rows have, not as the sample has.
    rare = [(i, "yyarqh is common here" if i in sorted(toxic)[:8] else t) for i, t in docs]
    assert "yyarq" in toxicity.learn(frame(spark, rare), labels, 20).lexicon.sure
