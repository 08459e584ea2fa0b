"""Fill-in-the-middle against one text at a time."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from convmem.llm import fill_middle
from tests.llm.corpus import frame, texts


def expected(doc_id, text, rate=90, spm_rate=20) -> tuple:
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def rows():
    rnd = random.Random(3)
    odd = ["a", "bc", "é", "漢", "😀", " ", "\n", "\0", "<", "P", "S>", "M", ">", "\x80", "￿", "\r\n", "9"]
    out = texts() + [(600 + k, "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 60)))) for k in range(300)]
    return out + [(950, "x<P>y"), (951, "<S>"), (952, "a<M>"), (953, "<" * 50), (954, "<S<M<P" * 9), (955, "long é text, " * 400_000)]


def test_outputs_and_round_trip(spark):
    data = rows()
    moved = fill_middle.transformed(frame(spark, data))
    assert Counter(map(tuple, moved.collect())) == Counter(expected(i, t) for i, t in data)
    assert {r.form for r in moved.collect()} == {"plain", "psm", "spm"}
    back = fill_middle.restored(moved.drop("doc_id", "n").withColumnRenamed("form", "f").withColumnRenamed("f", "form"))
    assert Counter(r.text for r in back.collect()) == Counter(t or "" for _, t in data)


def test_rates(spark):
    docs = frame(spark)
    assert {r.form for r in fill_middle.transformed(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_middle.transformed(docs, rate=100, spm_rate=100).where("n > 0").collect()} == {"spm"}


def test_digests_and_clashes(spark):
    data = rows()
    got = fill_middle.digests(frame(spark, data))
    want = Counter()
    for i, t in data:
        e = expected(i, t)
        want[(*e[:5], hashlib.sha256(e[5].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got.collect())) == want
    assert fill_middle.digests(frame(spark, [])).count() == 0


def test_other_columns(spark):
    from pyspark.sql import functions as F

    odd = frame(spark).withColumns({c: F.lit(1) for c in ("h1", "h2", "form", "output", "n", "texts")})
    assert Counter(map(tuple, fill_middle.transformed(odd).collect())) == Counter(map(tuple, fill_middle.transformed(frame(spark)).collect()))
