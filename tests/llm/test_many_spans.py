"""Personal data in texts with very many spans, and spans that the classifier adds."""

from __future__ import annotations

import time

from convmem.llm import pii
from tests.llm.corpus import frame


def test_many_spans_in_one_text(spark):
    n = 50_000
    text = "é".join(f"u{i}@h.com, 12 " for i in range(n))
    docs = frame(spark, [(1, text), (2, "none"), (3, "a@b.co 😀 tel (212) 555-0188 x")])
    began = time.time()
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert got[1].n_email == n and got[1].spans.startswith("email:0:8,email:14:22,")
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[1] == "é".join("[EMAIL], 12 " for _ in range(n)) and clean[2] == "none" and clean[3].startswith("[EMAIL] 😀 tel ")
    assert time.time() - began < 240


def test_added_spans(spark):
    """The classifier adds spans that most labelers vote for, never over a base span, and leaves tables of numbers."""
    good = [f"please call tel. (212) 555-0{i:03d} today" for i in range(100, 160)] + [f"Dear Dr. Anna Weber, mail to joe{i} [at] mail [dot] com" for i in range(60)]
    bad = [f"row 100-20-{3000 + i} 100-21-{3000 + i} 100-22-{3000 + i} total" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, "mail a.b@c.org or (212) 555-0188 now"), (501, "password = abcdefgh12345678X9 end")]
    got = {r.doc_id: r for r in pii.report(frame(spark, rows)).collect()}
    assert sum("phone_national" in got[i].spans for i in range(60)) >= 55
    assert sum("email_disguised" in got[i].spans for i in range(60, 120)) >= 55
    assert got[500].spans == "email:5:14,phone_national:18:32"
    assert all(r.n_email + r.n_phone + r.n_ip + r.n_card == (r.doc_id == 500) for r in got.values())


def test_overlaps_are_replaced_together(spark):
    rows = [(1, "x" * 1020 + " token=ABCDEFGHIJ1234567890+49 30 901820123 y"), (2, "z" * 5000)]
    text = {r.doc_id: r.text for r in pii.redacted(frame(spark, rows)).collect()}
    assert text[1].startswith("x" * 1020 + " ") and text[1].endswith(" y") and "901820123" not in text[1] and text[2] == "z" * 5000
