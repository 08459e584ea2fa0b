"""Equal lines go whatever their number of words."""

from __future__ import annotations

from convmem.llm import line_dedup
from tests.llm.corpus import frame


def test_equal_lines_of_one_or_two_words(spark):
    token = "QUJD" * 30
    rows = [(1, f"Home\nContact us\n\nこれは空白のない行です\n{token}\nonly here"), (2, f"Home\n Contact  us\n\n \nこれは空白のない行です\n{token}\nhome"), (3, "Home\nHome\nContact you")]
    kept = {r.doc_id: r.text for r in line_dedup.cleaned(frame(spark, rows)).collect()}
    assert kept == {1: rows[0][1], 2: "\n \nhome", 3: "Contact you"}
    assert {r.doc_id: r.n_removed for r in line_dedup.without_repeats(frame(spark, rows)).collect()} == {1: 0, 2: 4, 3: 2}
