"""Small documents with every odd case: null, empty, very long, copies, near copies, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, block string, spans string, kept int, score double"


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rnd = random.Random(seed)
    line = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(n))
    rows: list[tuple[int | None, str | None]] = []
    passage, boiler = line(60), "Licensed under the terms of some public licence."
    for i in range(40):
        parts = [line(rnd.randint(3, 25)) for _ in range(rnd.randint(1, 6))]
        if i % 4 == 0:
            parts.insert(rnd.randint(0, len(parts)), passage)
        if i % 3 == 0:
            parts.append(boiler)
        rows.append((i * 7 % 41, "\n".join(parts)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, rows[4][1].replace("1", "2", 1)), (53, None), (54, ""), (55, " \t\n "), (56, "one"), (57, "é漢😀 " * 5)]
    rows += [(60, "the same line of many words again\n" * 300), (61, "x" * 5000), (62, line(4000)), (63, rows[8][1].upper())]
    rows += [(70, "a b c d e f g\na b c d e f h"), (71, "a b c d e f g i\nq"), (72, "a b c e f g")]
    rows += [(None, rows[5][1]), (None, None), (80, "repeated row of some words here"), (80, "repeated row of some words here")]
    return rows


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "b", "s", 0, 0.5) for i, t in rows], SCHEMA).repartition(5)


def order(rows):
    """Rows as an operator orders documents: by id, null last."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
