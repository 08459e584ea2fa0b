"""Operators against brute force on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from convmem.llm import embedding_dedup, line_dedup, packing, pieces, pii, quality, simhash, substring_dedup, suffix_dedup, toxicity
from convmem.llm import queries as registered
from convmem.llm.queries import tokenizer_path
from tests.llm.corpus import frame, order, texts


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = texts() + [(90, "a  b\n\n c <|endoftext|> don't\t"), (91, " lead"), (92, "trail "), (93, "x" + " " * 300_000 + "y"), (94, "<|endoftext|>"), (95, "a" * 3000)]
    got = [r.asDict() for r in packing.packed(frame(spark, rows), tokenizer_path("byte_bpe_50k.json"), 256, open_bins=8).collect()]
    want = Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        start, piece = 0, 0
        while start < len(ids):
            n = (len(ids) % 256 or 256) if not start else 256
            want[(i, piece, start, n, zlib.crc32(ids[start : start + n].tobytes()))] += 1
            start, piece = start + n, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


def test_bins_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (6, 5)] == [(0, 0), (1, 0)]
    assert bins.place(7) == (2, 0)  # the third open one closes sequence 0, the fullest
    assert bins.place(4) == (1, 5)
    assert bins.place(3) == (2, 7)


def test_substring_dedup(spark):
    rows = texts()
    first: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            key, own = tuple(w[k : k + 13]), 1 << 62 if i is None else i
            first[key] = min(first.get(key, own), own)
    want = Counter()
    for i, w in split:
        out = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (1 << 62 if i is None else i):
                out[k : k + 13] = [True] * 13
        want[(i, len(w), sum(out), digest(b" ".join(x for x, o in zip(w, out, strict=True) if not o)))] += 1
    assert Counter(map(tuple, substring_dedup.without_repeats(frame(spark)).collect())) == want
    assert any(r[2] for r in want)


@pytest.mark.parametrize("batch,block", [(1 << 16, 4 << 20), (8, 3000)])
def test_suffix_dedup(spark, monkeypatch, batch, block):
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rows = [(i, t) for i, t in texts() if i is not None and i != 80]  # the order of equal ids is not defined
    rows += [(500 + k, "\0ab" * (60 + k) + "tail" * k + "\0" * (90 + 5 * k)) for k in range(6)] + [(510, rows[0][1][7:250] + rows[1][1][:180] + "\0" * 7)]
    seen: set[bytes] = set()
    want = set()
    for i, t in order(rows):
        data = (t or "").encode()
        out = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                out[k : k + 100] = True
            seen.add(data[k : k + 100])
        spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
        want.add((i, len(data), int(out.sum()), spans, digest(bytes(np.frombuffer(data, np.uint8)[~out]))))
    assert set(map(tuple, suffix_dedup.without_repeats(frame(spark, rows)).collect())) == want


def near(a: tuple, b: tuple) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def test_line_dedup(spark):
    rows = [(i, t) for i, t in texts() if i is not None and i != 80]
    kept_before: list[tuple] = []
    seen: set[tuple] = set()
    want = set()
    for i, t in order(rows):
        lines = (t or "").encode().split(b"\n")
        keep = []
        for line in lines:
            w = tuple(line.split())
            if len(w) >= 3 and (w in seen or any(near(w, x) for x in kept_before)):
                gone = True
            else:
                gone = False
                keep.append(line)
            if len(w) >= 3 and w not in seen:
                seen.add(w)
                kept_before.append(w)
        want.add((i, len(lines), len(lines) - len(keep), digest(b"\n".join(keep))))
    docs = frame(spark, rows)
    assert set(map(tuple, line_dedup.without_repeats(docs).collect())) == want
    whole = line_dedup.cleaned(docs)
    assert whole.columns == docs.columns
    assert {(r.doc_id, digest((r.text or "").encode())) for r in whole.collect()} == {(i, d) for i, _, _, d in want}
    assert whole.where("doc_id = 53").first().text is None


@pytest.mark.parametrize("per_node,least", [(4, 4), (1 << 20, 4), (1 << 20, 4096)])
def test_simhash(spark, monkeypatch, per_node, least):
    monkeypatch.setattr(simhash.links, "__defaults__", (per_node, least))
    rows = [(i, t) for i, t in texts() if i is not None] + [(200 + k, "w%d " % (k // 3) * 30) for k in range(12)]
    prints = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and comp[a] < comp[b]:
                    comp[b], changed = comp[a], True
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(i, f"{prints[i]:016x}", comp[i]) for i in prints}


def test_trie_join_finds_all_close_pairs():
    rnd = np.random.default_rng(3)
    values = np.unique(np.concatenate([rnd.integers(0, 1 << 63, 400, dtype=np.uint64), rnd.integers(0, 256, 200, dtype=np.uint64)]))
    found = set()

    class Links:
        budget = 2

        def __call__(self, a, b):
            found.update(zip(a.tolist(), b.tolist(), strict=True))

    simhash.close_pairs(values, values, 2, 0, Links())
    assert found == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}


def test_embeddings(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(40, 16))
    rows = [v for v in base] + [base[0]] * 30 + [base[1] + rnd.normal(size=16) * 0.05 for _ in range(60)] + [np.zeros(16), base[2] * 3]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(900, None), (901, [float("nan")] * 16), (902, [None] * 16), (903, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id bigint, embedding array<double>, label int, shard int")
    m = np.array([v for v in rows])
    norm = np.linalg.norm(m, axis=1)
    unit = m / np.where(norm > 0, norm, 1)[:, None]
    link = (unit @ unit.T >= 0.9) & ~np.eye(len(m), dtype=bool)
    comp = list(range(len(m)))
    for _ in range(len(m)):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(m))]
        if new == comp:
            break
        comp = new
    want = {(i, int(link[i].sum()), comp[i], comp[i] == i) for i in range(len(m))} | {(i, 0, i, True) for i in (900, 901, 902, 903)}
    assert set(map(tuple, embedding_dedup.near_duplicates(df).collect())) == want


def test_pieces_equal_the_library():
    import random
    from array import array

    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Coder(path)
    rnd = random.Random(2)
    odd = ["", " ", "  a  b ", "\n", "a\nb", "é漢😀x", "<s>x</s>", "    " * 20, "a" * 300, "internationalization" * 30]
    odd += ["".join(rnd.choice("etaoin shrdlu.,\n ABéü漢0159") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    for t in odd:
        assert list(array("I", own.encode(t))) == library.encode(t), t
        assert own.decode(own.encode(t)) == t
    # The stream commits before the end, and needs no words.
    v = own.v
    text = pieces.SPACE + "the quick brown fox jumps over the lazy dog and ".replace(" ", pieces.SPACE) * 20
    runs = list(pieces.viterbi(text, v))
    assert len(runs) > 3 and [i for r in runs for i in r] == library.encode(text[1:].replace(pieces.SPACE, " "))


def test_unigram_paths_have_the_greatest_score():
    from array import array

    coder = pieces.Coder(tokenizer_path("piece_bpe_32k.model"), unigram=True)
    v = coder.v
    for t in ["the quick brown fox", "internationalization of words", "hello  world", "aaaaaaaaaaab"]:
        text = (pieces.SPACE + t).replace(" ", pieces.SPACE)
        best = [0.0] + [float("-inf")] * len(text)
        for i in range(1, len(text) + 1):
            best[i] = max(best[j] + v.score[v.ids[text[j:i]]] for j in range(i) if text[j:i] in v.ids)
        ids = list(array("I", coder.encode(t)))
        assert sum(v.score[i] for i in ids) == best[-1]
        assert coder.decode(coder.encode(t)) == t


def test_pieces_query(spark):
    rows = {(r.doc_id, r.n_ids, r.same) for r in pieces.round_trip(frame(spark), tokenizer_path("piece_bpe_32k.model")).collect()}
    assert (53, 0, True) in rows and all(same for _, _, same in rows)
    docs = frame(spark)
    path = tokenizer_path("piece_bpe_32k.model")
    back = pieces.decoded(pieces.encoded(docs, path), path)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text or "") for r in docs.collect()}


def test_quality(spark):
    rows = texts() + [(300, ("the cat and a dog " * 20)), (301, "\n".join(["### | * of the"] * 30))]
    words = re.compile(r"[^\x20\x09-\x0D]+")
    want = Counter()
    for i, t in rows:
        t = t or ""
        w = words.findall(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        twice = [False] * len(w)
        for k in range(len(w) - 2):
            if grams[tuple(w[k : k + 3])] > 1:
                twice[k : k + 3] = [True] * 3
        lines = [x for x in t.split("\n") if words.search(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(twice), len(w) < 50 or 100 * sum(twice) > 50 * len(w))] += 1
    got = quality.judged(frame(spark, rows)).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def luhn(d: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(d)):
        v = int(x) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def test_pii(spark):
    rows = texts() + [
        (400, "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.4 x@é.fr q+a@b-c.de. +1 (23) 4567890123 +12+34 4111 1111 1111 1111 4111-1111-1111-1111"),
        (401, "1" * 3000 + " " + "a@" * 500),
        (402, " ".join(f"u{i}@h{i}.com" for i in range(600))),
        (403, "call me +44 (20) 7946-0958 or mail joe@mail.org, card 4012888888881881, host 10.0.0.1"),
    ]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    want = Counter()
    for i, t in rows:
        spans = []
        for rank, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m.group())
                ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
                if ok:
                    spans.append((m.start(), rank, kind, m.end()))
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        want[(i, *[sum(s[2] == k for s in spans) for k in patterns], digest(listed.encode()))] += 1
    got = pii.report(frame(spark, rows)).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    clean = pii.redacted(frame(spark, rows))
    assert clean.columns == frame(spark, rows).columns
    text = clean.where("doc_id = 403").first().text
    assert text == "call me [PHONE] or mail [EMAIL], card [CARD], host [IP]"
    assert clean.where("doc_id = 53").first().text is None


def test_reliabilities_are_learnt():
    """A labeler that votes at random gets no say."""
    counted = [("k", (1, 1, 1), 50), ("k", (1, 1, -1), 50), ("k", (-1, -1, 1), 50), ("k", (-1, -1, -1), 50)]
    assert [p > 0.5 for p in pii.posteriors(counted, 3)] == [True, True, False, False]
    model = pii.fitted(counted, 3)
    assert model.yes[0] > model.yes[2]


def test_toxicity(spark):
    rnd = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rnd.integers(0, 300)}" for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            words[5], words[20] = "idiot", "you"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (None, "you idiot"), (902, "x" * 100_000)]
    known = spark.createDataFrame(labels + [(None, 1, 1), (903, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(frame(spark, rows), known).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in range(400))
    assert np.mean([got[i].predicted == int(i % 5 == 0) for i in held]) > 0.95
    kept = toxicity.accepted(frame(spark, rows), known)
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.scores(frame(spark), none).collect()} == {0.0}


def test_empty_tables(spark):
    docs = frame(spark, [])
    path, piece = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for df in (
        packing.packed(docs, path),
        substring_dedup.without_repeats(docs),
        suffix_dedup.without_repeats(docs),
        line_dedup.without_repeats(docs),
        line_dedup.cleaned(docs),
        simhash.near_duplicates(docs),
        simhash.one_of_each(docs),
        embedding_dedup.near_duplicates(vectors),
        pieces.round_trip(docs, piece),
        quality.judged(docs),
        pii.report(docs),
        pii.redacted(docs),
        toxicity.scores(docs, labels),
    ):
        assert df.count() == 0


def test_every_operator_is_registered():
    assert [f"op{n}_" for n in range(1, 14)] == sorted({re.match(r"op\d+_", k)[0] for k in registered.queries()}, key=lambda x: int(x[2:-1]))
