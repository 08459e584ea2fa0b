"""A worker that remembers enough words forgets them before a batch looks up its own, not in between."""

from convmem.llm import pieces
from convmem.llm.queries import tokenizer_path


def _coder():
    return pieces.Coder(tokenizer_path("piece_bpe_32k.model"))


def test_words_of_a_batch_are_not_forgotten(monkeypatch):
    coder = _coder()
    expected = coder.encode_all(["alpha beta gamma", "alpha delta"])
    coder.known.clear()
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    assert coder.encode_all(["alpha beta gamma"]) == expected[:1]

    def never(word):
        raise AssertionError(f"{word} was forgotten")

    coder._long = coder.known.search = never
    assert coder.encode_all(["alpha delta"]) == expected[1:]


def test_bytes_of_many_texts(monkeypatch):
    coder = _coder()
    texts = ["", "a b", " lead", "é\U0001f600 漢", "x" * 300, "", "tail "]
    ids = coder.encode_all(texts)
    assert [b.decode("utf-8", "replace") for b in coder.bytes_of(ids)] == [coder.decode(i) for i in ids] == texts
    assert coder.bytes_of([b"", b""]) == [b"", b""] and coder.bytes_of([]) == []
