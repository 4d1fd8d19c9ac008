"""Piece models read from their stored form: type, scores, settings."""

import struct

import pytest

from passages.llm import pieces, token_counts, vocabulary
from passages.llm.scoring_queries import MODEL


def number(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def block(field, data):
    return number(field << 3 | 2) + number(len(data)) + data


def piece(text, score=0.0, kind=None):
    return block(1, block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + (b"" if kind is None else b"\x18" + number(kind)))


BYTES = b"".join(piece(f"<0x{b:02X}>", 0.0, 6) for b in range(256))


def model(kind=1, name=b"identity", extra=0, prefix=1, rows=BYTES, charsmap=b""):
    words = [("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -6.0), ("▁a", -1.0), ("ba", -1.5)]
    normaliser = block(1, name) + block(2, charsmap) + b"\x18" + number(prefix) + b"\x20" + number(extra)
    return rows + b"".join(piece(t, s) for t, s in words) + block(2, b"\x18" + number(kind)) + block(3, normaliser)


def test_a_unigram_model_has_its_own_scores():
    v = vocabulary.Vocabulary(model())
    assert {v.text[i]: s for i, s in v.score.items()} == {" ": -3_000_000, "a": -2_000_000, "b": -2_500_000, "ab": -6_000_000, " a": -1_000_000, "ba": -1_500_000}
    # " a" + "ba" (-2.5) beats " a" + "b" + "a" (-5.5) and " " + "ab" + "a" (-11)
    assert [v.text[i] for i in pieces.encode_text("aba", v)] == [" a", "ba"]
    assert [v.text[i] for i in pieces.Encoder(model()).row("aba")] == [" a", "ba"]


def test_scores_decide_and_not_places():
    # by place "ab" comes before " a" and "ba"; a merge-based model is read by place
    v = vocabulary.Vocabulary(model(kind=2))
    ranked = sorted(v.score, key=v.score.get, reverse=True)
    assert [v.text[i] for i in ranked] == [" ", "a", "b", "ab", " a", "ba"]


@pytest.mark.parametrize("options", [{"name": b"nmt_nfkc"}, {"charsmap": b"x"}, {"extra": 1}, {"prefix": 0}, {"rows": b""}])
def test_models_that_change_the_text_are_refused(options):
    with pytest.raises(ValueError):
        vocabulary.Vocabulary(model(**options))


def test_the_public_model_is_merge_based_and_unchanged():
    kind, trainer, normaliser = vocabulary.settings(vocabulary.read(MODEL))
    assert kind == 2 and trainer[35] == 1 and normaliser[1] == b"identity"
    v = vocabulary.Vocabulary(vocabulary.read(MODEL))
    assert max(v.score.values()) == -693147 and len(v.bytes) == 256


def test_counts_with_a_unigram_model(spark):
    docs = spark.createDataFrame([(1, "aba ab"), (2, "é")], "doc_id long, text string")
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, model()).collect()}
    v = vocabulary.Vocabulary(model())
    assert counts == {1: len(pieces.encode_text("aba ab", v)), 2: len(pieces.encode_text("é", v))}


@pytest.mark.parametrize("kind", [1, 2])
def test_stretches_searched_together_are_those_of_the_stream(monkeypatch, kind):
    coder = pieces.Encoder(model(kind=kind))
    texts = [None, "", "aba", "aaaa abab  ba▁b", "é\U0001f600a b", "ab" * 40 + " ba", "\n", "bbbbaaab " * 3]
    monkeypatch.setattr(pieces, "TOGETHER", 3)
    monkeypatch.setattr(pieces.Encoder, "window", lambda self, text: 1 / 0)
    assert coder.rows(texts) == [pieces.encode_text(t, coder.v) if t else [] for t in texts]


def test_stretches_of_the_public_model_searched_together():
    coder = pieces.Encoder(vocabulary.read(MODEL))
    texts = ["The banana, 12345 aaaaaaaaaa!!", "Größe çà 漢字 ▁ \U0001f600", "x = [[1, 2], [3]]\n\treturn  None", "aaaa aaa aa a ======== ...."]
    assert coder.rows(texts) == [pieces.encode_text(t, coder.v) for t in texts]


def test_texts_are_cut_once_and_spelled_from_a_table(monkeypatch):
    coder = pieces.Encoder(model())
    cut, plain = [], coder.v.stretches
    monkeypatch.setattr(coder.v, "stretches", lambda t: (cut.append(t), plain(t))[1])
    texts = ["aba ab", None, "", "ü " + "ab" * 50, "ab aba"]
    rows = coder.rows(texts)
    assert cut == [t for t in texts if t] and rows[1] == rows[2] == []
    assert rows == [pieces.encode_text(t, pieces.Vocabulary(model())) if t else [] for t in texts]
    monkeypatch.setattr(coder.v, "text", None)
    assert [pieces.decode_ids(r, coder.v) for r in rows] == [t or "" for t in texts]
