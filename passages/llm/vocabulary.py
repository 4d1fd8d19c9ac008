"""Piece vocabularies of public SentencePiece models, read as a unigram language model."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

SPACE = "▁"
ESCAPED = "▁"  # stands for a literal U+2581, which only bytes can spell
NORMAL, BYTE = 1, 6
UNIGRAM = 1
STRETCH = re.compile(" *[^ ]+| +")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


def settings(model: bytes) -> tuple[int, dict, dict]:
    """(type, trainer settings, normaliser settings) by field number; types and defaults are those of the public format."""
    parts = {field: dict(_fields(value)) for field, value in _fields(model) if field in (2, 3) and isinstance(value, bytes)}
    trainer, normaliser = parts.get(2, {}), parts.get(3, {})
    return trainer.get(3, UNIGRAM), trainer, normaliser


def _checked(normaliser: dict) -> None:
    """Raises for a model whose text is changed before it is cut, which this encoder does not do."""
    name = normaliser.get(1, b"").decode()
    if name not in ("", "identity") or normaliser.get(2):
        raise ValueError(f"the model normalises its text ({name or 'own rules'}); only identity is supported")
    for field, wanted, what in ((3, 1, "puts no space in front"), (4, 0, "removes extra spaces"), (5, 1, "keeps spaces as they are")):
        if normaliser.get(field, 1) != wanted:
            raise ValueError(f"the model {what}, which is not supported")


class Vocabulary:
    """Pieces with ids and log-probabilities; the model's space sign is a plain space here.

    A unigram model has scores of its own. A merge-based model orders its pieces without probabilities; ``score`` then is Zipf's
    law over that order, ``-ln(2 + place)``. Scores are whole millionths, so that equal paths are equal in any order of
    adding. A character outside the vocabulary (a literal space sign too) is spelled in bytes, each 10 below
    the lowest piece. Models without byte pieces, and those that change the text before they cut it, raise ``ValueError``."""

    def __init__(self, model: bytes, backward: bool = False):
        kind, _, normaliser = settings(model)
        _checked(normaliser)
        pieces = []
        for field, value in _fields(model):
            if field == 1:
                entry = dict(_fields(value))
                stored = struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0
                pieces.append((entry[1].decode().replace(SPACE, " "), entry.get(3, NORMAL), stored))
        normal = [i for i, p in enumerate(pieces) if p[1] == NORMAL]
        if sum(p[1] == BYTE for p in pieces) != 256:
            raise ValueError("the model has no pieces for single bytes")
        self.text = [p[0] for p in pieces]
        if kind == UNIGRAM:
            self.score = {i: round(1e6 * pieces[i][2]) for i in normal}
        else:
            self.score = {i: -round(1e6 * math.log(2 + place)) for place, i in enumerate(normal)}
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[1] == BYTE}
        self.value = {i: b for b, i in self.bytes.items()}
        self.spelling = [bytes([self.value[i]]) if i in self.value else t.encode() for i, t in enumerate(self.text)]
        self.byte_score = min(self.score.values()) - 10_000_000
        self.longest = max(len(self.text[i]) for i in normal)
        #: no piece reaches over the start of a run of spaces, so all paths meet there
        self.cuts = not any(re.search("[^ ] ", self.text[i]) for i in normal)
        self.forward: dict = {}
        self.backward: dict = {}
        for i in normal:
            self._add(self.forward, self.text[i], i)
            if backward:
                self._add(self.backward, self.text[i][::-1], i)

    def _add(self, node: dict, letters: str, i: int) -> None:
        for c in letters:
            node = node.setdefault(c, {})
        node[None] = (i, self.score[i])

    def spelled(self, c: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in c.encode())

    def stretches(self, text: str) -> list[str]:
        """The text behind its leading space, cut where no piece reaches over; one stretch if pieces reach everywhere."""
        if not text:
            return []
        return STRETCH.findall(" " + text) if self.cuts else [" " + text]


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
