"""Language identification by a byte convolutional network, trained in numpy and applied to batches of windows.

A window is ``WINDOW`` bytes. Bytes are embedded, filters of several widths run over them, each filter keeps its largest
value, and a softmax turns these into probabilities. A document is cut into windows without gaps (the last one is
padded with zero bytes); their mean log-probabilities give its language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.llm.samples import bounded_by
from passages.llm.words import LOWER, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
DIM = 8
FILTERS = 12
UNKNOWN = "und"
#: windows in one product; a window needs 70 KB while it is worked on
AT_ONCE = 128


def windows_of(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, zero-padded, and the text each belongs to."""
    counts = [max(1, -(-len(t) // size)) for t in texts]
    flat = np.frombuffer(b"".join(t.ljust(c * size, b"\0") for t, c in zip(texts, counts)), np.uint8)
    return LOWER[flat].reshape(-1, size), np.repeat(np.arange(len(texts)), counts)


class Network:
    def __init__(self, classes: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.p = {"embed": draw.normal(0, 0.3, (256, DIM)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"filter{w}"] = draw.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32)
        self.p["out"] = draw.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
        self.p["bias"] = np.zeros(classes, np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        n, size = x.shape
        e = self.p["embed"][x].reshape(n, size * DIM)
        peaks, places = [], []
        for w in WIDTHS:
            runs = np.lib.stride_tricks.as_strided(e, (n, size - w + 1, w * DIM), (e.strides[0], 4 * DIM, 4))
            c = np.ascontiguousarray(runs).reshape(-1, w * DIM) @ self.p[f"filter{w}"]
            c = c.reshape(n, size - w + 1, FILTERS)
            at = c.argmax(1)
            places.append(at)
            peaks.append(np.take_along_axis(c, at[:, None], 1)[:, 0])
        return np.concatenate(peaks, 1), places

    def peaks(self, x: np.ndarray) -> np.ndarray:
        """Pooled values alone: all widths in one product, whose shorter filters are padded with zeros."""
        n, size = x.shape
        top = max(WIDTHS)
        filters = np.zeros((top * DIM, len(WIDTHS) * FILTERS), np.float32)
        for k, w in enumerate(WIDTHS):
            filters[: w * DIM, k * FILTERS : (k + 1) * FILTERS] = self.p[f"filter{w}"]
        e = np.zeros((n, (size + top - 1) * DIM), np.float32)
        e[:, : size * DIM] = self.p["embed"][x].reshape(n, size * DIM)
        runs = np.lib.stride_tricks.as_strided(e, (n, size, top * DIM), (e.strides[0], 4 * DIM, 4))
        c = (np.ascontiguousarray(runs).reshape(-1, top * DIM) @ filters).reshape(n, size, -1)
        out = np.empty((n, c.shape[2]), np.float32)
        for k, w in enumerate(WIDTHS):
            out[:, k * FILTERS : (k + 1) * FILTERS] = c[:, : size - w + 1, k * FILTERS : (k + 1) * FILTERS].max(1)
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.peaks(x), 0) @ self.p["out"] + self.p["bias"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Network:
        """Adam on the cross-entropy; the gradient of max pooling goes to the place of the maximum."""
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                bx, by = x[pick], y[pick]
                n = len(bx)
                h, places = self.pooled(bx)
                act = np.maximum(h, 0)
                z = act @ self.p["out"] + self.p["bias"]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(n), by] -= 1
                z /= n
                grad = {"out": act.T @ z, "bias": z.sum(0), "embed": np.zeros_like(self.p["embed"])}
                dh = (z @ self.p["out"].T) * (h > 0)
                for k, w in enumerate(WIDTHS):
                    d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    spot = bx[np.arange(n)[:, None, None], places[k][:, :, None] + np.arange(w)]
                    seen = self.p["embed"][spot].reshape(n, FILTERS, w * DIM)
                    grad[f"filter{w}"] = np.einsum("nf,nfd->df", d, seen)
                    back = np.einsum("nf,df->nfd", d, self.p[f"filter{w}"]).reshape(n, FILTERS, w, DIM)
                    np.add.at(grad["embed"], spot.ravel(), back.reshape(-1, DIM))
                step += 1
                for name, g in grad.items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    self.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


class Model:
    def __init__(self, languages: list[str], network: Network):
        self.languages, self.network = languages, network

    def predict(self, texts: list[bytes], at_once: int = AT_ONCE) -> np.ndarray:
        """Probabilities of each language, from the mean log-probabilities over all windows of a text."""
        x, row = windows_of(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(x), at_once):
            lp = self.network.log_probabilities(x[a : a + at_once])
            np.add.at(total, row[a : a + at_once], lp)
        mean = total / np.bincount(row, minlength=len(texts))[:, None]
        e = np.exp(mean - mean.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def train(labelled: DataFrame, per_language: int = 600, windows_per_text: int = 4) -> Model | None:
    """Fit on (doc_id, text, lang): at most about ``per_language`` texts of each language and ``windows_per_text`` windows
    of each text, spread over it. None if no row has text and language."""
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0").select("doc_id", "text", "lang")
    size = F.greatest(F.lit(1), F.floor(F.length("text") / windows_per_text)).cast("int")
    parts = [F.substring(F.col("text"), F.lit(1) + k * size, F.least(size, F.lit(WINDOW))) for k in range(windows_per_text)]
    rows = bounded_by(rows, "doc_id", "lang", per_language).select("doc_id", "lang", F.array(*parts).alias("parts")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"]))
    languages = sorted({r["lang"] for r in rows})
    texts, y = [], []
    for r in rows:
        for part in r["parts"]:
            if part:
                texts.append(part.encode()[:WINDOW])
                y.append(languages.index(r["lang"]))
    x, row = windows_of(texts)
    return Model(languages, Network(len(languages)).train(x, np.array(y)[row]))


def identify(docs: DataFrame, model: Model | None, column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the probability of lang_pred, 0 for ``und``).

    A text that is null or has no letter is ``und``; without a model everything is. Whole texts are read, however long.
    Clashing lang_pred and score columns are replaced; the others stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")

    def run(batches):
        known = shared.value
        for batch in batches:
            for part in slices(batch, column):
                texts = part.column(column).to_pylist()
                letters = [t is not None and known is not None and any(map(str.isalpha, t)) for t in texts]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                some = [i for i, ok in enumerate(letters) if ok]
                if some:
                    p = known.predict([texts[i].encode() for i in some])
                    for i, k, s in zip(some, p.argmax(1), p.max(1)):
                        names[i], scores[i] = known.languages[k], float(s)
                yield part.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(scores, pa.float64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out(key: Column, parts: int, part: int) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(parts)) == part
