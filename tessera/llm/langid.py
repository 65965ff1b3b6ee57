"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a fixed-length window, each filter's maximum
goes through a rectifier, and a softmax layer gives the languages.  The network is trained in numpy on
windows of labelled texts.  A text is cut into windows that cover all of its bytes; its probabilities
are the means of its windows', weighted by their bytes.

For training, about ``docs_per_language`` documents of each language are drawn by a hash,
and up to ``windows_per_doc`` windows of each come to the driver: the only bound of this operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow_text import text_bytes
from tessera.llm.common import held_out, unit_hash

LETTER = r"\p{L}"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: Windows that go through the network together: small enough for a core's cache.
_TOGETHER = 64


@dataclass
class ByteCNN:
    """Weights of the network; predict() gives probabilities of windows."""

    languages: list[str]
    window: int = WINDOW
    widths: tuple[int, ...] = WIDTHS
    filters: int = FILTERS
    embed: int = EMBED
    seed: int = 5
    w: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.w:
            rng, wide, n = np.random.default_rng(self.seed), max(self.widths), self.filters * len(self.widths)
            self.w = {"E": rng.normal(0, 0.5, (256, self.embed)), "K": rng.normal(0, 0.3, (wide * self.embed, n)), "b": np.zeros(n), "D": rng.normal(0, 0.2, (n, len(self.languages))), "c": np.zeros(len(self.languages))}
            self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
            self.w["E"][0] = 0
            self.w["K"] *= self._mask()

    def _mask(self) -> np.ndarray:
        """Filters of a smaller width see the first places only."""
        wide = max(self.widths)
        place = np.repeat(np.arange(wide), self.embed)[:, None]
        return (place < np.repeat(self.widths, self.filters)[None, :]).astype(np.float32)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        wide, d = max(self.widths), self.embed
        x = np.zeros((len(windows), self.window + wide - 1, d), np.float32)
        x[:, : self.window] = self.w["E"][windows]
        s = x.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (len(x), self.window, wide * d), (s[0], s[1], s[2]))).reshape(-1, wide * d)

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(windows), _TOGETHER):
            part = windows[i : i + _TOGETHER]
            top = (self._patches(part) @ self.w["K"]).reshape(len(part), self.window, -1).max(1)
            out.append(self._softmax(np.maximum(top + self.w["b"], 0) @ self.w["D"] + self.w["c"]))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of windows and their languages, by weight."""
        n = len(x)
        patches = self._patches(x)
        z = (patches @ self.w["K"]).reshape(n, self.window, -1)
        at = z.argmax(1)
        top = np.take_along_axis(z, at[:, None], 1)[:, 0] + self.w["b"]
        h = np.maximum(top, 0)
        p = self._softmax(h @ self.w["D"] + self.w["c"])
        p[np.arange(n), y] -= 1
        p /= n
        gh = (p @ self.w["D"].T) * (top > 0)
        rows = (at + np.arange(n)[:, None] * self.window).ravel()
        seen = patches[rows].reshape(n, -1, patches.shape[1])
        g = {"D": h.T @ p, "c": p.sum(0), "b": gh.sum(0), "K": np.einsum("nfk,nf->kf", seen, gh, optimize=True) * self._mask()}
        back = (gh[:, :, None] * self.w["K"].T[None]).reshape(n, len(self.w["b"]), -1, self.embed)
        g["E"] = np.zeros_like(self.w["E"])
        padded = np.pad(x, ((0, 0), (0, max(self.widths))))
        for k in range(max(self.widths)):
            np.add.at(g["E"], np.take_along_axis(padded, at + k, 1).ravel(), back[:, :, k].reshape(-1, self.embed))
        g["E"][0] = 0
        return g

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.004) -> ByteCNN:
        """Adam on the cross entropy; a third of the windows is shortened at random each time."""
        rng = np.random.default_rng(self.seed)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        step, steps = 0, epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                x, y = windows[order[i : i + batch]].copy(), labels[order[i : i + batch]]
                for j in np.flatnonzero(rng.random(len(x)) < 0.35):
                    x[j, rng.integers(8, self.window) :] = 0
                g = self.gradients(x, y)
                step += 1
                now = rate * (1 - step / (steps + 1))
                for k, (a, b) in m.items():
                    a += 0.1 * (g[k] - a)
                    b += 0.001 * (g[k] ** 2 - b)
                    self.w[k] -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the windows that cover all bytes of the texts; an empty text has none."""
    n = -(-np.diff(offsets) // window)
    text = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][text] + nth * window
    return text, start, np.minimum(start + window, offsets[1:][text])


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """The bytes of windows, filled up with zeros."""
    at = start[:, None] + np.arange(window)
    return np.where(at < end[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def score_texts(model: ByteCNN, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities, one row per text."""
    total = np.zeros((len(offsets) - 1, len(model.languages)))
    text, start, end = windows_of(data, offsets, model.window)
    for i in range(0, len(text), 16 * _TOGETHER):
        j = slice(i, i + 16 * _TOGETHER)
        p = model.predict(cut(data, start[j], end[j], model.window)) * (end[j] - start[j])[:, None]
        np.add.at(total, text[j], p)
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def train(docs: DataFrame, docs_per_language: int = 1500, windows_per_doc: int = 4, folds: int = 3, fold: int = 1) -> ByteCNN | None:
    """The network learned from labelled documents outside the held-out fold; None if there are none."""
    known = docs.filter(~held_out(F.col("doc_id"), folds, fold) & F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, docs_per_language / n)))]), F.col("lang"))
    # Drawn by id and text, as many rows may share an id; rows that agree in both count once.
    drawn = known.filter(unit_hash("langid", F.col("doc_id"), F.md5("text")) < share * 2.0**52)
    room = F.greatest(F.lit(1), F.length("text") - WINDOW)
    starts = F.array_distinct(F.array(*[(unit_hash("window", i, F.col("doc_id")) % room).cast("int") for i in range(windows_per_doc)]))
    pieces = drawn.select("lang", "doc_id", F.explode(F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(WINDOW)))).alias("piece")).distinct()
    got = sorted((r["lang"], r["doc_id"] if r["doc_id"] is not None else -1, r["piece"]) for r in pieces.filter(F.col("piece").rlike(LETTER)).collect())
    languages = sorted(counts)
    if not got:
        return None
    data = [p.encode()[:WINDOW] for _, _, p in got]
    x = np.zeros((len(data), WINDOW), np.uint8)
    for i, b in enumerate(data):
        x[i, : len(b)] = np.frombuffer(b, np.uint8)
    y = np.array([languages.index(k) for k, _, _ in got])
    return ByteCNN(languages).fit(x, y, epochs=max(6, min(60, -(-40_000 // len(x)))))


def identify(docs: DataFrame, model: ByteCNN | None, carry: tuple[str, ...] = (), folds: int = 3, fold: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, and the carried columns.

    A null text and a text without a letter are ``und`` with score 0, as is every text when no
    language was learned.  Ties go to the language that is first by code point.  Repeated rows get
    equal results, as do rows with a null doc_id; an empty table gives an empty result; other columns
    are ignored.
    """
    # A carried text goes to the workers once.
    others = [c for c in carry if c != "text"]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(others)],
        F.col("doc_id").alias("id"),
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("readable"),
        F.col("text").alias("read"),
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, readable, text = batch.columns
            n, valid = len(text), np.asarray(readable)
            lang, score = np.full(n, "und", object), np.zeros(n)
            if model is not None and valid.any():
                p = score_texts(model, *text_bytes(text))
                lang[valid] = np.array(model.languages, object)[p.argmax(1)][valid]
                score[valid] = np.clip(p.max(1), 0, 1)[valid]
            names = batch.schema.names[:-2]
            if "text" in carry:
                kept, names = [*kept, text], [*names, "read"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = rows.drop("readable", *([] if "text" in carry else ["read"])).schema.add("lang_pred", "string").add("score", "double")
    out = rows.mapInArrow(predict, schema)
    back = [F.col("read" if c == "text" else f"carry_{others.index(c)}").alias(c) for c in carry]
    return out.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score", *back)
