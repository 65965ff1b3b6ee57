"""Quality scores by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled good; all other documents are unlabelled.  With a class prior
pi, the risk is pi R+(P) + max(0, R-(U) - pi R-(P)): where the second part goes below zero, its
gradient is turned round, so a flexible model can't fit the unlabelled set as all negative.

The prior is estimated from positives and unlabelled ones alone.  A network told to part the two, with
half of each, ranks the other half: above any threshold, the unlabelled ones are at least pi times as
frequent as the positives, so pi is about the least of these ratios.  A second round ranks by networks
that are trained with the first round's prior.

Features come from all bytes of a text: shares of bytes and of hashed byte pairs (square roots), a few
ratios, and how often words repeat.  The model is a small network with one hidden layer, trained in numpy.  About
``positives`` and ``unlabelled`` documents (twice as many at most) are drawn by a hash, and their
features come to the driver: the only bound of this operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow_text import runs, text_bytes
from tessera.llm.common import held_out, unit_hash
from tessera.llm.near_dedup import word_hashes

PAIRS = 512
FEATURES = 256 + PAIRS + 9


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text; an empty text has zeros and a length of 0."""
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for i, j in runs(offsets, 1 << 20):
        own, n = data[offsets[i] : offsets[j]], np.diff(offsets[i : j + 1])
        text = np.repeat(np.arange(j - i, dtype=np.int32), n)
        one = np.bincount(text * 256 + own, minlength=(j - i) * 256).reshape(j - i, 256)
        size = np.maximum(n, 1)[:, None]
        out[i:j, :256] = np.sqrt(one / size)
        if len(own) > 1:
            pair = (own[:-1].astype(np.int32) * 37 + own[1:].astype(np.int32) * 151) & (PAIRS - 1)
            inside = text[:-1] == text[1:]
            two = np.bincount((text[:-1] * PAIRS + pair)[inside], minlength=(j - i) * PAIRS).reshape(j - i, PAIRS)
            out[i:j, 256 : 256 + PAIRS] = np.sqrt(two / size)
        blank = one[:, [9, 10, 11, 12, 13, 32]].sum(1)
        upper, lower, digit, high = one[:, 65:91].sum(1), one[:, 97:123].sum(1), one[:, 48:58].sum(1), one[:, 128:].sum(1)
        sign = n - blank - upper - lower - digit - high
        h, owner = word_hashes(data, offsets[i : j + 1])
        words = np.maximum(np.bincount(owner, minlength=j - i), 1)
        again = [np.bincount(owner[k:][(h[k:] == h[:-k]) & (owner[k:] == owner[:-k])], minlength=j - i) / words for k in (1, 2)]
        share = out[i:j, 256 : 256 + PAIRS].astype(np.float64) ** 2
        out[i:j, 256 + PAIRS :] = np.stack([*again, (share**2).sum(1) * 10, (share > 0).sum(1) / np.maximum(np.minimum(n, PAIRS), 1), np.log1p(n) / 10, sign / size[:, 0], sign / np.maximum(blank, 1), upper / np.maximum(upper + lower, 1), (n - blank) / np.maximum(blank + 1, 1) / 10], 1)
    return out


@dataclass
class PUModel:
    """A network with one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.a + self.b) @ self.c + self.d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40).astype(np.float64)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(z: np.ndarray, n: int, prior: float | None) -> tuple[float, np.ndarray]:
    """(risk, step's direction by logit) of n positives and the unlabelled ones behind them.

    Derivatives: of the positive loss log(1 + e^-z) it is s - 1, of the negative loss log(1 + e^z) it is s.
    Where the negative part is below zero, the direction is that part's gradient turned round.
    """
    s, k = _sigmoid(z), len(z) - n
    if prior is None:
        return np.logaddexp(0, -z[:n]).mean() + np.logaddexp(0, z[n:]).mean(), np.concatenate([(s[:n] - 1) / n, s[n:] / k])
    negative = np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean()
    minus = np.concatenate([-prior * s[:n] / n, s[n:] / k])
    plus = np.concatenate([prior * (s[:n] - 1) / n, np.zeros(k)])
    return prior * np.logaddexp(0, -z[:n]).mean() + max(0.0, negative), -minus if negative < 0 else plus + minus


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.5, seed: int = 4) -> float:
    """The share of positives among the unlabelled; thresholds that fewer than ``least`` of the positives reach are left out, as too few are above."""
    rng, prior = np.random.default_rng(seed), None
    p, u = (x[rng.permutation(len(x))] for x in (positive, unlabelled))
    for _ in range(2):
        found = []
        for half in (0, 1):
            learn, rank = [x[half::2] for x in (p, u)], [x[1 - half :: 2] for x in (p, u)]
            if all(map(len, (*learn, *rank))):
                model = fit(*learn, prior, epochs=20)
                a, b = (np.sort(model.logit(x.astype(np.float32))) for x in rank)
                t = np.quantile(a, np.linspace(0, 1 - least, 50))
                found.append(min((1 - np.searchsorted(b, t, "left") / len(b)) / (1 - np.searchsorted(a, t, "left") / len(a))))
        prior = float(np.clip(np.mean(found), 0.01, 0.99)) if found else 0.5
    return prior


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 16, epochs: int = 60, batch: int = 256, rate: float = 0.003, decay: float = 1e-4, seed: int = 3) -> PUModel:
    """Adam on the non-negative PU risk with the logistic loss; without a prior, positives are just told from unlabelled ones."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), np.maximum(both.std(0), 0.02)
    p, u = ((x - mean) / scale for x in (positive, unlabelled))
    w = [rng.normal(0, 0.05, (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    m = [[np.zeros_like(x), np.zeros_like(x)] for x in w]
    steps, t = epochs * max(1, len(u) // batch), 0
    for _ in range(steps):
        xp, xu = p[rng.integers(0, len(p), min(batch, len(p)))], u[rng.integers(0, len(u), min(batch, len(u)))]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ w[0] + w[1])
        z = h @ w[2] + w[3]
        g = risk(z, len(xp), prior)[1]
        gh = g[:, None] * w[2] * (1 - h**2)
        grads = [x.T @ gh + decay * w[0], gh.sum(0), h.T @ g + decay * w[2], np.array([g.sum()])]
        t += 1
        now = rate * (1 - t / (steps + 1))
        for v, (a, b), d in zip(w, m, grads, strict=True):
            a += 0.1 * (d - a)
            b += 0.001 * (d**2 - b)
            v -= now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return PUModel(mean.astype(np.float32), scale.astype(np.float32), w[0].astype(np.float32), w[1].astype(np.float32), w[2].astype(np.float32), float(w[3][0]))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(*text_bytes(batch.column(0)))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "kind", "x"])


def train(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 6000, folds: int = 3, fold: int = 1) -> PUModel | None:
    """The model learned outside the held-out fold; None without labelled good documents.

    Labels with a null id or quality are left out; an id labelled more than once counts by its
    largest quality.
    """
    known = labels.filter(~held_out(F.col("doc_id"), folds, fold) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))).first()
    learn = docs.filter(~held_out(F.col("doc_id"), folds, fold) & F.col("doc_id").isNotNull()).select("text", "doc_id")
    total = learn.select("doc_id").count()
    if not good or not total:
        return None
    # Rows are drawn by id and text, as many may share an id; a bound holds even where all of them are drawn.
    place = lambda name: unit_hash(name, F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))))

    def drawn(rows: DataFrame, name: str, share: float, most: int, kind: int) -> DataFrame:
        some = rows.withColumn("place", place(name)).filter(F.col("place") < min(1.0, share) * 2.0**52)
        return some.orderBy("place", "doc_id").limit(most).select("text", "doc_id", F.lit(kind).alias("kind"))

    rank = unit_hash("quality", F.col("doc_id"))
    trusted = known.filter((F.col("quality") == 1) & (rank < min(1.0, positives / good) * 2.0**52)).orderBy(rank, "doc_id").select("doc_id").limit(4 * positives)
    ones = drawn(learn.join(F.broadcast(trusted), "doc_id", "left_semi"), "positive", 1.0, 2 * positives, 1)
    rest = drawn(learn, "unlabelled", unlabelled / total, 2 * unlabelled, 0)
    got = sorted((r["kind"], r["doc_id"], bytes(r["x"])) for r in ones.unionByName(rest).mapInArrow(_featurise, "doc_id long, kind int, x binary").collect())
    x = {k: np.array([np.frombuffer(b, np.float32) for kind, _, b in got if kind == k]).reshape(-1, FEATURES) for k in (0, 1)}
    if not len(x[0]) or not len(x[1]):
        return None
    positive, rest = x[1].astype(np.float64), x[0].astype(np.float64)
    return fit(positive, rest, estimate_prior(positive, rest))


def score(docs: DataFrame, model: PUModel | None, folds: int = 3, fold: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null text is scored as an empty one.  Without a model every score is 0.5.  Repeated rows get
    equal results; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select("text", "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            s = np.full(batch.num_rows, 0.5)
            if model is not None:
                for i in range(0, batch.num_rows, 512):
                    j = min(i + 512, batch.num_rows)
                    s[i:j] = model.score(features(data, offsets[i : j + 1]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(predict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
