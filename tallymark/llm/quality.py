"""Quality classifier learned from positive and unlabelled documents.

Trusted positives, unlabelled text and an estimated class prior give an unbiased estimate of the risk over all
text. Its negative part is kept from falling below zero, else a flexible model would drive it there by
memorising the positives. The class prior is the smallest ratio, over score thresholds, of the unlabelled to
the positive share above the threshold, found with a first positive-against-unlabelled model on rows that
model has not seen. Features describe the whole text; label, language, source and id are not among them.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import chunks

SAMPLE = 20_000  # most positives, and most unlabelled rows, that a model is fitted on
THRESHOLD = 0.7
HIDDEN = 16
_MARKS = np.array([ord(c) for c in string.punctuation])


def features(text: str) -> np.ndarray:
    """Shares and ratios over the whole text; finite for any text, zeros for the empty one."""
    out = np.zeros(16 + _MARKS.size, dtype=np.float32)
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = text.split()
    n, w = len(data), max(1, len(words))
    distinct = len(set(words))
    lines = text.split("\n")
    lengths = list(map(len, words)) or [0]
    out[:16] = (
        counts[65:91].sum() / n, counts[97:123].sum() / n, counts[48:58].sum() / n, counts[9:14].sum() / n, counts[32] / n,
        counts[128:].sum() / n, counts[:9].sum() / n, np.log1p(n) / 10, sum(lengths) / w / 10, min(max(lengths), 100) / 100,
        distinct / w, np.log(distinct + 1) / np.log(w + 1), sum(map(eq, words, words[1:])) / w,
        len(set(lines)) / len(lines), len(zlib.compress(data, 1)) / (n + 20), sum(map(str.isupper, words)) / w)
    out[16:] = np.sqrt(counts[_MARKS] / w)
    return out


@dataclass
class Model:
    """A network of one hidden layer over standardised features; ``prior`` is the estimated share of positives."""

    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def _hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip((x - self.centre) / self.scale, -6, 6)
        return x, np.tanh(x @ self.weights[0] + self.weights[1])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x)[1] @ self.weights[2] + self.weights[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.01,
             decay: float = 1e-4, seed: int = 0) -> Model:
    """Minimise the non-negative risk with logistic loss by full-batch Adam.

    Where the negative part ``E_u[l(-g)] - prior * E_p[l(-g)]`` is below zero, the step goes up along it alone.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate((positive, unlabelled))
    scale = both.std(axis=0)
    model = Model(both.mean(axis=0), np.where(scale > 1e-6, scale, 1.0), [
        rng.normal(0, 0.3, (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)], prior)
    first, second = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]
    n_p, n_u = len(positive), len(unlabelled)
    for step in range(1, steps + 1):
        x, h = model._hidden(both)
        z = h @ model.weights[2] + model.weights[3][0]
        p = _sigmoid(z)
        against = np.logaddexp(0, z)  # loss of calling a row negative
        negative = against[n_p:].mean() - prior * against[:n_p].mean()
        dz = np.concatenate((-prior * p[:n_p] / n_p, p[n_p:] / n_u))  # of the negative part
        if negative < 0:
            dz = -dz
        else:
            dz[:n_p] += prior * (p[:n_p] - 1) / n_p
        dh = np.outer(dz, model.weights[2]) * (1 - h * h)
        grads = [x.T @ dh, dh.sum(axis=0), h.T @ dz, np.array([dz.sum()])]
        for i, g in enumerate(grads):
            g = g + decay * model.weights[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            model.weights[i] = model.weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled scores: least upper confidence bound of the ratio of shares above a threshold."""
    cuts = np.unique(np.concatenate((positive, unlabelled)))
    p = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / positive.size
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / unlabelled.size
    cuts_with = p > 0
    p, u = p[cuts_with], u[cuts_with]
    slack = np.sqrt(np.log(4 / delta) / (2 * positive.size)) + np.sqrt(np.log(4 / delta) / (2 * unlabelled.size))
    best = int(np.argmin(u / p + slack / p))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def _vectors(df: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).tobytes() for (texts,) in chunks([batch.select([0])], 0) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], [*keep, "x"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select("text", *keep).mapInArrow(run, f"{kinds}, x binary")


def fit(df: DataFrame, positives: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on ``df`` (doc_id, text), of which the ids in ``positives`` are trusted; null if either side has no row.

    At most ``sample`` positives and ``sample`` other rows are used, those of least id hash, so the fit does not
    depend on the layout. The driver gets their features only. Null texts count as empty; repeated rows as often
    as they come; rows without an id are unlabelled.
    """
    df = df.select("doc_id", "text")
    trusted = positives.select("doc_id").distinct().withColumn("p", F.lit(1))
    marked = df.select("doc_id").join(trusted, "doc_id", "left").select("doc_id", F.coalesce("p", F.lit(0)).alias("p")).distinct()
    order = F.xxhash64(F.lit(7), "doc_id")
    chosen = [marked.filter(F.col("p") == side).orderBy(order, "doc_id").limit(sample) for side in (1, 0)]
    picked = chosen[0].union(chosen[1])
    rows = _vectors(df.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "p"), ["doc_id", "p"]).collect()
    if len({r.p for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x, dtype=np.float32) for r in rows]).astype(np.float64)
    p = np.array([r.p for r in rows], dtype=bool)
    half = np.arange(p.size) % 2 == 0
    for side in (p, ~p):  # both halves need both sides
        if not ((side & half).any() and (side & ~half).any()):
            half = np.ones(p.size, dtype=bool)
    rest = ~half if (~half).any() else half
    seen, unseen = x[half], x[rest]
    first = minimise(seen[p[half]], seen[~p[half]], 0.5, steps=200)
    prior = class_prior(first.logits(unseen[p[rest]]), first.logits(unseen[~p[rest]]))
    return minimise(x[p], x[~p], prior)


def score(df: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row and ``score``; 0.5 everywhere without a model. No shuffle."""
    if model is None:
        return df.select(*keep, F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for (texts,) in chunks([batch.select([0])], 0) for t in texts]
            scores = model.scores(np.stack(found)) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*keep, "score"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select("text", *keep).mapInArrow(run, f"{kinds}, score double")
