"""Quality classifier from positive and unlabelled text, by the non-negative unbiased risk.

Trusted positives and unlabelled web text are bounded samples (`POSITIVES`, `UNLABELLED`). The class
prior of the unlabelled text is estimated from cross-fitted positive-against-unlabelled models as
the least ratio of unlabelled to positive mass above a score. The final model is linear over shape
features and hashed byte trigrams and minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with logistic loss; where the second term would turn negative, its gradient is reversed (Kiryo et
al., 2017). Scores are probabilities of the positive class.

Defined results: null text is scored as an empty one; without positives every score is the prior
1/2; labels that are null, or negative ones, are not used; rows that repeat an id are scored each; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import trigrams
from .learning import bounded, sampled_texts
from .quality_rules import measure
from .textkernel import chunks

POSITIVES, UNLABELLED = 6000, 12000
HASHED = 256
SHAPE = 14


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per document: shares of symbols, repeats and so on, and a hashed trigram profile."""
    m = {k: v.astype(float) for k, v in measure(data, offsets).items()}
    n = len(offsets) - 1
    words, chars, size = np.maximum(1, m["n_words"]), np.maximum(1, m["word_chars"]), np.maximum(1, np.diff(offsets))
    per = lambda flag: np.bincount(np.repeat(np.arange(n), np.diff(offsets)), weights=flag, minlength=n) / size
    symbols, dup, repeat = m["n_symbols"] / chars, m["n_dup_lines"] / np.maximum(1, m["n_lines"]), m["n_repeat_words"] / words
    shape = [
        np.log1p(m["n_words"]) / 5, symbols * 10, np.sqrt(np.minimum(1, symbols)), dup, repeat, (repeat > 0.5).astype(float),
        m["n_upper"] / chars, chars / words / 10, m["n_words"] < 50, per(data == 33) * 20, per((data >= 48) & (data <= 57)) * 10,
        per((data == 44) | (data == 46)) * 10, np.minimum(4, m["n_lines"] / words * 10), per(data == 10) * 20,
    ]
    key = trigrams(np.where((data >= 65) & (data <= 90), data + 32, data)) % HASHED
    doc = np.repeat(np.arange(n), np.diff(offsets))[: len(key)]
    whole = np.arange(len(key)) + 2 < offsets[1:][doc]  # not across two documents
    profile = np.bincount(doc[whole] * HASHED + key[whole], minlength=n * HASHED).reshape(n, HASHED).astype(float)
    profile = np.sqrt(profile / np.maximum(1, profile.sum(1, keepdims=True)))
    return np.concatenate([np.stack(shape, 1), profile], 1).astype(np.float32)


def _collected(rows: DataFrame) -> np.ndarray:
    """Features of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch["text"]):
                yield pa.record_batch({"x": pa.array([x.tobytes() for x in features(data, offsets)], pa.binary())})

    got = rows.select("text").mapInArrow(run, "x binary").toPandas()["x"]
    return np.frombuffer(b"".join(got), np.float32).reshape(len(got), SHAPE + HASHED).astype(float)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Linear:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float) -> None:
        self.mean, self.scale, self.weight, self.bias = mean, scale, weight, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight + self.bias)


def _descend(p: np.ndarray, u: np.ndarray, gradient, rounds: int, l2: float, seed: int = 5) -> tuple[np.ndarray, float]:
    """Adam on (weight, bias); gradient gives d loss / d logit for both samples."""
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        gp, gu = gradient(p @ w[:-1] + w[-1], u @ w[:-1] + w[-1])
        g = np.append(p.T @ gp + u.T @ gu + l2 * w[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least_mass: float = 0.5) -> float:
    """Least ratio of unlabelled to positive mass above a score, among scores that keep enough positives."""
    cuts = np.quantile(positive, np.linspace(0, 1 - least_mass, 40))
    ratio = [(unlabelled >= c).mean() / (positive >= c).mean() for c in cuts]
    return float(np.clip(min(ratio), 0.05, 0.98))


def learn(p: np.ndarray, u: np.ndarray, rounds: int = 400, l2: float = 1e-3) -> tuple[Linear, float]:
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (p, u))
    n, m = len(p), len(u)
    # Cross-fitted: each half is scored by the model of the other, or positives would look too unlike their kin.
    zp, zu = np.zeros(n), np.zeros(m)
    half_p, half_u = np.arange(n) % 2, np.arange(m) % 2
    for h in range(2):
        a, c = p[half_p != h], u[half_u != h]
        if not len(a) or not len(c):
            a, c = p, u
        w, b = _descend(a, c, lambda s, t, k=len(a), j=len(c): ((_sigmoid(s) - 1) / k / 2, _sigmoid(t) / j / 2), rounds // 2, l2)
        zp[half_p == h], zu[half_u == h] = p[half_p == h] @ w + b, u[half_u == h] @ w + b
    prior = class_prior(zp, zu)

    def gradient(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sign = 1.0 if negative >= 0 else -1.0
        towards = prior * (sp - 1) / n if sign > 0 else 0.0
        return towards - sign * prior * sp / n, sign * su / m

    w, b = _descend(p, u, gradient, rounds, l2)
    return Linear(mean, scale, w, b), prior


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, doc_id: str = "doc_id", text: str = "text") -> Linear | None:
    """From training rows only; labels: doc_id, quality. None without both samples."""
    trusted = bounded(labels.where("quality = 1").select("doc_id").distinct(), positives, 1)
    web = bounded(docs.select(F.col(doc_id).alias("doc_id")).distinct(), unlabelled, 2)
    p, u = (_collected(sampled_texts(docs, chosen, doc_id, text)) for chosen in (trusted, web))
    return learn(p, u)[0] if len(p) and len(u) else None


def score(docs: DataFrame, model: Linear | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score for each row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch["text"]):
                s = model.score(features(data, offsets).astype(float)) if model else np.full(j - i, 0.5)
                yield pa.record_batch({"doc_id": batch["doc_id"].slice(i, j - i), "score": pa.array(s)})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
