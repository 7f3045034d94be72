"""Language identification by a mixture over languages, fitted to each document.

Training counts hashed byte trigrams of lower-cased text per language over all training documents;
only the counts (languages x buckets, however many documents) are gathered. A document is a sequence
of units of `UNIT` trigrams, each written in one of several languages. Expectation-maximisation
estimates the languages' proportions from the units' likelihoods; of the nested sets of likely
languages, the one with the best likelihood, less a penalty per language that grows with the
logarithm of the units (BIC), is taken. The prediction is the largest proportion in that set.

Defined results: null text, or text without a letter, is `und` with score 0; so is every text when
there is nothing to learn from; ties go to the first language by code point; rows that repeat an id
are predicted each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import chunks

BUCKETS = 1 << 15
UNIT = 64
ROUNDS = 10
PENALTY = 3.0  # natural log units per language and log(unit); a stray unit is not a second language


def prepared(text: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Lower-cased, with a blank at both ends, so that every letter is in a trigram."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    low = pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), ""))
    return pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), low, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of each three bytes; digits and ASCII punctuation count as blanks."""
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    b = np.where(letter, data, 32).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] * np.uint32(65599 * 65599 & 0xFFFFFFFF) + b[1:-1] * np.uint32(65599) + b[2:]) * np.uint32(2654435761)) >> np.uint32(17)


def count(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, bucket, n) over all rows with a language; summed within tasks, then across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name in pc.unique(batch["lang"]).to_pylist():
                mine = batch["text"].filter(pc.equal(batch["lang"], name))
                into = total.setdefault(name, np.zeros(BUCKETS, np.int64))
                for _, _, data, _ in chunks(prepared(mine)):
                    into += np.bincount(trigrams(data), minlength=BUCKETS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at])})

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log likelihood of each bucket in each language."""

    def __init__(self, languages: list[str], log: np.ndarray) -> None:
        self.languages, self.log = languages, log


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    got = count(docs, lang, text).toPandas()  # languages x BUCKETS rows at most
    languages = sorted(got["lang"].unique(), key=lambda x: x.encode("utf-32-be")) if len(got) else []
    n = np.full((BUCKETS, len(languages)), 0.5)
    if languages:
        n[got["bucket"], [languages.index(x) for x in got["lang"]]] += got["n"]
    return Model(languages, np.log(n / n.sum(0)).astype(np.float32) if languages else np.zeros((BUCKETS, 0), np.float32))


def units(data: np.ndarray, offsets: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, log likelihoods) of each unit, documents in order. Each has a trigram, at least."""
    key = trigrams(data)
    size = np.diff(offsets)
    held = np.maximum(0, size - 2)
    per = -(-held // UNIT)
    doc = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[:-1][doc] + nth * UNIT
    end = np.minimum(start + UNIT, (offsets[1:] - 2)[doc])
    out = np.empty((len(doc), log.shape[1]), np.float32)
    for c in range(log.shape[1]):
        total = np.zeros(len(key) + 1)
        np.cumsum(log[:, c][key], out=total[1:])
        out[:, c] = total[end] - total[start]
    return doc, out


def expectation_maximisation(doc: np.ndarray, ll: np.ndarray, documents: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) per document, among its allowed languages."""
    per = np.bincount(doc, minlength=documents)
    first = np.cumsum(per) - per
    full = per > 0
    p = allowed / np.maximum(1, allowed.sum(1, keepdims=True))
    open_ll = np.where(allowed[doc], ll, -np.inf)
    top = open_ll.max(1, keepdims=True)
    like = np.exp(open_ll - top)
    value = np.zeros(documents)
    for r in range(ROUNDS + 1):
        w = like * p[doc]
        s = w.sum(1, keepdims=True)
        if r == ROUNDS:
            value[full] = np.add.reduceat((np.log(np.maximum(s, 1e-300)) + top)[:, 0], first[full])
            break
        new = np.zeros_like(p)
        new[full] = np.add.reduceat(w / np.maximum(s, 1e-300), first[full], axis=0) / per[full, None]
        p = new
    return p, value


def infer(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(proportions in the selected set, whether there was anything to go by) of each text."""
    n = len(model.languages)
    parts, known = [], []
    for _, _, data, offsets in chunks(prepared(text)):
        documents = len(offsets) - 1
        if not n:
            parts.append(np.zeros((documents, 0)))
            known.append(np.zeros(documents, bool))
            continue
        doc, ll = units(data, offsets, model.log)
        per = np.bincount(doc, minlength=documents)
        p, _ = expectation_maximisation(doc, ll, documents, np.ones((documents, n), bool))
        rank = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1, kind="stable")
        best = np.full(documents, -np.inf)
        chosen = np.zeros((documents, n))
        for k in range(1, n + 1):
            q, value = expectation_maximisation(doc, ll, documents, rank < k)
            value -= k * PENALTY * np.log1p(per)
            better = value > best
            best[better], chosen[better] = value[better], q[better]
        parts.append(chosen)
        known.append(per > 0)
    return (np.concatenate(parts), np.concatenate(known)) if parts else (np.zeros((0, n)), np.zeros(0, bool))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, mixture (language -> proportion above 0) for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = held.value.languages
        for batch in batches:
            p, known = infer(held.value, batch["text"])
            lettered = pc.fill_null(pc.match_substring_regex(batch["text"], r"\p{L}"), False).to_numpy(zero_copy_only=False)
            good = known & lettered
            best = p.argmax(1) if languages else np.zeros(len(p), int)
            names = [languages[b] if g else "und" for b, g in zip(best, good, strict=True)]
            score = np.where(good, p.max(1, initial=0.0), 0.0)
            mixtures = [[(languages[c], float(row[c])) for c in np.flatnonzero(row)] if g else [] for row, g in zip(p, good, strict=True)]
            yield pa.record_batch({"doc_id": batch["doc_id"], "lang_pred": pa.array(names, pa.string()), "score": pa.array(np.clip(score, 0, 1)), "mixture": pa.array(mixtures, pa.map_(pa.string(), pa.float64()))})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, mixture map<string, double>")
