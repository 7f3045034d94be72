"""Toxicity by a convolutional text classifier, trained in numpy.

A word (lower-cased, without ASCII punctuation at its ends) is embedded as the sum of two rows of
hashed tables, so that words which share one row still differ. Filters of widths 1, 2 and 3 run over
the words, each is max-pooled over the whole text, and a logistic layer reads the pooled values.
Embeddings, filters and the layer are trained together with Adam on a bounded sample of labelled
rows: `PER_CLASS` documents of each class, the lowest by a hash of their ids, as far as `MOST_WORDS` words
of each class go, whole texts of any length. The first embedding
column of each table starts at the smoothed log odds of its words in the sample.

Thresholds are calibrated by language on all labelled rows that are not trained on, each class weighed
to its share of all labelled rows: per predicted language the logit is shifted so that the threshold
with the best F1 scores 0.5; languages with few calibration rows take the shift of all. Rows are scored
where they lie, and only counts per (language, logit of 1/64, class) are gathered. The language comes
from the text, by `language_id`.

Scoring multiplies tables and filters once, so that a filter is a sum of looked-up rows.

Defined results: null or blank text pools to zero filters and is scored by the bias; without both
classes every score is 0; labels that are null are no labels; rows that repeat an id are scored each;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import language_id
from .learning import bounded, sampled_texts
from .runtime import cut
from .textkernel import U, chunks, find_words, mix, span_hashes

PER_CLASS = 3000
MOST_WORDS = 4_000_000  # of each class, in the sample that is trained on
ROWS = 1 << 16
DIM = 12
FILTERS = 12
WIDTHS = (1, 2, 3)
EPOCHS = 6
LEAST_FOR_LANGUAGE = 40
STEPS = 64  # of a logit, in calibration

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((n, 2) table rows of the words, where each document's begin)."""
    words = find_words(data, offsets)
    start, end = words.start.copy(), words.end.copy()
    if len(start):
        while True:  # each turn takes one sign off the words that still begin or end with one
            front = (start < end) & _PUNCTUATION[data[np.minimum(start, len(data) - 1)]]
            back = (start < end) & ~front & _PUNCTUATION[data[end - 1]]
            if not (front.any() or back.any()):
                break
            start += front
            end -= back
    filled = start < end
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    h = span_hashes(low, start[filled], end[filled]) if len(data) else np.zeros(0, U)
    kept = np.concatenate([[0], np.cumsum(filled)])
    other = mix(h + U(0x5851F42D))
    return np.stack([h % U(ROWS), other % U(ROWS)], 1).astype(np.int32), kept[words.first]


class Network:
    def __init__(self, tables: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, weight: np.ndarray, offset: float) -> None:
        self.tables, self.filters, self.bias, self.weight, self.offset = tables, filters, bias, weight, offset
        self.shift: dict[str, float] = {}
        self.common = 0.0

    def compiled(self) -> np.ndarray:
        """(2, rows, all filter positions): what each table row adds to each filter at each place in it."""
        flat = np.concatenate([f.reshape(w * DIM, FILTERS).reshape(w, DIM, FILTERS).transpose(1, 0, 2).reshape(DIM, w * FILTERS) for w, f in zip(WIDTHS, self.filters, strict=True)], 1)
        return (self.tables @ flat).astype(np.float32)

    def logits(self, table: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        if len(rows):
            size = np.diff(first)
            at = 0
            for k, w in enumerate(WIDTHS):
                total = None
                for j in range(w):
                    part = table[0][rows[:, 0], at : at + FILTERS] + table[1][rows[:, 1], at : at + FILTERS]
                    at += FILTERS
                    if j == 0:
                        total = part
                    else:
                        total[: len(total) - j] += part[j:]
                total += self.bias[k]
                np.maximum(total, 0, out=total)
                place = np.arange(len(rows))
                total[place + w > np.repeat(first[1:], size)] = 0  # a filter stays within its document
                full = size > 0
                pooled[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(total, first[:-1][full], axis=0)
        return pooled @ self.weight + self.offset


def _log_odds(docs: list[np.ndarray], y: np.ndarray, column: int) -> np.ndarray:
    counts = np.zeros((2, ROWS))
    for rows, label in zip(docs, y, strict=True):
        counts[int(label), np.unique(rows[:, column])] += 1
    rate = (counts + 2.0) / (np.array([[(y == 0).sum()], [(y == 1).sum()]]) + 4.0)
    return np.clip(np.log(rate[1] / rate[0]) * (counts.sum(0) >= 4), -4, 4) / 4


def train(docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    tables = rng.normal(0, 0.05, (2, ROWS, DIM)).astype(np.float32)
    for c in range(2):
        tables[c, :, c] = _log_odds(docs, y, c)
    filters = [rng.normal(0, 0.2 / np.sqrt(w), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w, f in zip(WIDTHS, filters, strict=True):
        for j in range(w):
            f[j * DIM : j * DIM + 2] += 0.5 / w
    bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
    weight = rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32) + 0.1
    net = Network(tables, filters, bias, weight, -1.0)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (*filters, bias, weight)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for s in range(0, len(order), 32):
            batch = order[s : s + 32]
            grads = [np.zeros_like(p) for p in (*filters, bias, weight)]
            to_offset = 0.0
            touched: list[tuple[np.ndarray, np.ndarray]] = []
            for i in batch:
                rows = docs[i]
                e = tables[0][rows[:, 0]] + tables[1][rows[:, 1]]
                pooled = np.zeros(len(WIDTHS) * FILTERS, np.float32)
                where = []
                for k, w in enumerate(WIDTHS):
                    n = len(e) - w + 1
                    if n <= 0:
                        where.append(None)
                        continue
                    x = e if w == 1 else np.concatenate([e[j : j + n] for j in range(w)], 1)
                    z = x @ filters[k] + bias[k]
                    top = z.argmax(0)
                    value = z[top, np.arange(FILTERS)]
                    pooled[k * FILTERS : (k + 1) * FILTERS] = np.maximum(0, value)
                    where.append((x[top], top))
                d = 1 / (1 + np.exp(-np.clip(pooled @ weight + net.offset, -30, 30))) - y[i]
                grads[-1] += d * pooled
                to_offset += d
                back = d * weight * (pooled > 0)
                for k, w in enumerate(WIDTHS):
                    if where[k] is None:
                        continue
                    x, top = where[k]
                    g = back[k * FILTERS : (k + 1) * FILTERS]
                    grads[k] += x.T * g
                    grads[-2][k] += g
                    to_words = (filters[k] * g).T.reshape(FILTERS, w, DIM)
                    for j in range(w):
                        touched.append((rows[top + j], to_words[:, j]))
            step += 1
            size = len(batch)
            for p, g, (m, v) in zip((*filters, bias, weight), grads, state, strict=True):
                g = g / size
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
            net.offset -= 0.01 * to_offset / size
            if touched:
                at = np.concatenate([t[0] for t in touched])
                g = np.concatenate([t[1] for t in touched]) * (0.3 / size)
                for c in range(2):
                    np.subtract.at(tables[c], at[:, c], g)
    return net


def _best_shift(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit threshold with the best F1; in the middle of the gap that it lies in."""
    order = np.argsort(-logit, kind="stable")
    z, w = logit[order], weight[order]
    hit = np.cumsum(w * y[order])
    f1 = 2 * hit / (np.cumsum(w) + hit[-1])
    f1[:-1][z[:-1] == z[1:]] = -1
    best = int(np.argmax(f1))
    below = z[best + 1] if best + 1 < len(z) else z[best] - 1
    return float((z[best] + below) / 2)


def calibrate(net: Network, seen: DataFrame, labels: DataFrame, used: DataFrame, languages: language_id.Model) -> None:
    """Sets the shifts from `logits` of training rows; labels: doc_id, toxic; used: ids that were trained on, a bounded number."""
    known = labels.where("toxic is not null").select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    rows = seen.join(known, "doc_id").join(F.broadcast(used.distinct().withColumn("used", F.lit(True))), "doc_id", "left")
    place = F.floor(F.greatest(F.lit(-64.0), F.least(F.lit(64.0), "logit")) * STEPS).cast("int").alias("place")
    got = rows.groupBy("spoken", place, "toxic").agg(F.count("*").alias("all"), F.count_if(F.col("used").isNull()).alias("n")).toPandas()
    y, n = got["toxic"].to_numpy(float), got["n"].to_numpy(float)
    share = np.array([got["all"][y == c].sum() / max(1.0, n[y == c].sum()) for c in (0, 1)])
    some, logit, weight = n > 0, (got["place"].to_numpy(float) + 0.5) / STEPS, n * share[y.astype(int)]

    def shift(mine: np.ndarray) -> float:
        return _best_shift(logit[mine], y[mine], weight[mine])

    net.common = shift(some) if 0 < (n * y).sum() < n.sum() else 0.0
    for i, name in enumerate(languages.languages):
        mine = some & (got["spoken"].to_numpy() == i)
        if n[mine].sum() >= LEAST_FOR_LANGUAGE and 5 <= (n * y)[mine].sum() < n[mine].sum():
            net.shift[name] = shift(mine)


def _sample(rows: DataFrame, most_words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Word rows, labels and ids of a bounded sample of documents: of each class in the order of the hash of
    their ids, until the words are used up; its first document in any case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch["text"]):
                at, first = word_rows(data, offsets)
                packed = [at[first[r] : first[r + 1]].tobytes() for r in range(j - i)]
                yield pa.record_batch({"doc_id": batch["doc_id"].slice(i, j - i), "toxic": batch["toxic"].slice(i, j - i), "words": pa.array(packed, pa.binary())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    coded = cut(rows.select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {kind}, toxic int, words binary"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")  # a class of the bounded sample
    used = F.sum(F.octet_length("words").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = coded.select("doc_id", "toxic", F.octet_length("words").alias("size"), used.alias("used"), F.row_number().over(order).alias("nth")).where((F.col("used") <= 8 * most_words) | (F.col("nth") == 1))
    got = coded.join(F.broadcast(within.select("doc_id").distinct()), "doc_id", "left_semi").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    return [np.frombuffer(x, np.int32).reshape(-1, 2) for x in got["words"]], got["toxic"].to_numpy(float), got["doc_id"].to_numpy()


def fit_weights(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text", most_words: int = MOST_WORDS
) -> tuple[Network, DataFrame] | None:
    """The network without thresholds, and the ids (doc_id) that it was trained on; None without both classes."""
    known = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = bounded(known.where("toxic = 1"), per_class, 3).unionByName(bounded(known.where("toxic = 0"), per_class, 4))
    texts = sampled_texts(docs, chosen, doc_id, text)
    words, y, ids = _sample(texts, most_words)
    if not 0 < y.sum() < len(y):
        return None
    held = np.arange(len(y)) % 4 == 3
    net = train([w for w, h in zip(words, held, strict=True) if not h], y[~held])
    return net, docs.sparkSession.createDataFrame([(i,) for i in ids[~held].tolist()], f"doc_id {texts.schema['doc_id'].dataType.simpleString()}")


def fit(docs: DataFrame, labels: DataFrame, languages: language_id.Model, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> Network | None:
    """From training rows only; labels: doc_id, toxic. None without both classes."""
    fitted = fit_weights(docs, labels, per_class, doc_id, text)
    if fitted is None:
        return None
    calibrate(fitted[0], logits(docs, fitted[0], languages, doc_id, text), labels, fitted[1], languages)
    return fitted[0]


def logits(docs: DataFrame, net: Network, languages: language_id.Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, logit before any shift, spoken (place of the predicted language; after the last: none) for each row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast((net, languages))  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, languages = held.value
        table = net.compiled()
        names = languages.languages
        for batch in batches:
            for i, j, data, offsets in chunks(batch["text"]):
                rows, first = word_rows(data, offsets)
                p, known = language_id.infer(languages, batch["text"].slice(i, j - i))
                spoken = np.where(known, p.argmax(1), len(names)) if names else np.zeros(j - i, int)
                yield pa.record_batch({"doc_id": batch["doc_id"].slice(i, j - i), "logit": pa.array(net.logits(table, rows, first).astype(float)), "spoken": pa.array(spoken.astype(np.int32))})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, logit double, spoken int")


def shifted(seen: DataFrame, net: Network, languages: language_id.Model) -> DataFrame:
    """doc_id, score of rows of `logits`."""
    shift = F.get(F.lit(np.array([net.shift.get(x, net.common) for x in languages.languages] + [net.common])), F.col("spoken"))
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit") - shift))
    return seen.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def score(docs: DataFrame, net: Network | None, languages: language_id.Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score for each row of docs; 0.5 is the language's threshold."""
    if net is None:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score"))
    return shifted(logits(docs, net, languages, doc_id, text), net, languages)
