"""Quality rules whose cutoffs are controlled for false rejection on labelled holdouts.

Each rule compares one measure of a document with a cutoff. The cutoffs of all rules tighten along
one path of steps (a rule, a bin), made from a quarter of the labelled documents (by a hash of their
ids): the steps that reject most bad documents for a good one come first. The other three quarters
test the path, per stratum (language): going along it, a step stays admissible while the
Clopper-Pearson upper bound on the share of good documents that *any* rule rejects is within the
risk. That is a fixed sequence, so the rules need no correction; a Bonferroni one is made over the
strata and their pool. Among admissible steps the one that rejects most bad documents, each good one
weighed `price` times, is taken. With probability 1 - delta at least, the false rejection of every
stratum tested by itself, and that of the pool, is within `risk`.

A stratum with fewer than log(delta / (strata + 1)) / log(1 - risk) good test documents could not
pass even without a rejection (459 with four strata, so about 612 good labelled ones). It takes the
step of the pool, or the first one from there back that rejects no more than `risk` of its own good
test documents; the risk then holds for the pool of all strata, not for it alone. So does a stratum
without labels. Where the pool is too small as well, no rule fires.

Features are computed once, in one pass. Holdout counts are histograms, (rule, bin) for the path and
(stratum, step) for the tests, summed before any shuffle; their size depends on neither the documents
nor a hot stratum.

Defined results: null text has no words and fails the base rule; null strata and empty ones are one
stratum; documents that repeat are judged alike; labels that are null are no labels; without labels
the method keeps what the base rule keeps; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, small
from .textkernel import chunks, find_words, grams, inside, mix, span_hashes

U = np.uint64
# The bytes of `[#*$%&|<>]`.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
# Rules: a share in [0, 1] each; higher is worse.
RULES = {
    "symbols": "least(1D, try_divide(n_symbols, word_chars))",
    "dup_lines": "try_divide(n_dup_lines, n_lines)",
    "repeats": "try_divide(n_repeat_words, n_words)",
    "upper": "least(1D, try_divide(n_upper, word_chars))",
    "long_words": "least(1D, try_divide(word_chars, n_words) / 40)",
    "short_words": "1 - least(1D, try_divide(word_chars, n_words) / 40)",
}
BINS = 400


def _per_doc(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys within rows: which occur twice or more, and which are not their first."""
    key = mix(key + mix(row.astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    again, later = np.zeros(len(s), bool), np.zeros(len(s), bool)
    again[1:] |= same
    later[1:] = same
    again[:-1] |= same
    twice, rest = np.empty(len(s), bool), np.empty(len(s), bool)
    twice[order], rest[order] = again, later
    return twice, rest


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = find_words(data, offsets)
    doc = words.doc()
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
    chars = letters[words.end] - letters[words.start]

    h = words.hashes()
    ok = np.flatnonzero(inside(words.first, 3))
    twice, _ = _repeats(grams(h, 3, 31)[ok], doc[ok])
    cover = np.zeros(len(h) + 3, np.int64)
    hit = ok[twice]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 3, -1)

    breaks = np.flatnonzero(data == 10)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    start = np.concatenate([offsets[:-1][filled], breaks + 1])
    end = np.concatenate([offsets[1:][filled], breaks])
    start, end = np.sort(start), np.sort(end)
    with_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[with_word], end[with_word]
    line_doc = np.searchsorted(offsets, start, side="right") - 1
    _, later = _repeats(span_hashes(data, start, end), line_doc)

    n = len(offsets) - 1
    return {
        "n_words": np.diff(words.first),
        "word_chars": np.bincount(doc, weights=chars, minlength=n).astype(np.int64),
        "n_symbols": _per_doc(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_doc[later], minlength=n),
        "n_repeat_words": np.bincount(doc[np.cumsum(cover)[: len(h)] > 0], minlength=n),
        "n_lines": np.bincount(line_doc, minlength=n),
        "n_upper": _per_doc((data >= 65) & (data <= 90), offsets),
    }


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str | None = "lang") -> DataFrame:
    """doc_id, stratum and the counts of each row of docs."""
    which = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum and stratum in docs.columns else F.lit("")
    rows = docs.select(F.col(doc_id).alias("doc_id"), which.alias("stratum"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch["text"]):
                got = measure(data, offsets)
                yield pa.record_batch([batch["doc_id"].slice(i, j - i), batch["stratum"].slice(i, j - i), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", "stratum", *COUNTS])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def _log_choose(n: int) -> np.ndarray:
    fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    return fact[n] - fact - fact[::-1]


def binomial_tail(n: int, p: float) -> np.ndarray:
    """P(X <= k) for k = 0..n under n trials at rate p, exactly."""
    k = np.arange(n + 1)
    terms = _log_choose(n) + k * np.log(p) + (n - k) * np.log1p(-p)
    return np.minimum(1.0, np.cumsum(np.exp(terms)))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, delta: float, price: float) -> float | None:
    """Reject when the bin is at or above the result. good, bad: holdout documents per bin.

    The upper Clopper-Pearson bound of k in n at delta is within the risk exactly when
    P(Binomial(n, risk) <= k) <= delta, which is what is tested.
    """
    n = int(good.sum())
    if not n:
        return None
    tail = binomial_tail(n, risk)
    rejected_good, rejected_bad = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    best, cutoff = 0.0, None
    for b in range(len(good) - 1, 0, -1):
        if tail[int(rejected_good[b])] > delta:
            break
        worth = rejected_bad[b] - price * rejected_good[b]
        if worth > best:
            best, cutoff = worth, b
    return cutoff


CUTOFF = "stratum string, " + ", ".join(f"cut_{r} int" for r in RULES)


def reject_path(good: np.ndarray, bad: np.ndarray, price: float) -> list[tuple[int, int]]:
    """Steps (rule, bin), best first, each lowering one rule's cutoff. good, bad: (rules, bins) documents.

    A rule's steps follow the concave hull of bad against good documents rejected, as far as they are
    worth the price; those of the rules are merged by their ratio.
    """
    parts, bins = [], []
    for g, b in zip(good, bad, strict=True):
        g, d = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (g, b))
        at = [int(x) for x in np.flatnonzero(b)[::-1] if x]
        hull = [len(b)]
        for x in at:
            while len(hull) > 1 and (d[x] - d[hull[-1]]) * (g[hull[-1]] - g[hull[-2]]) >= (d[hull[-1]] - d[hull[-2]]) * (g[x] - g[hull[-1]]):
                hull.pop()
            hull.append(x)
        gains = [(low, top, d[low] - d[top], g[low] - g[top]) for top, low in zip(hull, hull[1:])]
        parts.append([(low, top, more / (lost + 0.5)) for low, top, more, lost in gains if more > price * lost])
        bins.append(at)
    steps: list[tuple[int, int]] = []
    heads = [(-p[0][2], r, 0) for r, p in enumerate(parts) if p]
    heapq.heapify(heads)
    while heads:
        _, r, i = heapq.heappop(heads)
        low, top, _ = parts[r][i]
        steps += [(r, x) for x in bins[r] if low <= x < top]
        if i + 1 < len(parts[r]):
            heapq.heappush(heads, (-parts[r][i + 1][2], r, i + 1))
    return steps


def path_levels(steps: list[tuple[int, int]], rules: int) -> np.ndarray:
    """(rules, bins): the level at which a rule rejects a bin, the first step's being the highest; 0: never."""
    levels = np.zeros((rules, BINS + 1), np.int32)
    for i, (r, x) in enumerate(steps):
        mine = levels[r, x:]
        mine[mine == 0] = len(steps) - i
    return levels


def learn_cutoffs(counted: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05, price: float = 10.0) -> DataFrame:
    """One row per stratum of counted, with a bin per rule (null: never fires). labels: doc_id, quality."""
    known = labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    plans = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(4)) == 0
    held = cut(counted.where(~base_failed()).join(known, "doc_id").select("stratum", (F.col("quality") == 1).alias("is_good"), plans.alias("plans"), *(_bin(r).alias(r) for r in RULES)))
    sums = (F.count_if("is_good").alias("good"), F.count_if(~F.col("is_good")).alias("bad"))

    each = F.explode(F.array(*(F.struct(F.lit(i).alias("rule"), F.col(r).alias("bin")) for i, r in enumerate(RULES)))).alias("b")
    planned = held.where("plans").select("is_good", each).groupBy("b.rule", "b.bin").agg(*sums).toPandas()  # rules x bins at most
    good, bad = np.zeros((2, len(RULES), BINS + 1), np.int64)
    good[planned["rule"], planned["bin"]], bad[planned["rule"], planned["bin"]] = planned["good"], planned["bad"]
    steps = reject_path(good, bad, price)
    levels = path_levels(steps, len(RULES))

    level = F.greatest(*(F.get(F.lit(levels[i]), F.col(r)) for i, r in enumerate(RULES)))
    counts = cut(held.where(~F.col("plans")).groupBy("stratum", level.alias("level")).agg(*sums))
    share = delta / (counts.select("stratum").distinct().count() + 1)
    pool = counts.groupBy("level").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas()  # steps at most

    def histograms(part: pd.DataFrame) -> list[np.ndarray]:
        part = part[part["level"].notna()]
        return [np.bincount(part["level"].astype(int), weights=part[c].astype(float), minlength=len(steps) + 1) for c in ("good", "bad")]

    pooled = choose_cutoff(*histograms(pool), risk, share, price)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        good, bad = histograms(part)
        if (1 - risk) ** good.sum() <= share:
            at = choose_cutoff(good, bad, risk, share, price)
        else:
            at = pooled
            while at is not None and good[at:].sum() > risk * good.sum():
                at = at + 1 if at < len(steps) else None
        fires = levels >= (len(steps) + 1 if at is None else at)
        row = {"stratum": part["stratum"].iloc[0]} | {f"cut_{r}": int(f.argmax()) if f.any() else None for r, f in zip(RULES, fires, strict=True)}
        return pd.DataFrame([row]).astype({f"cut_{r}": "Int32" for r in RULES})

    return counted.select("stratum").distinct().join(counts, "stratum", "left").groupBy("stratum").applyInPandas(one, CUTOFF)


def _bin(rule: str):
    return F.floor(F.coalesce(F.expr(RULES[rule]), F.lit(0.0)) * BINS).cast("int")


def base_failed():
    """Fixed rule of the contract."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judge(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str | None = "lang", risk: float = 0.01, delta: float = 0.05, price: float = 10.0
) -> DataFrame:
    """doc_id, the counts, base_failed, reasons (rules that fired) and kept for each row of docs."""
    counted = cut(features(docs, doc_id, text, stratum))
    cutoffs = learn_cutoffs(counted, labels, risk, delta, price)
    fired = F.array_compact(F.array(*(F.when(_bin(r) >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES)))
    out = counted.join(small(cut(cutoffs)), "stratum", "left").withColumn("base_failed", base_failed()).withColumn("reasons", fired)
    return out.select("doc_id", *COUNTS, "base_failed", "reasons", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", **options) -> DataFrame:
    """The rows of docs that are kept. Texts are measured where they lie, once for the cutoffs and once to
    be judged, and never shuffled; only counts meet labels."""
    known = labels.select("doc_id", "quality")
    cutoffs = small(cut(learn_cutoffs(cut(features(docs, doc_id, text, stratum)), known, **options)))
    which = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    row = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"), which.alias("stratum"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch["text"]):
                got = measure(data, offsets)
                yield pa.record_batch([batch["row"].slice(i, j - i), batch["stratum"].slice(i, j - i), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["row", "stratum", *COUNTS])

    judged = row.mapInArrow(run, f"row {row.schema['row'].dataType.simpleString()}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))
    judged = judged.join(cutoffs, "stratum", "left")
    fires = F.coalesce(F.greatest(*(_bin(r) >= F.col(f"cut_{r}") for r in RULES)), F.lit(False))
    return judged.where(~base_failed() & ~fires).select("row.*")
