"""Aspect extraction, clause context and lexicon sentiment of a review, and their composition.

The lexicon works in the JVM. Extraction and clauses need look-around and overlap rules on code
points; they are Arrow UDFs over whole batches. Extraction reads a text once, by one automaton of all aliases.
"""

from __future__ import annotations

import bisect
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ontology
from .text import alias_key, slice_text

# The lexicon. A contracted negation never fires, because tokens end before its apostrophe's n.
POSITIVE = ("amazing", "excellent", "great", "good", "love", "loved", "gorgeous", "sharp", "fast", "reliable", "wonderful")
NEGATIVE = ("terrible", "bad", "poor", "hate", "hated", "awful", "slow", "weak", "worse", "broken", "barely", "disappointing")
NEGATIONS = ("not", "never", "no", "isn't", "isnt", "wasn't", "wasnt", "hardly")

SPAN = "array<struct<raw_aspect:string,start_char:int,end_char:int,confidence:double>>"


def longest_first(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans kept greedily by length, none overlapping an earlier choice; in order of place."""
    kept: list[tuple[int, int]] = []
    for a, b in sorted(set(found), key=lambda s: (s[0] - s[1], s)):
        at = bisect.bisect_left(kept, (a, b))  # the spans kept so far do not overlap, so only its neighbours can
        if (not at or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
            kept.insert(at, (a, b))
    return kept


class Aliases:
    """All places of some phrases as whole words, whatever their case, by one Aho-Corasick automaton.

    Letters are folded one by one, so that places are those of the text: to the letter of a phrase that a pattern
    without regard to case would match with them.
    """

    def __init__(self, phrases: tuple[str, ...]) -> None:
        import ahocorasick

        letters = sorted({c.lower() if len(c.lower()) == 1 else c for p in phrases for c in p})
        cased = [x for x in map(chr, range(0x1FFFF)) if x.lower() != x or x.upper() != x]
        self.folds: dict[int, str] = {}
        for c in letters:
            same = re.compile(re.escape(c), re.IGNORECASE).fullmatch
            self.folds |= {ord(x): c for x in cased if ord(x) not in self.folds and same(x)}
        self.automaton = ahocorasick.Automaton()
        for p in phrases:
            if p:
                self.automaton.add_word(self.fold(p), len(p))
        self.automaton.make_automaton()

    def fold(self, text: str) -> str:
        return text.lower() if text.isascii() else text.translate(self.folds)

    def places(self, text: str) -> list[tuple[int, int]]:
        """Spans of each phrase, from left to right without overlap of a phrase with itself."""
        found, ends = [], {}
        n, low = len(text), self.fold(text)
        for last, size in self.automaton.iter(low):
            a, b = last + 1 - size, last + 1
            if (a and (text[a - 1].isalnum() or text[a - 1] == "_")) or (b < n and (text[b].isalnum() or text[b] == "_")):
                continue
            phrase = low[a:b]
            if a >= ends.get(phrase, 0):
                ends[phrase] = b
                found.append((a, b))
        return found


@functools.cache
def aliases(phrases: tuple[str, ...]) -> Aliases:
    """Built once in a worker's life."""
    return Aliases(phrases)


def extract_aspects(x: Column, terms: tuple[str, ...] | None = None, confidence: float = 0.80) -> Column:
    """Aliases as whole words, whatever their case; where they overlap the longest stays."""
    words = terms or tuple(alias for a in ontology.ASPECTS for alias in a[2])
    span = pa.struct([("raw_aspect", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("confidence", pa.float64())])

    @F.arrow_udf(SPAN)
    def run(texts: pa.Array) -> pa.Array:
        known = aliases(words)
        raw, start, end, sizes = [], [], [], []
        for text in texts.to_pylist():
            found = known.places(text) if text is not None else []
            kept = longest_first(found) if len(found) > 1 else found
            sizes.append(len(kept))
            for a, b in kept:
                raw.append(text[a:b])
                start.append(a)
                end.append(b)
        columns = [pa.array(raw, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(np.full(len(raw), confidence))]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(span)), mask=texts.is_null())

    return run(x)


def merge_windows(x: Column, candidates: Column) -> Column:
    """Candidates of overlapping model windows: those far from a window's edge, then the more confident, win.

    candidates: array<struct<start_char, end_char, confidence, boundary_margin, window_index>>.
    """
    c = F.filter(candidates, lambda k: F.trim(slice_text(x, k["start_char"], k["end_char"])) != "")
    bad = F.exists(candidates, lambda k: ~((k["start_char"] >= 0) & (k["start_char"] < k["end_char"]) & (k["end_char"] <= F.length(x))))
    keyed = F.array_sort(F.transform(c, lambda k: F.struct((-k["boundary_margin"]).alias("m"), (-k["confidence"]).alias("c"), k["window_index"].alias("w"), k["start_char"].alias("start_char"), k["end_char"].alias("end_char"))))
    empty = F.array().cast("array<struct<start_char:int,end_char:int,confidence:double>>")

    def step(acc: Column, k: Column) -> Column:
        clash = F.exists(acc, lambda o: (k["start_char"] < o["end_char"]) & (k["end_char"] > o["start_char"]))
        item = F.struct(k["start_char"].cast("int").alias("start_char"), k["end_char"].cast("int").alias("end_char"), F.round(-k["c"].cast("double"), 4).alias("confidence"))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(item)))

    return F.when(bad, F.raise_error(F.lit("span outside the source review"))).otherwise(F.array_sort(F.aggregate(keyed, empty, step)))


CLAUSE = pa.struct([("context", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32())])
# What ends a clause, and the titles whose full stop does not.
BORDER = re.compile(r"\b(?:but|however|although|while)\b|[.!?]+(?=\s|$)", re.IGNORECASE)
TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr)\.$", re.IGNORECASE)


def _clauses(text: str) -> list[tuple[int, int]]:
    """Where the clauses of a text are, the last one included."""
    out, low = [], 0
    for m in BORDER.finditer(text):
        if m.group()[0] == "." and TITLE.search(text, max(0, m.end() - 8), m.end()):
            continue
        out.append((low, m.start()))
        low = m.end()
    return [*out, (low, len(text))]


@F.arrow_udf(T.StructType([T.StructField("context", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]))
def clause_context(text: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
    """The clause that holds a span, trimmed, with its offsets; the whole text if none does.

    Clauses end at but, however, although and while, and at sentence ends other than after a title. The mentions of a text
    follow each other, so it is cut into clauses once.
    """
    contexts, starts, ends = [], [], []
    last, clauses = None, []
    for t, s, e in zip(text.to_pylist(), start.to_pylist(), end.to_pylist(), strict=True):
        if t is None or s is None or e is None:
            chosen = (None, None, None)
        else:
            if t != last:
                last, clauses = t, _clauses(t)
            chosen = (t, 0, len(t))
            for low, high in clauses:
                if low <= s and e <= high:
                    part = t[low:high]
                    if kept := part.strip():
                        at = low + len(part) - len(part.lstrip())
                        chosen = (kept, at, at + len(kept))
                    break
        contexts.append(chosen[0])
        starts.append(chosen[1])
        ends.append(chosen[2])
    return pa.StructArray.from_arrays([pa.array(contexts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(CLAUSE))


def _once(value: Column, body) -> Column:
    """body(value), where the value is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lexicon_sentiment(x: Column) -> Column:
    """struct<label, confidence, probabilities> of a text: lexicon words, turned by a negation within three tokens before."""
    words = lambda w: F.array(*(F.lit(v) for v in w))
    tokens = F.regexp_extract_all(F.lower(x), F.lit("[a-z]+(?:n't)?"), F.lit(0))

    def polarity(t: Column, token: Column, i: Column) -> Column:
        before = F.slice(t, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
        negated = (i > 0) & F.arrays_overlap(before, words(NEGATIONS))
        good, bad = F.array_contains(words(POSITIVE), token), F.array_contains(words(NEGATIVE), token)
        return F.when(~good & ~bad, 0).when(good != F.coalesce(negated, F.lit(False)), 1).otherwise(-1)

    def judged(c: Column) -> Column:
        pos, neg = c["pos"], c["neg"]
        label = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")
        count = F.when(pos != neg, F.greatest(pos, neg)).otherwise(0)
        return F.struct(label.alias("label"), F.when(count > 0, F.least(F.lit(0.99), F.lit(0.60) + F.lit(0.12) * count)).otherwise(F.lit(0.50)).alias("sure"))

    many = lambda s, v: F.size(F.filter(s, lambda x: x == v))
    counts = _once(_once(tokens, lambda t: F.transform(t, lambda token, i: polarity(t, token, i))), lambda s: F.struct(many(s, 1).alias("pos"), many(s, -1).alias("neg")))
    found = _once(counts, judged)
    label, sure = found["label"], found["sure"]
    spread = F.create_map(*(v for s in ontology.SENTIMENTS for v in (F.lit(s), F.when(label == s, sure).otherwise((1 - sure) / 2))))
    return F.struct(label.alias("label"), F.round(sure, 4).alias("confidence"), spread.alias("probabilities"))


def normalize_alias(raw: Column, context: Column | None = None) -> Column:
    """struct<id, label, method, similarity, is_unknown> by exact alias. `charge` alone says nothing about charging."""
    key = alias_key(raw)
    pairs = {alias: a[0] for a in ontology.ASPECTS for alias in a[2]}
    found = F.when((key != "") & (key != "charge"), F.try_element_at(F.create_map(*(F.lit(v) for p in pairs.items() for v in p)), key))
    return F.struct(
        found.alias("id"),
        ontology.label_of(found).alias("label"),
        F.when(found.isNotNull(), "alias").otherwise("unknown").alias("method"),
        F.when(found.isNotNull(), F.lit(1.0)).alias("similarity"),
        found.isNull().alias("is_unknown"),
    )


def analyze(reviews: DataFrame, text: str = "review_text", policy: str = "local_clause") -> DataFrame:
    """A row per mention: reviews' columns, ordinal, span, canonical aspect, sentiment, context, tag, confidence."""
    if policy not in ("local_clause", "full_review"):
        raise ValueError(f"unknown sentiment context policy: {policy}")
    rows = reviews.select("*", F.posexplode(extract_aspects(F.col(text))).alias("ordinal", "a"))
    whole = F.struct(F.col(text).alias("context"), F.lit(0).alias("start_char"), F.length(text).alias("end_char"))
    context = whole if policy == "full_review" else clause_context(F.col(text), F.col("a.start_char"), F.col("a.end_char"))
    rows = rows.withColumn("c", context).withColumn("s", lexicon_sentiment(F.col("c.context"))).withColumn("n", normalize_alias(F.col("a.raw_aspect"), F.col(text)))
    return rows.select(
        *(F.col(c) for c in reviews.columns),
        "ordinal",
        "a.raw_aspect",
        "a.start_char",
        "a.end_char",
        F.col("n.label").alias("normalized_aspect"),
        F.col("n.id").alias("normalized_aspect_id"),
        F.col("n.method").alias("normalization_method"),
        F.col("n.similarity").alias("similarity"),
        F.col("s.label").alias("sentiment"),
        F.least("a.confidence", "s.confidence").alias("confidence"),
        F.col("a.confidence").alias("aspect_confidence"),
        F.col("s.confidence").alias("sentiment_confidence"),
        F.col("s.probabilities").alias("probabilities"),
        F.col("c.start_char").alias("context_start_char"),
        F.col("c.end_char").alias("context_end_char"),
        ontology.tag_of(F.col("n.id"), F.col("s.label")).alias("tag"),
    )
