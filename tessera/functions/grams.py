"""Words and word pairs of texts: how often each stands in a table, and each text's own counts as a sparse vector.

A text is read once for either, in Arrow batches; words are numbered, so that pairs are numbers that numpy sorts.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import cut

# What a task holds at once: words whose pairs it counts, and rows whose vectors it makes.
WORDS_AT_ONCE, ROWS_AT_ONCE = 1_000_000, 1000
LAST_WORD = (1 << 32) - 1

_PYTHONS = re.compile(r"\w{2,}")
_CATEGORIES = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Me", "Mc", "Nd", "Pc"))
_JOINERS_AND_CIRCLED = frozenset((0x200C, 0x200D, *range(0x24B6, 0x24EA), *range(0x1F130, 0x1F14A), *range(0x1F150, 0x1F16A), *range(0x1F170, 0x1F18A)))


def _in_word(point: int) -> bool:
    r"""Whether Java's \w has a code point in Unicode mode; Python's has no marks, but numbers like ½."""
    return unicodedata.category(chr(point)) in _CATEGORIES or point in _JOINERS_AND_CIRCLED


@functools.cache
def _odd() -> re.Pattern[str]:
    """Finds characters on which the two may differ: all beyond the first plane are looked at."""
    return re.compile("[" + "".join(re.escape(chr(p)) for p in range(0x10000) if _in_word(p) != (chr(p).isalnum() or p == 0x5F)) + "\U00010000-\U0010ffff]")


@functools.cache
def _javas() -> re.Pattern[str]:
    return re.compile("[" + "".join(re.escape(chr(p)) for p in range(0x110000) if _in_word(p)) + "]{2,}")


def words(text: str) -> list[str]:
    r"""The lower-cased words of two characters and more, as Java's (?U)\b\w\w+\b finds them; Python says what the newest characters are."""
    low = text.lower()
    return (_PYTHONS if low.isascii() or not _odd().search(low) else _javas()).findall(low)


def counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """gram, n: how often each word, and each pair of words that follow each other in a text, stands in all texts."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for t in batch.column(0):
                found = words(t.as_py() or "")
                held.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                size += len(found)
                if size >= WORDS_AT_ONCE:
                    yield _summed(list(numbers), held)
                    numbers.clear()
                    held, size = [], 0
        if size:
            yield _summed(list(numbers), held)

    return rows.select(text).mapInArrow(partial, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _summed(names: list[str], held: list[np.ndarray]) -> pa.RecordBatch:
    """gram, n of texts as the numbers of their words."""
    name = pa.array(names, pa.string())
    pair, n = np.unique(np.concatenate([(c[:-1] << 32) | c[1:] for c in held]), return_counts=True)
    joined = pc.binary_join_element_wise(name.take(pa.array(pair >> 32)), name.take(pa.array(pair & LAST_WORD)), " ")
    single = np.bincount(np.concatenate(held), minlength=len(names))
    return pa.RecordBatch.from_arrays([pa.concat_arrays([name, joined]), pa.array(np.concatenate([single, n]), pa.int64())], ["gram", "n"])


def common(rows: DataFrame, text: str = "text", most: int = 50_000) -> list[str]:
    """The most frequent grams, `most` of them or all; of equally frequent ones the first by code points."""
    first = cut(counts(rows, text).orderBy(F.desc("n"), "gram").limit(most))  # cut: the shuffle files of all grams go at once
    return [r.gram for r in first.orderBy(F.desc("n"), "gram").collect()]


def damped(rows: DataFrame, grams: Sequence[str], text: str = "text", out: str = "damped") -> DataFrame:
    """Adds a sparse vector: 1 + ln k at each of `grams` that stands k times in the text."""
    from pyspark.ml.linalg import VectorUDT

    if not grams:
        raise ValueError("no grams")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(grams)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([*part.columns, lookup.vectors(part.column(part.schema.get_field_index(text)))], [*part.schema.names, out])

    return rows.mapInArrow(vectors, StructType([*rows.schema, StructField(out, VectorUDT())]))


class _Lookup:
    """Places of grams, by numbers of their words and by pairs of such numbers."""

    def __init__(self, grams: Sequence[str]) -> None:
        parts = [g.split(" ") for g in grams]
        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
        self.size, n = len(grams), len(self.numbers)
        self.single = np.full(n + 1, -1, np.int64)  # the last one is that of other words, numbered -1
        pairs = [(np.iinfo(np.int64).max, -1)]  # none has that code
        for i, p in enumerate(parts):
            if len(p) == 1:
                self.single[self.numbers[p[0]]] = i
            else:
                pairs.append((self.numbers[p[0]] * n + self.numbers[p[1]], i))
        self.codes, self.places = np.array(sorted(pairs), np.int64).T.copy()

    def vectors(self, texts: pa.Array) -> pa.StructArray:
        """Vectors in the form of Spark's own type."""
        of, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, t in enumerate(texts):
            found = words(t.as_py() or "")
            c = np.fromiter(map(self.numbers.get, found, repeat(-1)), np.int64, len(found))
            a, b = c[:-1], c[1:]
            code = (a * len(self.numbers) + b)[(a >= 0) & (b >= 0)]
            near = np.searchsorted(self.codes, code)
            places = np.concatenate([self.single[c], self.places[near[self.codes[near] == code]]])
            at.append(places[places >= 0])
            of.append(np.full(len(at[-1]), i))
        place, k = np.unique(np.concatenate(of) * self.size + np.concatenate(at), return_counts=True)
        ends = pa.array(np.searchsorted(place, np.arange(len(texts) + 1) * self.size), pa.int32())
        indices = pa.ListArray.from_arrays(ends, pa.array(place % self.size, pa.int32()))
        values = pa.ListArray.from_arrays(ends, pa.array(1 + np.log(k)))
        sparse = pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), self.size, np.int32))
        return pa.StructArray.from_arrays([*sparse, indices, values], ["type", "size", "indices", "values"])
