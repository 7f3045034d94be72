"""Maximal repetitions (runs) of words, from Lyndon arrays over an ordered alphabet, and texts without the repeats.

A run is a stretch of words with smallest period q, of `periods` periods and `least` words at least,
that no neighbouring word extends keeping the period. Its Lyndon root is the longest Lyndon word at
that place for one of the two orders of the alphabet, that is, it ends where the next smaller suffix
begins. So two passes over the words (one an order) find every run.

A pass goes from left to right and compares suffix i with the open suffixes to its left (Ellert and
Fischer's scheme). What two suffixes have in common is taken from earlier comparisons: either from the
last one (both are known against a third suffix), or, inside the stretch that reaches furthest right
and is known to repeat an earlier one, from the comparison of the mirrored places. Words are compared
only beyond that stretch, so each word is passed once and the work is linear. Words are ranks in the
sorted vocabulary of their chunk; there are no suffix arrays or trees and no hashes.

Before, stretches that cannot hold a run are left out: from three periods on, every three
neighbouring words of a run stand again within a period of it, so a stretch in which some recur only at a
larger distance than its length allows is split there (`stretches`). That is a condition on neighbours
found by sorting ranks; all runs still come from the Lyndon arrays.

Documents are independent: one narrow pass without a shuffle, chunk by chunk; a task holds a chunk of
half a megabyte, or the longest text.

Defined results: null and blank texts have no words, no runs and an empty kept text; ids may be null
or repeat, each row is judged by itself; ties and repeated rows give equal results; an empty table
gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import Words, chunks, find_words

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Run = tuple[int, int, int]


def ranks(words: Words) -> np.ndarray:
    """Place of each word in the sorted vocabulary."""
    n = np.concatenate([[0], np.cumsum(words.end - words.start)])
    cover = np.zeros(len(words.data) + 1, np.int8)
    cover[words.start] += 1
    cover[words.end] -= 1
    raw = words.data[np.cumsum(cover[:-1], dtype=np.int8).astype(bool)]
    column = pa.Array.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(n.astype(np.int64)), pa.py_buffer(raw.tobytes())])
    return pc.rank(column, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


def _nearest(rank: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distance from each place to the nearest one in the same document with the same three words from there on."""
    n = len(rank) - 2
    far = np.full(max(n, 0), np.iinfo(np.int64).max)
    if n <= 0:
        return far
    size = int(rank.max()) + 1
    pair = rank[:-1] * size + rank[1:]
    triple = (_dense(pair) if size >= 1 << 20 else pair)[:-1] * size + rank[2:]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:-2] == doc[2:])
    at = at[np.argsort(triple[at], kind="stable")]
    same = (triple[at[1:]] == triple[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
    left, right = at[:-1][same], at[1:][same]
    far[left] = right - left
    far[right] = np.minimum(far[right], right - left)
    return far


def stretches(rank: np.ndarray, first: np.ndarray, least: int, periods: int) -> Iterator[tuple[int, int, int]]:
    """(document, start, end) of the word ranges that can hold runs; every run lies in one of them."""
    if periods < 3 or least < 4:  # three words of such a run need not stand again within a period
        yield from ((d, int(a), int(b)) for d, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)) if b - a >= least)
        return
    far = _nearest(rank, first)
    alive = far < np.iinfo(np.int64).max
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], alive, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        # Three words from the last place of one document reach into the next one, which `_nearest` leaves out.
        length = end - start + 2
        room = np.zeros(len(far), np.int64)
        room[alive] = np.repeat(np.where(length >= least, length, 0), end - start)
        fewer = alive & (far <= room // periods)
        if fewer.sum() == alive.sum():
            break
        alive = fewer
    doc = np.searchsorted(first, start, side="right") - 1
    yield from zip(doc.tolist(), start.tolist(), (end + 2).tolist(), strict=True)


def lyndon(s: list[int], up: bool) -> tuple[list[int], list[int], int]:
    """(next smaller suffix of each place, words that both have in common, comparisons of words made).

    The order of words is turned round unless `up`; the end is smaller than any word in both.
    """
    n = len(s)
    nss, n_lce, pss, p_lce = [n] * n, [0] * n, [-1] * n, [0] * n
    reach = mirror = frontier = compared = 0  # s[frontier:reach] repeats s[mirror:], and not beyond
    for i in range(1, n):
        ref, room = (i - frontier + mirror, reach - i) if i < reach else (-1, 0)
        j, k, last = i - 1, -1, -1
        while j >= 0:
            known = False
            if k >= 0:  # k words in common with the suffix `last`, which has p_lce[last] in common with j
                w = p_lce[last]
                if w < k:  # j is smaller than `last` by a word that i shares
                    k = w
                    break
                known = w > k
            if not known:
                at = -1
                if ref >= 0 and k < room:
                    m = j - frontier + mirror if j >= frontier else j
                    at = n_lce[m] if nss[m] == ref else p_lce[ref] if pss[ref] == m else -1
                if at >= 0 and at != room:
                    k = min(at, room)
                else:
                    k = max(k, at, 0)
                    begun = k
                    while i + k < n and s[i + k] == s[j + k]:
                        k += 1
                    compared += k - begun + 1
                    if i + k > reach:
                        reach, mirror, frontier, ref, room = i + k, j, i, j, k
            if i + k < n and (s[j + k] < s[i + k]) == up:
                break
            nss[j], n_lce[j] = i, k
            last, j = j, pss[j]
        pss[i], p_lce[i] = j, k if j >= 0 else 0
    return nss, n_lce, compared


def runs_of(s: list[int], least: int = 6, periods: int = 4) -> list[Run]:
    """(start, length, period) of every run, by start, then period.

    A run's leftmost root stands within its first period, so extending it to the left passes less than a
    period, and only roots that can still reach the length asked for are extended.
    """
    found = set()
    for up in (True, False):
        nss, lce, _ = lyndon(s, up)
        for i, j in enumerate(nss):
            p = j - i
            end = j + lce[i]
            need = max(least, periods * p)
            if j == len(s) or end - i + p <= need or (i >= p and nss[i - p] == i and lce[i - p] >= p):
                continue
            a = i
            while a and s[a - 1] == s[a - 1 + p]:
                a -= 1
            if end - a >= need:
                found.add((a, end - a, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept(words: Words, keep: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by one blank."""
    size = words.end - words.start
    lead = np.concatenate([[0], np.cumsum(keep)])[words.first]  # kept words before each document
    length = size[keep] + 1
    tail = lead[1:][np.diff(lead) > 0] - 1
    length[tail] -= 1
    ends = np.cumsum(length)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    letter = np.ones(len(out), bool)
    gap = np.ones(len(ends), bool)
    gap[tail] = False
    letter[ends[gap] - 1] = False
    cover = np.zeros(len(words.data) + 1, np.int8)
    cover[words.start[keep]] += 1
    cover[words.end[keep]] -= 1
    out[letter] = words.data[np.cumsum(cover[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], ends])[lead]
    return pa.Array.from_buffers(pa.string(), len(words.first) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out.tobytes())])


def collapse(docs: DataFrame, least: int = 6, periods: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start, then period) and kept_text: the words that
    stand in no run after its first period, joined by one blank."""
    if periods < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch["text"]):
                words = find_words(data, offsets)
                rank = ranks(words)
                found: list[list[Run]] = [[] for _ in range(j - i)]
                keep = np.ones(len(rank), bool)
                for d, a, b in stretches(rank, words.first, least, periods):
                    for start, length, period in runs_of(rank[a:b].tolist(), least, periods):
                        found[d].append((int(a + start - words.first[d]), length, period))
                        keep[a + start + period : a + start + length] = False
                for one in found:
                    one.sort(key=lambda r: (r[0], r[2]))
                flat = [r for one in found for r in one]
                parts = [pa.array([r[c] for r in flat], pa.int64()) for c in range(3)]
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(one) for one in found])]).astype(np.int32))
                runs = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(parts, fields=list(RUN)))
                yield pa.record_batch([batch["doc_id"].slice(i, j - i), pa.array(np.diff(words.first).astype(np.int64)), runs, _kept(words, keep)], names=["doc_id", "n_words", "runs", "kept_text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string")
