"""Substring dedup by compacting the De Bruijn graph of repeated word k-mers.

Edges are the windows of `k` words, nodes the k-1 words that two windows share.

1. Partition by minimizer. The smallest hash of the m-word grams in a window is the same wherever
   the window occurs; a window whose minimizer is in one document only cannot repeat and is left
   out. Only distinct minimizers are exchanged.
2. Edges. The remaining windows are exchanged with their successor and predecessor, which tells
   for each edge whether it occurs in several documents and whether the graph branches before or
   after it.
3. Compaction. A nonbranching path is a run of repeated edges with one successor and predecessor
   everywhere, so all documents cut it alike; each occurrence is one row (document, start, edges).
4. Joins. Paths are grouped for the smallest document; occurrences joined to them become spans of
   words to remove. They are verified at their source coordinates: the join key is a cryptographic
   digest (128 bits of BLAKE2) of the words that stand there, and their number, so that a clash of the
   64-bit hashes of 1 and 2 only cuts a path and never removes other words.

Defined results: null text has no words; null ids sort last and are never the smaller document;
rows with one id are the same document, and none of them loses words to another; documents under
k words lose none; an empty table gives an empty table.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .runtime import cut, text_volume
from .textkernel import LAST, Words, each_words, grams, inside

U = np.uint64
OCCURRENCE = "block int, doc_id long, nth int, key_a long, key_b long, edges int, starts array<int>"


def minimizers(h: np.ndarray, k: int, m: int) -> np.ndarray:
    """Per window of k words the least hash of its k - m + 1 grams of m words."""
    g = grams(h, m, 1)
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    width, have = k - m + 1, 1
    while have < width:
        step = min(have, width - have)
        g = np.minimum(g[: len(g) - step], g[step:])
        have += step
    return g[:n]


def nth_of_id(ids: np.ndarray) -> np.ndarray:
    """Which of the rows of its id, 0 but where ids repeat, each of the sorted ids is."""
    return np.arange(len(ids)) - np.searchsorted(ids, ids)


def windows_of(texts: pa.ChunkedArray, k: int):
    """(row of each window, position of each window, words, word hashes, ok) chunk by chunk."""
    for base, words in each_words(texts):
        h = words.hashes()
        ok = np.flatnonzero(inside(words.first, k))
        doc = words.doc()[ok] if len(ok) else ok
        yield base + doc, ok - words.first[doc], words, h, ok


def distinct(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, whether each has several ids, and the place of each input among them."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    place = np.empty(len(s), np.int64)
    place[order] = group
    head = ids[order][new]
    several = np.zeros(len(head), bool)
    several[group[ids[order] != head[group]]] = True
    return s[new], several, place


def _anchors(group: pa.Table, k: int, m: int):
    ids, texts = X.ordered(group)
    rows, mins = [], []
    for row, _, _, h, ok in windows_of(texts, k):
        v = minimizers(h, k, m)[ok]
        if len(v):
            keep = np.ones(len(v), bool)
            keep[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
            rows.append(row[keep])
            mins.append(v[keep])
    if not rows:
        return ids, texts, np.zeros(0, U), np.zeros(0, bool)
    key, several, _ = distinct(np.concatenate(mins), ids[np.concatenate(rows)])
    return ids, texts, key, several


def _flags(payloads: list[list[bytes]], lengths: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = np.concatenate([np.frombuffer(p[0], f"u{width}") for p in payloads])
    several = np.concatenate([X.unpack_bits(p[-1], n) for p, n in zip(payloads, lengths, strict=True)])
    return key, several, np.repeat(np.arange(len(payloads)), lengths)


def _split_bits(flag: np.ndarray, lengths: list[int]) -> list[bytes]:
    return [np.packbits(x).tobytes() for x in np.split(flag, np.cumsum(lengths)[:-1])]


def _reply_anchors(payloads, lengths):
    key, several, _ = _flags(payloads, lengths, 4)
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    shared = count > 1
    shared[where[several]] = True
    return [[x] for x in _split_bits(shared[where], lengths)]


def _edges(group: pa.Table, answers: pa.Table, ranges: int, k: int, m: int):
    """Candidate windows of a block: ids, row, position, edge hash, and the words with each window's first."""
    ids, texts, anchors, _ = _anchors(group, k, m)
    told = X.answers_in_order(answers)
    sizes = X.sizes(anchors, ranges)
    repeated = anchors[np.concatenate([X.unpack_bits(a[0], n) for a, n in zip(told, sizes, strict=True)])] if len(anchors) else anchors
    for row, pos, words, h, ok in windows_of(texts, k):
        if not len(ok):
            continue
        v = minimizers(h, k, m)[ok]
        at = np.searchsorted(repeated, v)
        hit = np.zeros(len(v), bool)
        inner = at < len(repeated)
        hit[inner] = repeated[at[inner]] == v[inner]
        if not hit.any():
            continue
        e = grams(h, k, 2)[ok][hit]
        e[e == 0] = 1
        yield ids, row[hit], pos[hit], e, (words, ok[hit])


def _neighbours(row: np.ndarray, pos: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    joined = (row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1)
    before, after = np.zeros(len(e), U), np.zeros(len(e), U)
    before[1:][joined] = e[:-1][joined]
    after[:-1][joined] = e[1:][joined]
    return before, after


def _gather(group: pa.Table, answers: pa.Table, ranges: int, k: int, m: int):
    parts = list(_edges(group, answers, ranges, k, m))
    if not parts:
        return None
    ids = parts[0][0]
    row, pos, e = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    return ids, row, pos, e, [p[4] for p in parts]


def _digests(parts: list[tuple[Words, np.ndarray]], at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(paths, 2) digests of the words of paths, joined by one blank. at: place of a path's first window
    among those of all parts; words: how many it has."""
    bounds = np.cumsum([0, *(len(first) for _, first in parts)])
    out = []
    for (found, first), low, high in zip(parts, bounds[:-1], bounds[1:], strict=True):
        mine = slice(*np.searchsorted(at, (low, high)))
        head = first[at[mine] - low]
        last = head + words[mine] - 1
        wide = np.ones(len(found.start), np.int64)  # gaps before a word that are not one blank
        wide[1:] = (found.start[1:] - found.end[:-1] != 1) | (found.data[found.end[:-1]] != 32)
        wide = np.cumsum(wide)
        raw = found.data.tobytes()
        for a, b, i, j, same in zip(found.start[head].tolist(), found.end[last].tolist(), head.tolist(), last.tolist(), (wide[head] == wide[last]).tolist(), strict=True):
            text = raw[a:b] if same else b" ".join([raw[x:y] for x, y in zip(found.start[i : j + 1].tolist(), found.end[i : j + 1].tolist(), strict=True)])
            out.append(blake2b(text, digest_size=16).digest())
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def _merge(head: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One value per key and whether another differs."""
    one = np.zeros(n, value.dtype)
    one[place[::-1]] = value[::-1]
    differs = np.zeros(n, bool)
    differs[place[value != one[place]]] = True
    return one, differs


def _reply_edges(payloads, lengths):
    key, several, source = _flags(payloads, lengths, 8)
    columns = [np.concatenate([np.frombuffer(p[i], U) for p in payloads]) for i in (1, 2)]
    branch = [np.concatenate([X.unpack_bits(p[i], n) for p, n in zip(payloads, lengths, strict=True)]) for i in (3, 4)]
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    shared = count > 1
    shared[place[several]] = True
    out = [shared]
    for value, flag in zip(columns, branch, strict=True):
        _, differs = _merge(key, place, value, len(count))
        differs[place[flag]] = True
        out.append(differs)
    parts = [_split_bits(x[place], lengths) for x in out]
    return [list(x) for x in zip(*parts, strict=True)]


def path_occurrences(docs: DataFrame, volume: int, k: int = 13, m: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """volume: bytes of text. One row per document and nonbranching path of repeated edges in it, with all its starts there."""
    blocks, ranges = X.plan_blocks(volume)
    dealt = X.in_blocks(docs, blocks, doc_id, text)

    def send_anchors(group: pa.Table) -> pa.Table:
        _, _, key, several = _anchors(group, k, m)
        return X.send(group["block"][0].as_py(), key, [key.astype(np.uint32)], ranges, [several])

    asked = dealt.groupBy("block").applyInArrow(send_anchors, X.PAYLOAD)
    anchors = X.answer(asked, _reply_anchors)

    def send_edges(group: pa.Table, answers: pa.Table) -> pa.Table:
        got = _gather(group, answers, ranges, k, m) if len(group) else None
        if got is None:
            return X.send(0, np.zeros(0, U), [], ranges)
        ids, row, pos, e, _ = got
        before, after = _neighbours(row, pos, e)
        key, several, place = distinct(e, ids[row])
        one_before, fork_before = _merge(key, place, before, len(key))
        one_after, fork_after = _merge(key, place, after, len(key))
        return X.send(group["block"][0].as_py(), key, [key, one_before, one_after], ranges, [fork_before, fork_after, several])

    edges = X.answer(dealt.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(send_edges, X.PAYLOAD), _reply_edges)
    both = anchors.select("block", "range", "answer", F.lit(0).alias("round")).unionByName(edges.select("block", "range", "answer", F.lit(1).alias("round")))

    def compact(group: pa.Table, answers: pa.Table) -> pa.Table:
        none = pa.table({n: pa.array([], t) for n, t in zip(("block", "doc_id", "nth", "key_a", "key_b", "edges", "starts"), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())), strict=True)})
        if not len(group):
            return none
        rounds = answers["round"].to_numpy()
        got = _gather(group, answers.filter(pa.array(rounds == 0)), ranges, k, m)
        if got is None:
            return none
        ids, row, pos, e, where = got
        key = np.unique(e)
        told = X.answers_in_order(answers.filter(pa.array(rounds == 1)))
        sizes = X.sizes(key, ranges)
        place = np.searchsorted(key, e)
        shared, fork_before, fork_after = (np.concatenate([X.unpack_bits(a[i], n) for a, n in zip(told, sizes, strict=True)])[place] for i in range(3))
        at_all = np.flatnonzero(shared)
        row, pos, fork_before, fork_after = (x[shared] for x in (row, pos, fork_before, fork_after))
        if not len(at_all):
            return none
        begins = np.ones(len(row), bool)
        begins[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1) | fork_after[:-1] | fork_before[1:]
        at = np.flatnonzero(begins)
        edges_in = np.diff(np.append(at, len(row)))
        a, b = _digests(where, at_all[at], edges_in + k - 1).T
        order = np.lexsort((pos[at], edges_in, b, a, row[at]))
        a, b, length, r, p = a[order], b[order], edges_in[order], row[at][order], pos[at][order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (length[1:] != length[:-1]) | (r[1:] != r[:-1])
        head = np.flatnonzero(new)
        return pa.table(
            {
                "block": pa.array(np.full(len(head), group["block"][0].as_py()), pa.int32()),
                "doc_id": pa.array(ids[r[head]]),
                "nth": pa.array(nth_of_id(ids)[r[head]], pa.int32()),
                "key_a": pa.array(a[head]),
                "key_b": pa.array(b[head]),
                "edges": pa.array(length[head], pa.int32()),
                "starts": pa.ListArray.from_arrays(pa.array(np.append(head, len(a)), pa.int32()), pa.array(p, pa.int32())),
            }
        )

    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(compact, OCCURRENCE)


def repeated_paths(occurrences: DataFrame) -> DataFrame:
    """The compacted graph: a row per path with its smallest document and number of documents."""
    return occurrences.groupBy("key_a", "key_b", "edges").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("documents"))


def removed_spans(occurrences: DataFrame, k: int = 13) -> DataFrame:
    """(block, doc_id, nth, starts, words): occurrences whose path also lies in a smaller document."""
    paths = repeated_paths(occurrences)
    return (
        occurrences.join(paths, ["key_a", "key_b", "edges"])
        .where(F.col("doc_id") > F.col("first_doc"))
        .select("block", "doc_id", "nth", "starts", (F.col("edges") + F.lit(k - 1)).alias("words"))
    )


def remove_repeats(docs: DataFrame, k: int = 13, m: int = 5, doc_id: str = "doc_id", text: str = "text", rest: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one blank) for each row of docs.

    With `rest`, also the whole text and a struct of those columns.
    """
    volume = text_volume(docs, text)
    blocks, _ = X.plan_blocks(volume)
    spans = removed_spans(cut(path_occurrences(docs, volume, k, m, doc_id, text)), k)

    def cover(group: pa.Table, found: pa.Table) -> pa.Table:
        group = X.in_order(group)
        ids, texts = X.ordered(group)
        nth = nth_of_id(ids)
        by_id: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        lists = found["starts"].combine_chunks()
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for r, (i, j, n) in enumerate(zip(*(found[c].to_pylist() for c in ("doc_id", "nth", "words")), strict=True)):
            by_id.setdefault((i, j), []).append((flat[bounds[r] : bounds[r + 1]], n))
        total, gone, kept = [], [], []
        for base, words in each_words(texts):
            raw = words.data.tobytes()
            for i in range(len(words.first) - 1):
                lo, hi = words.first[i], words.first[i + 1]
                stay = np.arange(lo, hi)
                row = (int(ids[base + i]), int(nth[base + i]))
                if row in by_id:
                    depth = np.zeros(hi - lo + 1, np.int64)
                    for starts, n in by_id[row]:
                        np.add.at(depth, starts, 1)
                        np.add.at(depth, starts + n, -1)
                    stay = stay[np.cumsum(depth)[:-1] == 0]
                total.append(hi - lo)
                gone.append(hi - lo - len(stay))
                kept.append(b" ".join([raw[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]).decode())
        columns = {
            "doc_id": pa.array(ids, mask=ids == LAST),
            "n_words": pa.array(total, pa.int64()),
            "n_removed": pa.array(gone, pa.int64()),
            "kept_text": pa.array(kept, pa.string()),
        }
        return pa.table(columns | ({"text": group["text"], "rest": group["rest"]} if rest else {}))

    dealt = X.in_blocks(docs, blocks, doc_id, text, rest)
    kind = f", text string, rest {dealt.schema['rest'].dataType.simpleString()}" if rest else ""
    return dealt.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(cover, "doc_id long, n_words long, n_removed long, kept_text string" + kind)


def shortened(docs: DataFrame, k: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the same columns, repeats taken out of the texts; texts without repeats stay as they are."""
    rest = tuple(c for c in docs.columns if c not in (doc_id, text)) or (doc_id,)
    done = remove_repeats(docs, k, doc_id=doc_id, text=text, rest=rest)
    own = {doc_id: F.col("doc_id"), text: F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    return done.select(*(own.get(c, F.col("rest").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
