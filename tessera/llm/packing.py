"""Best-fit packing of tokenised documents by pattern packing with non-negative least squares.

1. Documents are tokenised once, in Arrow batches, word by word: white space separates tokens, so
   the ids of a document are those of its words in turn, and each distinct word of a batch is encoded
   once (for tokenizers that lower-case and mark word ends, with its case and closing marks put aside).
   Only pieces (document, piece, start, length, checksum) are kept.
2. The histogram of piece lengths, at most `capacity` bins, is all that planning needs. Patterns of
   up to three lengths that fill a sequence are enumerated, repeat counts are fitted to the
   histogram by non-negative least squares, rounded down, and what is left is packed best fit
   decreasing, on counts of equal sequences, not one by one.
3. Pieces of a length are ranked (in parts, so that a common length is no single task) and the r-th
   piece of a length takes the r-th place that the plan has for it.

The plan's size depends on the capacity only; sequences and offsets follow by arithmetic.

Defined results: null text is an empty document, which is its end-of-document id alone; rows that
repeat an id are packed each; piece numbers start at 0 for each row; an empty table packs to nothing.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

CAPACITY = 4096
END = 1
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
BATCH_BYTES = 1 << 23


def slices(text: pa.Array, limit: int) -> Iterator[pa.Array]:
    text = pc.fill_null(text.cast(pa.large_string()), "")
    total = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))])
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
        yield text.slice(i, j - i)
        i = j


# Words of Latin letters, then sentence marks: the marks are a token run of their own, and case does not matter.
PLAIN = r"^(?P<core>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<tail>[,.!?;:]*)$"
WORDS_AT_ONCE = 1 << 19


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then the same for the next."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - count), count)


class Ids:
    """Ids of several words, end to end."""

    def __init__(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.flat, self.size = flat, size
        self.begin = np.cumsum(size) - size

    def take(self, index: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.begin[index], self.size[index])]


class Encoder:
    """Ids of texts by a tokenizers file. Each distinct word of a batch is encoded once; plain words, without
    regard to case (where the tokenizer folds it) and to the marks after them, many at a time. Where white
    space is more than a border between words, texts are encoded whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        # Whether case is folded before anything else; words are put aside by case only then.
        normalizer = json.loads(self.tokenizer.to_str()).get("normalizer") or {}
        steps = normalizer.get("normalizers", [normalizer])
        self.lower = any(s.get("type") == "Lowercase" or (s.get("type") == "BertNormalizer" and s.get("lowercase")) for s in steps)
        # Whether white space only parts words; if not, texts are encoded whole.
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        probes = (("ab cd", ["ab", "cd"]), (" ab", ["ab"]), ("ab  cd ", ["ab", "cd"]), ("Ab\n\tcd", ["Ab", "cd"]), ("ab. cd ,e", ["ab.", "cd", ",e"]))
        self.by_words = all(ids(text) == [i for w in words for i in ids(w)] for text, words in probes)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def one_by_one(self, words: list[str]) -> Ids:
        parts = []
        for s in range(0, len(words), 1024):  # encodings are large; ids are not
            parts += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(words[s : s + 1024], add_special_tokens=False)]
        return Ids(np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array([len(x) for x in parts], np.int64))

    def plain(self, words: list[str]) -> Ids:
        """Words of letters only: a token that ends a word parts them."""
        flat, size = [], []
        for s in range(0, len(words), 512):
            part = words[s : s + 512]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(part) or last[-1] != len(ids) - 1:  # not such a vocabulary
                own = self.one_by_one(part)
                flat.append(own.flat)
                size.append(own.size)
                continue
            flat.append(ids)
            size.append(np.diff(last, prepend=-1))
        return Ids(np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.concatenate(size) if size else np.zeros(0, np.int64))

    def words(self, words: pa.Array) -> Ids:
        parts = pc.extract_regex(words, PLAIN)
        simple = parts.is_valid().to_numpy(zero_copy_only=False)
        at, rest = np.flatnonzero(simple), np.flatnonzero(~simple)
        parts = parts.take(pa.array(at))
        core = pc.struct_field(parts, "core")
        core, tail = (pc.utf8_lower(core) if self.lower else core).dictionary_encode(), pc.struct_field(parts, "tail").dictionary_encode()
        cores, tails, others = self.plain(core.dictionary.to_pylist()), self.one_by_one(tail.dictionary.to_pylist()), self.one_by_one(words.take(pa.array(rest)).to_pylist())
        c, t = core.indices.to_numpy(zero_copy_only=False), tail.indices.to_numpy(zero_copy_only=False)
        size = np.zeros(len(words), np.int64)
        size[at], size[rest] = cores.size[c] + tails.size[t], others.size
        out = Ids(np.zeros(int(size.sum()), np.uint32), size)
        out.flat[ragged(out.begin[at], cores.size[c])] = cores.take(c)
        out.flat[ragged(out.begin[at] + cores.size[c], tails.size[t])] = tails.take(t)
        out.flat[ragged(out.begin[rest], others.size)] = others.flat
        return out

    def texts(self, text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts in turn: all ids end to end, and where each text's begin (one more than texts)."""
        if not self.by_words:
            for s in range(0, len(text), 256):
                whole = self.one_by_one(text.slice(s, 256).to_pylist())
                yield whole.flat, np.concatenate([[0], np.cumsum(whole.size)])
            return
        split = pc.ascii_split_whitespace(text)
        flat = split.flatten()
        filled = pc.greater(pc.binary_length(flat), 0)
        row = pc.list_parent_indices(split).filter(filled).to_numpy(zero_copy_only=False)
        coded = flat.filter(filled).dictionary_encode()
        del split, flat, filled
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids = self.words(coded.dictionary)
        word_of = np.searchsorted(row, np.arange(len(text) + 1))
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(word_of, word_of[i] + WORDS_AT_ONCE, side="right")) - 1)
            mine = index[word_of[i] : word_of[j]]
            total = np.concatenate([[0], np.cumsum(ids.size[mine])])
            yield ids.take(mine), total[word_of[i : j + 1] - word_of[i]]
            i = j


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of every row; `with_ids` adds the ids themselves."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        end = np.array([END], np.uint32)
        for batch in batches:
            base = 0
            for part in slices(batch["text"], BATCH_BYTES):
                for flat, first in encoder.texts(part):
                    out = [[], [], [], [], []]
                    kept = []
                    for i in range(len(first) - 1):
                        ids = np.concatenate([flat[first[i] : first[i + 1]], end]).astype("<u4")
                        for piece, start in enumerate(range(0, len(ids), capacity)):
                            mine = ids[start : start + capacity]
                            for column, value in zip(out, (base + i, piece, start, len(mine), zlib.crc32(mine)), strict=True):
                                column.append(value)
                            if with_ids:
                                kept.append(mine.astype(np.int32))
                    base += len(first) - 1
                    columns = [batch["doc_id"].take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])]
                    if with_ids:
                        columns.append(pa.array(kept, pa.list_(pa.int32())))
                    yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return rows.mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


def patterns(have: np.ndarray, capacity: int, partners: int = 24) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a sequence exactly, from lengths that occur.

    All pairs are candidates. Of triples those with a middle length out of `partners` ones, spread over the
    commonest 16 * `partners` lengths: the least squares need no more to choose from, and what the patterns
    leave over is packed all the same.
    """
    exists = np.zeros(capacity + 1, bool)
    lengths = np.flatnonzero(have)
    exists[lengths] = True
    found = [np.stack([[capacity], [0], [0]], 1)] if exists[capacity] else []
    a = lengths[lengths < capacity]
    b = capacity - a
    two = exists[b] & (a >= b)
    found.append(np.stack([a[two], b[two], np.zeros(two.sum(), int)], 1))
    if len(a):
        common = a[np.argsort(-have[a], kind="stable")[: 16 * partners]]
        step = max(1, len(common) // partners)
        for b in common[::step]:
            c = capacity - a - b
            fits = (c > 0) & (a >= b) & (c <= b)
            fits[fits] = exists[c[fits]]
            found.append(np.stack([a[fits], np.full(fits.sum(), b), c[fits]], 1))
            top = capacity - 2 * b - 0 * a  # twice b and one more
            if 0 < top[0] < capacity and exists[top[0]]:
                found.append(np.array([sorted([int(top[0]), int(b), int(b)], reverse=True)]))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), int)


def fit(pattern: np.ndarray, have: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - have|^2, by accelerated projected gradients."""
    if not len(pattern):
        return np.zeros(0)
    size = len(have)

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for j in range(3):
            out += np.bincount(pattern[:, j], weights=x, minlength=size)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[pattern].sum(1)

    v = np.ones(len(pattern))
    for _ in range(12):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(forward(v))))
    x = y = np.zeros(len(pattern))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - have))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(have: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Kinds of sequences as ([(length, times), ...], how many) that hold every piece of the histogram."""
    left = have.astype(np.int64).copy()
    kinds: list[tuple[list[tuple[int, int]], int]] = []
    pattern = patterns(left, capacity)
    repeat = np.floor(fit(pattern, left.astype(float)) + 1e-6).astype(np.int64)
    for row, n in sorted(zip(map(tuple, pattern), repeat, strict=True), key=lambda x: (-x[1], x[0])):
        parts = [(int(v), row.count(v)) for v in dict.fromkeys(row) if v]
        n = min(int(n), *(int(left[v]) // times for v, times in parts))
        if n > 0:
            kinds.append((parts, n))
            for v, times in parts:
                left[v] -= n * times
    return kinds + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit decreasing on counts: equal sequences are one kind."""
    open_kinds: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        for room in sorted(r for r in open_kinds if r >= length):
            times = room // length
            kept = []
            for parts, many in open_kinds.pop(room):
                whole = min(many, n // times)
                if whole:
                    open_kinds.setdefault(room - times * length, []).append(([*parts, (length, times)], whole))
                    n -= whole * times
                rest = many - whole
                if rest and n:
                    open_kinds.setdefault(room - n * length, []).append(([*parts, (length, n)], 1))
                    rest, n = rest - 1, 0
                if rest:
                    kept.append((parts, rest))
            if kept:
                open_kinds.setdefault(room, []).extend(kept)
            if not n:
                break
        if n:
            times = capacity // length
            if n // times:
                open_kinds.setdefault(capacity - times * length, []).append(([(length, times)], n // times))
            if n % times:
                open_kinds.setdefault(capacity - (n % times) * length, []).append(([(length, n % times)], 1))
    return [kind for room in sorted(open_kinds) for kind in open_kinds[room]]


def places(kinds: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """Per length the runs of places: first rank, first sequence, offset, times in a sequence."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for parts, many in kinds:
        offset = 0
        for length, times in parts:
            rank = used.get(length, 0)
            runs.setdefault(length, []).append((rank, sequence, offset, times))
            used[length] = rank + many * times
            offset += length * times
        sequence += many
    return {length: np.array(r, np.int64) for length, r in runs.items()}


PART_ROWS = 20000


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    pieces = cut(tokenize(docs, tokenizer, capacity, doc_id, text))
    have = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        have[r["length"]] = r["n"]
    # As many parts of the commonest length as hold about `PART_ROWS` pieces each.
    parts = max(16, -(-int(have.max()) // PART_ROWS))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    line = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "part", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("ahead"))
    runs = places(plan(have, capacity))

    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(ahead, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("rank") - 1).alias("rank"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length).tolist():
                mine = np.flatnonzero(length == v)
                run = runs[v][np.searchsorted(runs[v][:, 0], rank[mine], side="right") - 1]
                within = rank[mine] - run[:, 0]
                sequence[mine] = run[:, 1] + within // run[:, 3]
                offset[mine] = run[:, 2] + within % run[:, 3] * v
            yield pa.record_batch([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(put, PIECE + ", sequence_id long, offset long")
