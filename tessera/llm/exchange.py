"""Block exchange: ask a global question about every hash of a corpus, in packed columns.

Documents are dealt to blocks by a hash of their id. A block reduces its hashes to distinct ones,
splits them into hash ranges and sends one packed payload per range; each range answers every
payload it got, element by element; the block receives its answers. A hash that is in every
document still arrives once per block, so no range meets an unbounded group, and each task holds
one block or one range. Both counts grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import LAST

BLOCK_BYTES = 8 << 20
BYTES_PER_HASH = 6  # a word and its blank, about
HASHES_PER_RANGE = 2 << 20
LEAST = 64

U = np.uint64


def plan_blocks(volume: int) -> tuple[int, int]:
    """(blocks, ranges) for the volume of text."""
    return max(LEAST, -(-volume // BLOCK_BYTES)), max(LEAST, -(-volume // (BYTES_PER_HASH * HASHES_PER_RANGE)))


def in_blocks(docs: DataFrame, blocks: int, doc_id: str = "doc_id", text: str = "text", rest: tuple[str, ...] = (), by_row: bool = True) -> DataFrame:
    """block, doc_id and text of each row; other columns that are to come along as a struct `rest`.

    Dealt by id and text, so that rows without an id, or with one in common, are no single block; with
    `by_row` false by the id alone, so that an id tells its block.
    """
    dealt = (F.col(doc_id), F.col(text)) if by_row else (F.col(doc_id).cast("long"),)
    return docs.select(
        F.pmod(F.xxhash64(*dealt), F.lit(blocks)).cast("int").alias("block"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        *([F.struct(*(F.col(c) for c in rest)).alias("rest")] if rest else []),
    )


def in_order(group: pa.Table) -> pa.Table:
    """Sorted by id, then text; rows equal in both may stand either way round."""
    return group.take(pc.sort_indices(group.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")]))


def ordered(group: pa.Table) -> tuple[np.ndarray, pa.ChunkedArray]:
    """A block's ids and texts in an order that does not depend on how its rows arrived; null ids last."""
    group = in_order(group)
    ids = group["doc_id"].fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, group["text"]


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key >> U(32)) * U(ranges)) >> U(32)


PAYLOAD = "range int, block int, n int, payload array<binary>"
ANSWER = "block int, range int, answer array<binary>"


def send(block: int, key: np.ndarray, columns: list[np.ndarray], ranges: int, bits: list[np.ndarray] = ()) -> pa.Table:
    """Payload rows for sorted distinct keys; columns and bits run along the keys."""
    owner = range_of(key, ranges)
    edges = np.searchsorted(owner, np.arange(ranges + 1))
    full = np.flatnonzero(np.diff(edges))
    rows = [
        [c[edges[r] : edges[r + 1]].tobytes() for c in columns] + [np.packbits(b[edges[r] : edges[r + 1]]).tobytes() for b in bits]
        for r in full
    ]
    return pa.table(
        {
            "range": pa.array(full, pa.int32()),
            "block": pa.array(np.full(len(full), block), pa.int32()),
            "n": pa.array(np.diff(edges)[full], pa.int32()),
            "payload": pa.array(rows, pa.list_(pa.binary())),
        }
    )


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def answer(payloads: DataFrame, reply: Callable[[list[list[bytes]], list[int]], list[list[bytes]]]) -> DataFrame:
    """`reply(payloads of a range, their lengths)` gives an answer for each payload."""

    def one(group: pa.Table) -> pa.Table:
        got = reply(group["payload"].to_pylist(), group["n"].to_pylist())
        return pa.table({"block": group["block"], "range": group["range"], "answer": pa.array(got, pa.list_(pa.binary()))})

    return payloads.groupBy("range").applyInArrow(one, ANSWER)


def answers_in_order(group: pa.Table) -> list[list[bytes]]:
    """A block's answers by range, hence in the order of its sorted keys."""
    return group.sort_by("range")["answer"].to_pylist()


def sizes(key: np.ndarray, ranges: int) -> np.ndarray:
    """How many of the sorted keys each range that has any was sent, in the order of the ranges."""
    n = np.diff(np.searchsorted(range_of(key, ranges), np.arange(ranges + 1)))
    return n[n > 0]
