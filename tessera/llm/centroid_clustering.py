"""Exact k-means on integer vectors with Drake and Hamerly's adaptive bounds.

Every vector carries its cluster, an upper bound on its distance to that centroid, lower bounds on
its distances to the next few centroids, and one lower bound for all that remain. When
centroids move, bounds move by as much. A vector whose upper bound is below all lower bounds stays without a
distance computed. Else its own distance is computed, and then those of the listed centroids up to the
first place whose bound, and all after it, are above it. Only where not even the remainder bound is above it
are all centroids scanned. The lists begin with a quarter of the centroids and shrink to the longest
part of a list that a round has used, an eighth at least; what falls off a list joins the remainder bound.

Bounds only spare work: a bound counts as above with a margin for rounding, and whatever is not certified is computed
exactly, in integers, ties to the smaller number. So the result is that of plain rounds.

A round is one narrow pass over the table of vectors and bounds, written to the checkpoint folder, and one that
sums vectors per cluster inside each task; (cluster, component) sums are all that is shuffled. The centroids, k
rows, are all that the driver holds. A cluster with most of the rows is summed like any other.

Defined results: vectors of another length, null, or with null or non-finite components have no row; repeated rows and
ids are vectors of their own; null ids come last among the first centroids; with fewer vectors than k, each
begins a centroid; clusters that lose all vectors keep their centroid; an empty table gives an empty one; other
columns are ignored, whatever their names. Scaled components of 2**27 or more are refused, as distances would not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut

MOST = 1 << 27
EXACT = 1 << 20  # components below this give distances that doubles hold exactly
MARGIN = 1e-9
BOUNDS = "cluster int, upper double, near binary, lower binary, rest double, used int, distances int"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of a and rows of b, as integers."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1)


def _pairs(v: np.ndarray, centres: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to the centroids that its row of `which` names."""
    return np.stack([((v - centres[w]) ** 2).sum(1) for w in which.T], 1) if which.shape[1] else np.zeros(which.shape, np.int64)


class Bounds:
    """A batch's clusters and bounds; `near` and `lower` have one column for each listed centroid."""

    def __init__(self, v: np.ndarray, listed: int) -> None:
        n = len(v)
        self.v, self.cluster, self.upper, self.rest = v, np.zeros(n, np.int32), np.zeros(n), np.full(n, np.inf)
        self.near, self.lower = np.zeros((n, listed), np.int32), np.zeros((n, listed))
        self.used, self.distances = np.zeros(n, np.int32), np.zeros(n, np.int32)

    def scan(self, centres: np.ndarray, rows: np.ndarray) -> None:
        """All distances of some rows."""
        listed = self.near.shape[1]
        d = squared(self.v[rows], centres)
        order = np.argsort(d, axis=1, kind="stable").astype(np.int32)  # ties: the smaller number first
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        self.cluster[rows], self.upper[rows] = order[:, 0], root[:, 0]
        self.near[rows], self.lower[rows] = order[:, 1 : listed + 1], root[:, 1 : listed + 1]
        self.rest[rows] = root[:, listed + 1] if listed + 1 < len(centres) else np.inf
        self.distances[rows] += len(centres)

    def shorten(self, listed: int) -> None:
        if listed < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, listed:].min(1))
            self.near, self.lower = self.near[:, :listed], self.lower[:, :listed]

    def moved(self, drift: np.ndarray) -> None:
        self.upper = self.upper + drift[self.cluster]
        self.lower = self.lower - drift[self.near]
        self.rest = self.rest - drift.max(initial=0)

    def places(self, rows: np.ndarray) -> np.ndarray:
        """The first place of each row's list from which on all centroids are certified to be farther than its own;
        one more than the list has where the remainder is not."""
        floor = np.concatenate([self.lower[rows], self.rest[rows, None]], 1)
        floor = np.minimum.accumulate(floor[:, ::-1], axis=1)[:, ::-1]
        above = floor > self.upper[rows, None] * (1 + MARGIN) + MARGIN * (1 + np.abs(floor))
        above[np.isposinf(floor)] = True
        return np.where(above[:, -1], np.argmax(above, axis=1), floor.shape[1])

    def settle(self, centres: np.ndarray) -> None:
        """Nearest centroids of all rows, with the distances that the bounds do not spare."""
        rows = np.flatnonzero(self.places(np.arange(len(self.v))) > 0)
        own = _pairs(self.v[rows], centres, self.cluster[rows, None])[:, 0]
        self.upper[rows] = np.sqrt(own.astype(np.float64))
        self.distances[rows] += 1
        place = self.places(rows)
        listed = self.near.shape[1]
        for z in np.unique(place[(place > 0) & (place <= listed)]).tolist():
            at = place == z
            some = rows[at]
            which = np.concatenate([self.cluster[some, None], self.near[some, :z]], 1)
            d = np.concatenate([own[at, None], _pairs(self.v[some], centres, self.near[some, :z])], 1)
            order = np.lexsort((which, d), axis=1)
            which, root = np.take_along_axis(which, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
            self.cluster[some], self.upper[some] = which[:, 0], root[:, 0]
            self.near[some, :z], self.lower[some, :z] = which[:, 1:], root[:, 1:]
            self.used[some] = z
            self.distances[some] += z
        if len(left := rows[place > listed]):
            self.scan(centres, left)


def _binary(a: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(a).tobytes()
    size = len(raw) // len(a) if len(a) else 0
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * size).astype(np.int32)), pa.py_buffer(raw)])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0), kind)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    size = int(ends[1] - ends[0])
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]].copy().view(kind).reshape(len(column), -1) if size else np.zeros((len(column), 0), kind)


def _step(state: DataFrame, centres: np.ndarray, listed: int, drift: np.ndarray | None) -> DataFrame:
    """The state after an assignment: a first one where there is no drift yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch["v"], np.int32).astype(np.int64)
            now = Bounds(v, listed)
            if drift is None:
                now.scan(centres, np.arange(len(v)))
            else:
                now.cluster, now.upper, now.rest = (batch[c].to_numpy().copy() for c in ("cluster", "upper", "rest"))
                now.near, now.lower = _matrix(batch["near"], np.int32), _matrix(batch["lower"], np.float64)
                now.moved(drift)
                now.shorten(listed)
                now.settle(centres)
            columns = [now.cluster, now.upper, _binary(now.near), _binary(now.lower), now.rest, now.used, now.distances]
            yield pa.record_batch([batch["vec_id"], batch["v"], *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=["vec_id", "v", *(f.split()[0] for f in BOUNDS.split(", "))])

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.mapInArrow(run, f"vec_id {kind}, v binary, {BOUNDS}")


def _means(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Componentwise floor of each cluster's mean; empty clusters keep theirs."""
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                v, c = _matrix(batch["v"], np.int32).astype(np.int64), batch["cluster"].to_numpy()
                order = np.argsort(c, kind="stable")
                here, first = np.unique(c[order], return_index=True)
                total[here] += np.add.reduceat(v[order], first, axis=0)
                n += np.bincount(c, minlength=k)
        full = np.flatnonzero(n)
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(n[full]), pa.array(list(total[full]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = state.select("v", "cluster").mapInArrow(run, "cluster int, n long, total array<long>")
    rows = parts.select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()  # k times dims
    out = centres.copy()
    for r in rows:
        out[r.cluster, r.pos] = int(r.total) // r.n
    return out


def scaled(vectors: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and floor(scale * x) of every component, of the vectors with `dims` finite ones."""
    # One boolean a row, null-safe: a null component makes `forall` null, hence no row.
    whole = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.where(whole).select(F.col(vec_id).alias("vec_id"), F.transform(vector, lambda x: F.floor(scale * x.cast("double"))).alias("x"))
    fits = F.forall("x", lambda x: (x > -MOST) & (x < MOST))
    return good.select("vec_id", F.when(fits, F.col("x").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is {MOST} or more after scaling"))).alias("x"))


def _packed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["x"].flatten().to_numpy().astype(np.int32)
            yield pa.record_batch([batch["vec_id"], _binary(flat.reshape(batch.num_rows, -1)) if batch.num_rows else pa.array([], pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v binary")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", log: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster and squared distance of each vector; the centroids).

    `log`, if given, gets (vectors, distances computed, listed centroids) of every assignment.
    """
    first = scaled(vectors, dims, scale, vec_id, vector)
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    begun = first.orderBy(by_hash.asc_nulls_last(), "x").limit(k).collect()
    if not begun:
        return first.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), np.int64)
    centres = np.array([r.x for r in begun], np.int64)
    k = len(centres)
    listed, fewest = min(k - 1, max(1, k // 4)), min(k - 1, max(1, k // 8))
    state, drift = _packed(first), None
    for turn in range(rounds + 1):
        state = cut(_step(state, centres, listed, drift))
        seen = state.agg(F.count("*").alias("n"), F.sum("distances").alias("d"), F.max("used").alias("used")).first()
        if log is not None:
            log.append((seen.n, seen.d, listed))
        if turn == rounds:
            break
        if turn:
            listed = max(fewest, min(listed, seen.used))
        new = _means(state, centres)
        drift = np.sqrt(((new - centres) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)
        centres = new

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch["v"], np.int32).astype(np.int64)
            d = _pairs(v, centres, batch["cluster"].to_numpy()[:, None])[:, 0] if len(v) else np.zeros(0, np.int64)
            yield pa.record_batch([batch["vec_id"], batch["cluster"], pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.select("vec_id", "v", "cluster").mapInArrow(exact, f"vec_id {kind}, cluster int, distance long"), centres
