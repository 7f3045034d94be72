import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import centroid_clustering as C

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def plain(rows, k, rounds, dims, scale=256, seed=2):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e, *_ in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    hashed = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (hashed(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in set(of):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centres


def table(n, dims, spread, seed=4):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(middle)], "a", 1) for i in range(n)]
    rows += [(n + i, rows[i][1], "b", 2) for i in range(0, n, 5)] + [rows[3], (None, rows[4][1], None, None), (None, rows[5][1], None, None)]
    odd = [None, [], [0.5] * (dims - 1), [0.5] * (dims - 1) + [None], [0.5] * (dims - 1) + [float("nan")], [float("-inf")] * dims]
    return rows + [(10_000 + i, e, None, None) for i, e in enumerate(odd)]


@pytest.mark.parametrize(("n", "dims", "spread", "scale", "k"), [(400, 8, 0.3, 256, 40), (300, 2, 0.5, 4, 12), (250, 4, 1.0, 1 << 22, 9), (6, 3, 0.2, 256, 40)])
def test_as_by_plain_rounds(spark, n, dims, spread, scale, k):
    rows, log = table(n, dims, spread), []
    got, centres = C.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, rounds=5, dims=dims, scale=scale, log=log)
    want, means = plain(rows, k, 5, dims, scale)
    assert centres.tolist() == means
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr) == want
    if n == 400:  # bounds spare distances, and lists shrink
        assert sum(d for m, d, _ in log[2:]) < 0.5 * sum(m for m, *_ in log[2:]) * k and log[-1][2] <= log[0][2]


def test_bounds_hold_while_centroids_move():
    rng = np.random.default_rng(2)
    v, centres = rng.integers(-300, 300, (200, 5)), rng.integers(-300, 300, (20, 5))
    now = C.Bounds(v, 5)
    now.scan(centres, np.arange(len(v)))
    for turn in range(12):
        moved = centres + rng.integers(-30, 30, centres.shape)
        now.moved(np.sqrt(((moved - centres) ** 2).sum(1)))
        centres = moved
        if turn == 6:
            now.shorten(3)
        true = np.sqrt(C.squared(v, centres))
        rows = np.arange(len(v))
        for _ in range(2):  # before and after settling
            assert (now.upper >= true[rows, now.cluster] - 1e-6).all()
            assert (now.lower <= np.take_along_axis(true, now.near, 1) + 1e-6).all()
            rest = true.copy()
            rest[rows, now.cluster] = np.inf
            np.put_along_axis(rest, now.near.astype(np.int64), np.inf, 1)
            assert (now.rest <= rest.min(1) + 1e-6).all()
            now.settle(centres)
        assert (now.cluster == C.squared(v, centres).argmin(1)).all()


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [x], None, None) for i, x in enumerate([0.0, 2.0, 1.0, 1.0, 1.0, 4.0, 3.0])]
    got, _ = C.cluster(spark.createDataFrame(rows, SCHEMA), k=3, rounds=2, dims=1, scale=1)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 3, 2, 1, 1)[0]


def test_no_rows_and_what_does_not_fit(spark):
    none, centres = C.cluster(spark.createDataFrame([(1, None, None, None)], SCHEMA), dims=3)
    assert none.count() == 0 and centres.shape == (0, 3)
    with pytest.raises(Exception, match="after scaling"):
        C.cluster(spark.createDataFrame([(1, [1e30], None, None)], SCHEMA), dims=1)
