import random

import numpy as np
import pytest

from tessera.operators import dedup, intervals, metrics, ranks, retrieval, serving


def test_numbered_as_row_number(spark):
    rng = random.Random(3)
    data = [(i, None if rng.random() < 0.1 else "hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}", rng.randrange(40)) for i in range(5000)]
    rows = spark.createDataFrame(data, "id int, k string, v int").repartition(7)
    rows.createOrReplaceTempView("numbered_rows")
    want = spark.sql("select id, row_number() over (partition by k order by v desc, id) as nth, row_number() over (order by v, id) as whole from numbered_rows")
    by_key = ranks.numbered(rows, [rows.v.desc(), "id"], ["k"])
    assert by_key.columns == ["id", "k", "v", "nth"]
    assert {(r.id, r.nth) for r in by_key.collect()} == {(r.id, r.nth) for r in want.collect()}
    assert {(r.id, r.nth) for r in ranks.numbered(rows, ["v", "id"]).collect()} == {(r.id, r.whole) for r in want.collect()}
    assert "Window" not in by_key._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    paged = serving.pages(rows, ["k"], ["v", "id"], 100).groupBy("k", "page").count()
    assert paged.agg({"count": "max"}).first()[0] == 100 and paged.where("k = 'hot'").count() >= 15
    assert ranks.numbered(rows.limit(0), ["v"], ["k"]).count() == 0


def test_ties_and_repeated_rows(spark):
    rows = spark.createDataFrame([("a", 1)] * 50 + [("b", 1)], "k string, v int").repartition(5)
    assert sorted(r.nth for r in ranks.numbered(rows, ["v"], ["k"]).where("k = 'a'").collect()) == list(range(1, 51))


def test_bags(spark):
    ask = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, None)], "at int, text string")
    have = spark.createDataFrame([(10, "x", "p"), (11, "x", "q"), (12, "z", "r"), (13, None, "s")], "created_at int, text string, preview string")
    got = dedup.reused(ask, have)
    assert got.columns == ["at", "text", "created_at", "preview"]
    assert {(r.at, r.preview) for r in got.collect()} == {(1, "p"), (2, "q"), (3, None), (4, None), (5, None)}


VALUES = {
    "normal": lambda g: g.normal(size=3001),
    "heavy tail": lambda g: np.exp(g.normal(size=2000) * 40),
    "ties": lambda g: g.integers(0, 3, 4000).astype(float),
    "one": lambda g: np.array([7.5]),
    "infinite": lambda g: np.concatenate([g.normal(size=50), [np.inf] * 30, [-np.inf] * 40]),
    "widest": lambda g: np.array([-1.7e308, 1.7e308, 5e-324, 0.0, 1.0, -1.0]),
}


@pytest.mark.parametrize("broadcast", [True, False])
def test_selected_as_sorted(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(ranks, "MOST_BROADCAST", 0)
    monkeypatch.setattr(ranks, "BINS", 256)
    g = np.random.default_rng(1)
    data = {k: make(g) for k, make in VALUES.items()}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("normal", None), ("empty", None), (None, 1.0)], "k string, v double").repartition(5)
    n = ranks.F.col("n")
    got = {(r.k, r.name): r.value for r in ranks.selected(rows, "v", ["k"], {"first": ranks.F.lit(1), "mid": ranks.F.floor((n + 1) / 2), "last": n, "beyond": n + 1}).collect()}
    want = {(k, name): float(np.sort(v)[i]) for k, v in (data | {None: np.array([1.0])}).items() for name, i in (("first", 0), ("mid", (len(v) + 1) // 2 - 1), ("last", len(v) - 1))}
    assert got == want


def test_latency_summary(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", None)], "k string, value double")
    got = {r.k: r for r in metrics.latency_summary(rows, "value", "k").collect()}
    assert (got["a"].least, got["a"].median, got["a"].p95, got["a"].most, got["a"].samples) == (1.0, 10.5, 19.0, 20.0, 20)
    assert (got["b"].median, got["b"].samples) == (None, 0)
    whole = metrics.latency_summary(rows, "value").first()
    assert (whole.median, whole.p95, whole.samples) == (10.5, 19.0, 20)
    assert metrics.latency_summary(rows.limit(0), "value", "k").count() == 0


def test_overlaps_as_by_a_loop(spark, monkeypatch):
    monkeypatch.setattr(intervals, "ROWS_OF_BLOCK", 20)  # the hot key is split
    rng = random.Random(5)

    def some(n):
        out = []
        for i in range(n):
            key = None if rng.random() < 0.05 else 0 if rng.random() < 0.5 else rng.randrange(1, 6)
            a = rng.randrange(-500, 500)
            out.append((i, key, None if rng.random() < 0.03 else a, a + rng.choice([-3, 0, 1, 1, 2, 7, 40, 900])))
        return out

    left, right = some(400), some(300)
    frames = [spark.createDataFrame(r, "id int, k int, start int, end int").repartition(3) for r in (left, right)]
    good = lambda r: None not in r and r[3] > r[2]
    want = sorted((x[0], y[0]) for x in left for y in right if good(x) and good(y) and x[1] == y[1] and x[2] < y[3] and x[3] > y[2])
    got = sorted((r.x.id, r.y.id) for r in intervals.overlapping_pairs(*frames, ["k"]).collect())
    assert got == want and len(want) > 1000
    everywhere = sorted((x[0], y[0]) for x in left for y in right if None not in x[2:] and None not in y[2:] and x[3] > x[2] and y[3] > y[2] and x[2] < y[3] and x[3] > y[2])
    assert sorted((r.x.id, r.y.id) for r in intervals.overlapping_pairs(*frames, []).collect()) == everywhere
    assert intervals.overlapping_pairs(frames[0].limit(0), frames[1], ["k"]).count() == 0


@pytest.mark.parametrize("numbers", [1 << 20, 64])
def test_nearest_in_tiles(spark, monkeypatch, numbers):
    """Blocks and tiles of 64 numbers hold eight vectors: many of each."""
    monkeypatch.setattr(retrieval, "TILE_NUMBERS", numbers)
    g = np.random.default_rng(2)
    q, p = g.normal(size=(60, 8)), g.normal(size=(90, 8))
    labels = [f"l{i % 30:02}" for i in range(90)]
    p[31] = p[2] * 3  # l01 and l02 tie
    q[5] = p[2]
    queries = [(i, [float(x) for x in v]) for i, v in enumerate(q)] + [(100, None), (101, [0.0] * 8), (102, [1.0, None] * 4), (103, [1.0, 2.0]), (5, [float(x) for x in q[5]])]
    prototypes = [(c, [float(x) for x in v]) for c, v in zip(labels, p)] + [(None, [1.0] * 8), ("zero", [0.0] * 8)]
    got = {r.id: r for r in retrieval.nearest(spark.createDataFrame(queries, "id int, vector array<double>"), spark.createDataFrame(prototypes, "label string, vector array<double>"), 0.6).collect()}
    assert set(got) == {*range(60), 100, 101, 102, 103}
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T
    for i in range(60):
        best = {}
        for c, s in zip(labels, cos[i]):
            best[c] = max(best.get(c, -2), s)
        first, second = sorted(best.values(), reverse=True)[:2]
        label = max(best, key=best.get) if first >= 0.6 and first - second > 1e-6 else None
        assert got[i].label == label and got[i].similarity == pytest.approx(first, abs=1e-6)
    assert got[5].method == "unknown" and all(got[i].similarity is None and got[i].method == "unknown" for i in (100, 101, 102, 103))


def test_nearest_without_prototypes(spark):
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "id int, vector array<double>")
    none = spark.createDataFrame([], "label string, vector array<double>")
    assert [tuple(r) for r in retrieval.nearest(queries, none).collect()] == [(1, None, None, "unknown")]
    assert retrieval.nearest(queries.limit(0), none).count() == 0
