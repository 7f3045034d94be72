import random

from tessera.operators import intervals


def test_keys_with_few_and_many_rows(spark, monkeypatch):
    """Few rows of a key meet once, without cells; keys with many go by cells; both as by brute force."""
    rng = random.Random(5)
    data = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", a := rng.randrange(500), a + rng.choice((0, 3, 20, 300))) for i in range(600)] + [(900, None, 1, 9), (901, "k1", None, 9)]
    rows = spark.createDataFrame(data, "id int, k string, start int, end int")
    want = {(p[0], q[0]) for p in data for q in data if None not in p and None not in q and p[1] == q[1] and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and p[3] > q[2]}
    for most in (10_000, 50, 0):
        monkeypatch.setattr(intervals, "ROWS_OF_KEY", most)
        pairs = intervals.overlapping_pairs(rows, rows, ["k"])
        got = [(r.a, r.b) for r in pairs.selectExpr("x.id a", "y.id b").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert ("cell" in pairs._jdf.queryExecution().optimizedPlan().toString()) == (most < 10_000)
