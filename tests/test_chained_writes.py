import random

import pytest

from tessera.operators import history

WRITE = "run_id int, id string, expected_previous_id string, at int"


def loop(writes, stored):
    now, out = dict(stored), {}
    for run, i, expected, _ in sorted(writes, key=lambda w: w[3]):
        out[i] = now.get(run) == expected
        if out[i]:
            now[run] = i
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_as_by_a_loop(spark, seed):
    rng = random.Random(seed)
    stored = {0: "s0", 1: None, 2: "s2"}
    writes = []
    for at in range(300):
        run = 0 if rng.random() < 0.5 else rng.randrange(5)  # a hot key
        own = [w[1] for w in writes if w[0] == run][-3:]
        writes.append((run, f"w{at}", rng.choice([*own, stored.get(run), None, "unknown"]), at))
    late = ("w299" if writes[-1][0] == 0 else "w298", 0)
    writes.append((0, "w300", late[0], -1))  # expects a write that only comes later
    got = history.chained_writes(spark.createDataFrame(writes, WRITE).repartition(4), spark.createDataFrame(list(stored.items()), "run_id int, id string"))
    assert {r.id: r.accepted for r in got.collect()} == loop(writes, stored)


def test_a_long_chain_and_no_writes(spark):
    n = 1000
    writes = spark.range(n).selectExpr("1 run_id", "string(id) id", "if(id = 0, null, string(id - 1)) expected_previous_id", "int(id) at")
    none = spark.createDataFrame([], "run_id int, id string")
    assert history.chained_writes(writes, none).where("accepted").count() == n
    assert history.chained_writes(writes.limit(0), none).count() == 0
