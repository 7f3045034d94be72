import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import jsonl, numbered


def content(rng, n):
    rows = []
    for i in range(n):
        kind = rng.random()
        rows.append(b"" if kind < 0.05 else b"{broken" if kind < 0.1 else b"\xff\xfe" if kind < 0.12 else json.dumps({"i": i, "k": rng.choice("ab"), "t": "é" * rng.randint(0, 90)}, ensure_ascii=False).encode() + (b"\r" if kind > 0.9 else b""))
    return rows


@pytest.fixture
def splits(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", size)

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("ends", [b"\n", b""])
def test_same_rows_for_one_and_many_splits(spark, splits, tmp_path, ends):
    rows = content(random.Random(len(ends)), 400)
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"\n".join(rows) + ends)
    total = path.stat().st_size
    limits = [(123, None), (None, total // 3), (400, total), (None, total - 1)]
    for size in (1 << 20, total // 16):
        splits(size)
        parts = spark.read.text(str(path)).rdd.getNumPartitions()
        assert (parts == 1) == (size == 1 << 20) and parts <= 18
        for most_rows, most_bytes in limits:
            got, said = numbered.bounded(spark, str(path), most_rows, most_bytes)
            want, why = jsonl.bounded(spark, str(path), most_rows, most_bytes)
            assert sorted(map(tuple, got.select("line", "value", "malformed").collect())) == sorted(map(tuple, want.select("line", "value", "malformed").collect()))
            assert tuple(said.first()) == tuple(why.first())


def test_batches_resume(spark, splits, tmp_path):
    rng = random.Random(3)
    files = [content(rng, n) for n in (90, 1, 160)]
    for i, rows in enumerate(files):
        (tmp_path / f"{i}.jsonl").write_bytes(b"\n".join(rows) + b"\n")
    splits(700)
    keep = F.get_json_object("value", "$.k") == "a"
    got = sorted(map(tuple, numbered.in_batches(spark, str(tmp_path), keep, 20).select("line", "batch").collect()))
    every = [r for rows in files for r in rows]
    kept = [i + 1 for i, r in enumerate(every) if r.startswith(b"{\"") and json.loads(r)["k"] == "a"]
    assert got == [(line, n // 20) for n, line in enumerate(kept)]
    later = numbered.in_batches(spark, str(tmp_path), keep, 20).where("batch >= 2")
    assert later.count() == len(kept) - 40
    assert sorted(r.line for r in numbered.numbered(spark, str(tmp_path)).collect()) == list(range(1, 252))


def test_compressed_and_empty_files(spark, tmp_path):
    (tmp_path / "x.jsonl.gz").write_bytes(gzip.compress(b'{"a":1}\n{"a":2}\n{"a":3}\n'))
    got, said = numbered.bounded(spark, str(tmp_path / "x.jsonl.gz"), max_bytes=16)
    assert [r.line for r in got.orderBy("line").collect()] == [1, 2] and said.first().stop_reason == "byte_limit"
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "empty.jsonl").write_bytes(b"")
    got, said = numbered.bounded(spark, str(tmp_path / "y"))
    assert got.count() == 0 and tuple(said.first()) == (0, "end_of_file")
