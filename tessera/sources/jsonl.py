"""JSON lines under a budget of rows and (compressed) bytes, and in resumable batches: Python data sources.

`jsonl_bounded` reads one object from its start until the row limit, the byte limit or its end, and says
which in `stop_reason`. `jsonl_batches` is a stream whose offset is the byte cursor, so a checkpoint resumes
it; it refuses a source that has changed. Both read one object in order, as a budget of compressed bytes and a byte cursor
ask for; `numbered` reads large files in splits, with the same ordinals and budgets.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class _Limited(io.RawIOBase):
    """Raw bytes up to a limit; `spent` tells whether the limit, not the end, stopped it."""

    def __init__(self, raw: io.RawIOBase, limit: int) -> None:
        self.raw, self.left, self.spent = raw, limit, False

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        if self.left <= 0:
            self.spent = bool(self.raw.read(1))
            return 0
        data = self.raw.read(min(len(into), self.left))
        into[: len(data)] = data
        self.left -= len(data)
        return len(data)


class BoundedJsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_bounded"

    def schema(self) -> str:
        return "line long, value string, malformed boolean, stop_reason string"

    def reader(self, schema) -> DataSourceReader:
        return _BoundedReader(self.options)


class _BoundedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.rows = int(options.get("max_rows", 1 << 62))
        self.bytes = int(options.get("max_bytes", 1 << 62))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as raw:
            limited = _Limited(raw, self.bytes)
            source = gzip.GzipFile(fileobj=io.BufferedReader(limited)) if self.path.endswith(".gz") else io.BufferedReader(limited)
            n, reason = 0, "end_of_file"
            while n < self.rows:
                try:
                    line = source.readline()
                except EOFError:  # the budget cut the compressed stream
                    reason = "byte_limit"
                    break
                if not line:
                    reason = "byte_limit" if limited.spent else reason
                    break
                if limited.spent and not line.endswith(b"\n"):
                    reason = "byte_limit"
                    break
                n += 1
                value, bad = _parsed(line)
                yield (n, value, bad, None)
            else:
                reason = "row_limit"
            yield (n, None, False, reason)


def _parsed(line: bytes) -> tuple[str | None, bool]:
    try:
        text = line.decode()
        json.loads(text)
        return text.rstrip("\r\n"), False
    except ValueError:
        return None, True


class JsonLineBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_batches"

    def schema(self) -> str:
        return "source_line long, value string, malformed boolean"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _BatchReader(self.options)


def fingerprint(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as raw:
        while block := raw.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


class _BatchReader(SimpleDataSourceStreamReader):
    """Batches of up to batch_size rows or about 10 MiB; blank lines are skipped, malformed ones stay."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.size = int(options.get("batch_size", 500))
        self.bytes = int(options.get("batch_bytes", 10 << 20))
        keys = options.get("keys")
        self.keys = set(keys.split(",")) if keys else None
        self.key = options.get("key", "parent_asin")
        self.seen: tuple[int, int] | None = None

    def _unchanged(self, sha256: str) -> bool:
        """Whether the source is still the one that the stream began with: by its whole content once a run, by
        its size and time of change for the batches after that."""
        stat = os.stat(self.path)
        now = (stat.st_size, stat.st_mtime_ns)
        if now != self.seen and fingerprint(self.path) != sha256:
            return False
        self.seen = now
        return True

    def initialOffset(self) -> dict:
        return {"cursor": 0, "line": 0, "sha256": fingerprint(self.path)}

    def _from(self, start: dict, stop: int | None) -> tuple[list[tuple], dict]:
        if not self._unchanged(start["sha256"]):
            raise ValueError("the import source changed since it was started")
        rows, taken, line = [], 0, start["line"]
        with open(self.path, "rb") as raw:
            raw.seek(start["cursor"])
            while (stop is None and len(rows) < self.size and taken < self.bytes) or (stop is not None and raw.tell() < stop):
                text = raw.readline()
                if not text:
                    break
                line += 1
                if not text.strip():
                    continue
                value, bad = _parsed(text)
                if self.keys is not None and not bad:
                    item = json.loads(value)
                    if not isinstance(item, dict) or item.get(self.key) not in self.keys:
                        continue
                rows.append((line, value, bad))
                taken += len(text)
            return rows, start | {"cursor": raw.tell(), "line": line}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._from(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._from(start, end["cursor"])[0])

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BoundedJsonLines)
    spark.dataSource.register(JsonLineBatches)


def bounded(spark: SparkSession, path: str, max_rows: int | None = None, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, one row with rows and stop_reason)."""
    register(spark)
    limits = {k: str(v) for k, v in (("max_rows", max_rows), ("max_bytes", max_bytes)) if v is not None}
    everything = spark.read.format("jsonl_bounded").options(path=path, **limits).load()
    return everything.where("stop_reason is null").drop("stop_reason"), everything.where("stop_reason is not null").select(F.col("line").alias("rows"), "stop_reason")


def batches(spark: SparkSession, path: str, batch_size: int = 500, keys: list[str] | None = None, key: str = "parent_asin") -> DataFrame:
    register(spark)
    stream = spark.readStream.format("jsonl_batches").option("path", path).option("batch_size", str(batch_size)).option("key", key)
    return (stream.option("keys", ",".join(keys)) if keys else stream).load()
