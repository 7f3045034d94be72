"""Keyed state over event streams, with batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def reused_within(rows: DataFrame, key: str, time: str, tie: str, ttl: str) -> DataFrame:
    """Whether each request came within the time to live of its key's last one, which it then extends."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time, tie))
    return rows.withColumn("reused", F.coalesce(F.col(time) - before <= F.expr(ttl), F.lit(False)))


def requests_with_ttl(stream: DataFrame, key: str, time: str, item: str, seconds: int) -> DataFrame:
    """Streaming form: (key, item, reused) by keyed state that expires with the watermark."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values([time, item], kind="stable")
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out = []
        for t, i in zip(rows[time], rows[item], strict=True):
            out.append(bool(last is not None and t - last <= pd.Timedelta(seconds=seconds)))
            last = t if last is None else max(last, t)
        state.update((int(last.value // 1000),))
        state.setTimeoutTimestamp(max(int(last.value // 1_000_000), state.getCurrentWatermarkMs()) + seconds * 1000 + 1)
        yield pd.DataFrame({key: [k[0]] * len(rows), item: rows[item].to_numpy(), "reused": out})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {item} {kinds[item]}, reused boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def item_attempts(stream: DataFrame, item: str, kind: str, order: list[str], most: int = 3) -> DataFrame:
    """Streaming form of `queue.item_states`: (item, attempts, status) whenever an item's events come in.

    Failures since the last retry by hand are counted up to `most`; an item that was completed stays so.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        failures, done = state.get if state.exists else (0, False)
        for what in rows[kind]:
            done = done or what == "completed"
            failures = 0 if what == "retry" else failures + (what == "failed")
        state.update((int(failures), bool(done)))
        status = "completed" if done else "failed" if failures >= most else "pending"
        yield pd.DataFrame({item: [k[0]], "attempts": [min(int(failures), most)], "status": [status]})

    own = stream.schema[item].dataType.simpleString()
    return stream.groupBy(item).applyInPandasWithState(step, f"{item} {own}, attempts int, status string", "failures int, done boolean", "update", GroupStateTimeout.NoTimeout)


def last_seen(stream: DataFrame, key: str, time: str) -> DataFrame:
    """Latest heartbeat of each key, as a running aggregate; compare with the clock when read."""
    return stream.groupBy(key).agg(F.max(time).alias("seen"))


def first_requests(stream: DataFrame, scope: str, key: str, time: str, delay: str) -> DataFrame:
    """The first request of each (scope, key) within the watermark: repeats are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([scope, key])


def windowed_counts(stream: DataFrame, time: str, value: str, delay: str, width: str, slide: str | None, *keys: str) -> DataFrame:
    """Extra: tumbling or sliding event-time windows with late data dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, time: str, delay: str, gap: str, *keys: str) -> DataFrame:
    """Extra: session windows per key."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
