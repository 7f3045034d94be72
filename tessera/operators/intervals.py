"""Joins of two tables on overlapping intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranks import MOST_BROADCAST

ROWS_OF_BLOCK = 4096
ROWS_OF_KEY = 256


def _level(length: Column) -> Column:
    """The least power of two that is not below the length: an interval touches two cells of that level at most."""
    n = F.length(F.bin(length - 1))
    return F.when(length <= 1, 0).otherwise(n).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level)


def _sided(rows: DataFrame, key: list[str], start: str, end: str, side: str) -> DataFrame:
    a, b = F.col(start).cast("long"), F.col(end).cast("long")
    row = F.struct(*rows.columns).alias(side)
    whole = reduce(lambda p, q: p & q, (F.col(k).isNotNull() for k in key), b > a)
    return rows.where(whole).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), row, a.alias(f"{side}_a"), b.alias(f"{side}_b"), _level(b - a).alias(f"{side}_level"))


def _pairs(home: DataFrame, probe: DataFrame, key: list[str], h: str, p: str, lower: bool) -> DataFrame:
    """Pairs whose home row stands on a level not below the probe's (`lower`: above it)."""
    cells = lambda s, level: F.explode(F.sequence(_cell(F.col(f"{s}_a"), level), _cell(F.col(f"{s}_b") - 1, level))).alias("cell")
    levels = home.agg(F.collect_set(f"{h}_level").alias("all"))  # one row, 63 levels at most
    at = [*key, "level", "cell"]
    stands = home.select("*", F.col(f"{h}_level").alias("level"), cells(h, F.col(f"{h}_level")))
    full = stands.groupBy(*at).agg(F.count("*").alias("rows")).where(F.col("rows") > ROWS_OF_BLOCK).select(*at, F.ceil(F.col("rows") / ROWS_OF_BLOCK).cast("int").alias("blocks"))
    full = full.select(*(F.col(c).alias(f"f_{c}") for c in at), "blocks")
    crowded = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in at]
    asks = probe.crossJoin(F.broadcast(levels)).select(*probe.columns, F.explode(F.filter("all", lambda x: x > F.col(f"{p}_level") if lower else x >= F.col(f"{p}_level"))).alias("level"))
    asks = asks.select("*", cells(p, F.col("level")))
    blocks = F.coalesce("blocks", F.lit(1))
    stands = stands.join(full, crowded, "left").select(*stands.columns, F.pmod(F.xxhash64(h), blocks).cast("int").alias("block"))
    asks = asks.join(full, crowded, "left").select(*asks.columns, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    both = stands.join(asks, [*at, "block"])
    later = F.greatest("x_a", "y_a")  # inside both, so one cell finds the pair
    return both.where((F.col("x_a") < F.col("y_b")) & (F.col("x_b") > F.col("y_a")) & (F.col("cell") == _cell(later, F.col("level")))).select("x", "y")


def overlapping_pairs(a: DataFrame, b: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Pairs (x: row of a, y: row of b) of one key with x.start < y.end and x.end > y.start; each pair once.

    start and end cast to long (dates: pass day numbers) and are half open; empty, reversed and null intervals overlap nothing, and null
    keys match nothing. A key with ROWS_OF_KEY rows at most, both sides counted, meets as it is. Those with more meet by cells, which have widths of powers of two: an interval stands in the one or two cells of the level of its own
    length, and asks at each level that the other side has and that is not below its own, so a long interval is
    two rows, not one for each short cell it covers. A cell with many standing rows is split into blocks of ROWS_OF_BLOCK by a hash
    of the row, which every asking row visits: a hot key is as many tasks as it has blocks. Rows equal in all columns stay in one block.
    """
    names = [f"_k{i}" for i in range(len(key))]
    x, y = _sided(a, key, start, end, "x"), _sided(b, key, start, end, "y")
    if not key:
        return _pairs(x, y, names, "x", "y", False).unionByName(_pairs(y, x, names, "y", "x", True))
    meet = lambda p, q: p.select(*names, "x").join(q.select(*names, "y"), names).where((F.col(f"x.{start}") < F.col(f"y.{end}")) & (F.col(f"x.{end}") > F.col(f"y.{start}"))).select("x", "y")
    crowded = cut(x.select(*names).unionByName(y.select(*names)).groupBy(*names).agg(F.count("*").alias("rows")).where(F.col("rows") > ROWS_OF_KEY).select(*names))
    keys = crowded.limit(MOST_BROADCAST + 1).count()
    if not keys:
        return meet(x, y)
    crowded = F.broadcast(crowded) if keys <= MOST_BROADCAST else crowded  # of counted size
    few, many = ([rows.join(crowded, names, how) for rows in (x, y)] for how in ("left_anti", "left_semi"))
    return meet(*few).unionByName(_pairs(*many, names, "x", "y", False)).unionByName(_pairs(*many[::-1], names, "y", "x", True))
