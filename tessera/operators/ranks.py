"""Exact ranks and selections where a key, or the table, is too large for one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BINS = 16384
SALTS = 32
MOST_BROADCAST = 100_000


def numbered(rows: DataFrame, order: Sequence[Column | str], key: Sequence[str] = (), name: str = "nth") -> DataFrame:
    """Adds `name`: the place of each row in the order of its key (of the table without one), from 1; ties in any order.

    Equal to a `row_number` over the key, but no task holds a key: rows are dealt by ranges of (key, order) and sorted there,
    so that a place is the place in the range plus what the key has in earlier ranges. Counts of a key are one row per range.
    Null keys are a key; an empty table stays empty. Columns whose names begin with `_rank_` are the operator's own.
    """
    columns = rows.columns
    by = [F.col(k) for k in key] + [F.col(o) if isinstance(o, str) else o for o in order]
    at = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_rank_at", F.monotonically_increasing_id()))
    at = at.withColumn("_rank_range", F.shiftright("_rank_at", 33))
    own = [F.col(k).alias(f"_rank_k{i}") for i, k in enumerate(key)]
    names = [f"_rank_k{i}" for i in range(len(key))]
    runs = at.groupBy(*own, F.col("_rank_range").alias("_rank_r")).agg(F.min("_rank_at").alias("_rank_first"), F.count("*").alias("_rank_n"))
    earlier = Window.partitionBy(*names).orderBy("_rank_r").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of a key
    runs = runs.withColumn("_rank_before", F.coalesce(F.sum("_rank_n").over(earlier), F.lit(0)))
    same = [F.col("_rank_range") == F.col("_rank_r"), *(F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names))]
    place = F.col("_rank_at") - F.col("_rank_first") + F.col("_rank_before") + 1
    return at.join(runs, reduce(lambda a, b: a & b, same)).select(*columns, place.alias(name))


def bag_join(left: DataFrame, right: DataFrame, key: Sequence[str], left_order: Sequence[Column | str], right_order: Sequence[Column | str]) -> DataFrame:
    """Matches bags: the k-th row of a key on the left takes the k-th on the right, each used once; else nulls.

    The right side's columns that are not in `key` follow the left side's; clashing names are the caller's to change.
    Keys that are null match nothing.
    """
    a = numbered(left, left_order, key, "_nth")
    b = numbered(right.where(reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in key))), right_order, key, "_nth")
    return a.join(b, [*key, "_nth"], "left").drop("_nth")


def _octaves(v: Column) -> Column:
    """A finite number that never falls as a value grows: its sign times its place among the powers of two; NaN comes last."""
    size = F.coalesce(F.log2(F.abs(v)) + 1075, F.lit(0.0))
    return F.when(F.isnan(v), 3000.0).otherwise(F.signum(v) * F.least(size, F.lit(2500.0)))


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """Which of BINS parts of lo..hi a value is in: equal ones within a power of two, else equal in powers of two.

    So a few passes do for any spread. The ends have parts of their own: each pass gets on.
    """
    share = lambda x, y, z: F.coalesce(F.try_divide(x - y, z - y), F.lit(0.0))
    near = (F.signum(lo) == F.signum(hi)) & (F.abs(F.abs(hi) - F.abs(lo)) <= F.least(F.abs(lo), F.abs(hi)))
    part = F.when(near, share(v, lo, hi)).otherwise(share(_octaves(v), _octaves(lo), _octaves(hi)))
    inner = F.least(F.greatest(part * BINS, F.lit(1.0)), F.lit(float(BINS)))
    return F.when(v == lo, 0).when(v == hi, BINS + 1).otherwise(F.floor(inner)).cast("int")


def selected(rows: DataFrame, value: str, key: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
    """key, name, value (double): the exact value at a 1-based rank of each key; nulls are left out of the ranks.

    ranks: name -> rank, a column over `n`, the number of values; below 1 or above n it gives no row. Selection by histograms:
    each pass counts the values between the bounds of the wanted rank in BINS parts and narrows the bounds to the
    least and the greatest value of the part that holds it, until they meet. A pass shuffles partial counts, a key is at most
    BINS + 2 rows of a window, and only bounds are kept. NaN is the greatest value, as Spark orders it.
    """
    names = [f"_k{i}" for i in range(len(key))] or ["_k0"]
    own = [F.col(k).alias(n) for k, n in zip(key, names)] or [F.lit(0).alias("_k0")]
    types = [rows.schema[k].dataType for k in key]
    base = rows.select(*own, F.col(value).cast("double").alias("v")).where("v is not null")
    per = base.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), c.cast("long").alias("rank")) for k, c in ranks.items()))).alias("w")
    now = cut(per.select(*names, "n", "lo", "hi", each).where("w.rank between 1 and n").select(*names, "w.name", "w.rank", "lo", "hi"))
    done = []
    while True:
        done.append(now.where("lo = hi").select(*names, "name", F.col("lo").alias("value")))
        now = now.where("lo <> hi")
        open_keys = now.limit(MOST_BROADCAST + 1).count()
        if not open_keys:
            break
        bounds = now.select(*(F.col(n).alias(f"b{n}") for n in names), "lo", "hi").distinct()
        match = [F.col(n).eqNullSafe(F.col(f"b{n}")) for n in names]
        values = base
        if open_keys <= MOST_BROADCAST:
            bounds = F.broadcast(bounds)  # of counted size
        else:  # a hot key is dealt by its input partition, its bounds go to each
            values = base.withColumn("salt", F.spark_partition_id() % SALTS)
            bounds = bounds.withColumn("bsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            match.append(F.col("salt") == F.col("bsalt"))
        inside = values.join(bounds, reduce(lambda a, b: a & b, match) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        group = [*names, "lo", "hi"]
        bins = inside.groupBy(*group, _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        bins = bins.withColumn("upto", F.sum("c").over(Window.partitionBy(*group).orderBy("bin")))
        both = now.alias("t").join(bins.alias("b"), reduce(lambda a, b: a & b, (F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group)))
        both = both.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
        now = cut(both.select(*(F.col(f"t.{n}").alias(n) for n in names), "name", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("low").alias("lo"), F.col("high").alias("hi")))
    out = reduce(DataFrame.unionByName, done)
    return out.select(*(F.col(n).cast(t).alias(k) for n, k, t in zip(names, key, types)), "name", "value")
