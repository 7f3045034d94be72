"""Lines of large files with their exact ordinals, read in splits by all executors, under budgets and in batches.

Spark's text reader cuts files at line ends; a split's lines come in order, so a line's place in its split is known from a
running number. A first pass counts lines and bytes per split, prefix sums over the splits (a row for each, in the
order of file names) say how many lines and bytes stand before, and a second pass adds them. Nothing is sorted, and no line
moves: only the table of splits is broadcast, behind a count of it. A budget of bytes ends inside one split; only that one is summed line by
line. Compressed files are one split each, and their bytes are those of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_SPLITS = 1_000_000


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, split, size (of the file), at (rises within a split); lines end at line feeds alone."""
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at")
    )


def _splits(lines: DataFrame, keep: Column) -> DataFrame:
    """A row for each split: its first number, lines, kept lines and bytes, and how many of each stand before it."""
    length = F.octet_length("value").cast("long") + 1
    one = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("lines"), F.count_if(keep).alias("kept"), F.sum(length).alias("length"), F.max("size").alias("size"), F.max(F.col("file").rlike(r"\.(gz|bz2|zst|lz4|snappy)$")).alias("packed"))
    in_file = F.coalesce(F.sum("length").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The last line of a file may lack its end, which the length counts.
    bytes_ = F.when(F.col("packed"), F.col("length")).otherwise(F.least("length", F.col("size") - F.col("in_file")))
    one = one.withColumn("in_file", in_file).withColumn("bytes", bytes_)
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)  # splits, not lines
    return one.select("file", "split", "first", "lines", "kept", "bytes", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lines", "kept", "bytes")))


def _known(lines: DataFrame, splits: DataFrame) -> DataFrame:
    told = F.broadcast(splits) if splits.limit(MOST_SPLITS + 1).count() <= MOST_SPLITS else splits
    return lines.join(told.withColumnRenamed("bytes", "split_bytes"), ["file", "split"])


_ORDINAL = "lines_before + at - first + 1"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1, over all files in the order of their names) and value."""
    lines = raw_lines(spark, path)
    return _known(lines, _splits(lines, F.lit(False))).selectExpr(f"{_ORDINAL} as line", "value")


def bounded(spark: SparkSession, path: str, max_rows: int | None = None, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(line, value, malformed) of the lines within both budgets, and one row with rows and stop_reason.

    A line counts against the bytes with its end; one that is cut by the budget is left out. Malformed lines keep
    their number and lose their value.
    """
    most_rows, most_bytes = (1 << 62 if x is None else x for x in (max_rows, max_bytes))
    lines = raw_lines(spark, path)
    splits = _splits(lines, F.lit(False))
    known = _known(lines, splits).withColumn("line", F.expr(_ORDINAL))
    end = F.col("bytes_before") + F.col("split_bytes")
    whole = known.where(end <= most_bytes).select("line", "value")
    # The split in which the bytes run out: its lines are summed in order, one split's worth in one task.
    edge = known.where((end > most_bytes) & (F.col("bytes_before") < most_bytes))
    run = F.sum(F.octet_length("value").cast("long") + 1).over(Window.partitionBy("file", "split").orderBy("at"))
    edge = edge.withColumn("end", F.least(F.col("bytes_before") + run, end)).where(F.col("end") <= most_bytes).select("line", "value")
    fit = whole.unionByName(edge)
    good = F.coalesce(F.is_valid_utf8("value") & F.try_parse_json("value").isNotNull(), F.lit(False))
    rows = fit.where(F.col("line") <= most_rows).select("line", F.when(good, F.rtrim(F.col("value"), F.lit("\r"))).alias("value"), (~good).alias("malformed"))
    total = splits.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    said = fit.agg(F.count("*").alias("fit")).crossJoin(total)  # one row each
    reason = F.when(F.col("fit") >= most_rows, "row_limit").when(F.col("bytes") > most_bytes, "byte_limit").otherwise("end_of_file")
    return rows, said.select(F.least("fit", F.lit(most_rows)).alias("rows"), reason.alias("stop_reason"))


def in_batches(spark: SparkSession, path: str, keep: Column, size: int = 500) -> DataFrame:
    """line, batch (from 0) and value of the lines that `keep` (of value) holds true: `size` of them a batch, in order.

    A resumed import reads the batches from its next one on: `where batch >= n`.
    """
    lines = raw_lines(spark, path)
    known = _known(lines, _splits(lines, F.coalesce(keep, F.lit(False)))).where(F.coalesce(keep, F.lit(False)))
    # Kept lines of one split, counted in order; splits are bounded by spark.sql.files.maxPartitionBytes.
    nth = F.col("kept_before") + F.row_number().over(Window.partitionBy("file", "split").orderBy("at"))
    return known.withColumn("nth", nth).select(F.expr(_ORDINAL).alias("line"), F.floor((F.col("nth") - 1) / size).alias("batch"), "value")
