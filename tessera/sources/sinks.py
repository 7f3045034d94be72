"""Sinks: sorted JSON lines, write-once folders, guarded CSV, manifests, appended analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import formula_guard


def sorted_json(rows: DataFrame) -> DataFrame:
    """One column of JSON objects with their fields in order."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Committed as a whole by Spark's committer."""
    sorted_json(rows).write.mode("overwrite").text(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Refuses a folder that is there."""
    sorted_json(rows).write.mode("errorifexists").text(path)


def write_error_csv(rows: DataFrame, path: str, also_controls: bool = False) -> None:
    """CSV with formulas made harmless and quotes doubled."""
    text = [c for c, t in rows.dtypes if t == "string"]
    rows.withColumns({c: formula_guard(F.col(c), also_controls) for c in text}).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def error_export(errors: DataFrame, lines: DataFrame, failed: DataFrame) -> DataFrame:
    """Errors (job_id, row, error) with their source lines (job_id, row, source_line), and a row for each job
    (job_id, error) that failed without details."""
    placed = errors.join(lines, ["job_id", "row"], "left").select("job_id", "row", "source_line", "error")
    bare = failed.join(errors.select("job_id").distinct(), "job_id", "left_anti")
    return placed.unionByName(bare.select("job_id", F.lit(None).cast("int").alias("row"), F.lit(None).cast("long").alias("source_line"), "error"))


def content_hash(rows: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)


def manifest(rows: DataFrame, **facts: str) -> DataFrame:
    """Rows, a hash of their content that no order changes, and facts of origin. Row hashes are added up, not gathered."""
    h = F.conv(F.substring(content_hash(rows), 1, 15), 16, 10).cast("decimal(38,0)")
    out = rows.agg(F.count("*").alias("rows"), F.sha2(F.coalesce(F.sum(h), F.lit(0)).cast("string"), 256).alias("content_sha256"))
    return out.withColumns({k: F.lit(v) for k, v in facts.items()})


def analysis_tables(analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, their mentions one a row)."""
    mentions = analyses.select("review_id", "pipeline_version", F.posexplode("tags").alias("ordinal", "t"))
    return analyses.drop("tags"), mentions.select("review_id", "pipeline_version", "ordinal", "t.*")


def append_analyses(analyses: DataFrame, path: str) -> None:
    """Appended to two tables."""
    for name, rows in zip(("runs", "mentions"), analysis_tables(analyses), strict=True):
        rows.write.mode("append").parquet(f"{path}/{name}")


def folder_hash(files: DataFrame) -> DataFrame:
    """One hash of a folder of files (path, content): of each file's, in the order of names. For checkpoints, a few files."""
    each = files.select(F.struct("path", F.sha2("content", 256).alias("hash")).alias("f"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat(f["path"], F.lit("\0"), f["hash"])), "\n"), 256).alias("sha256"))
