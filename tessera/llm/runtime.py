"""Session helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut  # noqa: F401  the operators take it from here

# Fixed value: the separators of `[^\x20\x09-\x0D]+` words.
WORD = r"[^\x20\x09-\x0D]+"


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """`df`, to be broadcast if it is counted to be small; else joined as Spark sees fit. Count a cut frame."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_column(text: str = "text"):
    """Number of words, natively; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0))


def text_volume(docs: DataFrame, text: str = "text") -> int:
    """Total bytes of text, from one narrow scan."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()[0])
