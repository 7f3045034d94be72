"""Sessions, and getting the package to the executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Let executors import the package where their PYTHONPATH doesn't have it; once a context."""
    on_path = (os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)
    sc = spark.sparkContext
    if str(ROOT.parent) in on_path or getattr(sc, "_tessera_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    sc.addPyFile(str(path))
    sc._tessera_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's `spark.checkpoint.dir`; a private folder only in local mode, where none is named (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("on a cluster, name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-ckpt-"))


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the context's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


ROWS_OF_TASK = 400_000


def dealt(rows: int, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Tables dealt by their keys to as many tasks as ask for ROWS_OF_TASK of `rows`, where the session's number would give a task more.

    Joins by these keys, and groupings by more columns than them, stand on this exchange. Without it a task's rows grow
    with the table while `spark.sql.shuffle.partitions` stays.
    """
    spark = tables[0][0].sparkSession
    wanted = -(-rows // ROWS_OF_TASK)
    if wanted <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return [t for t, _ in tables]
    return [t.repartition(wanted, key) for t, key in tables]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and drop its lineage; its shuffle files go at once.

    Spark removes the shuffle files of a plan that was made under `CLEANUP` when its action ends. The plan is made anew
    for that, so that `df` itself may be used again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        once = df.select("*")
    finally:
        spark.conf.set(CLEANUP, before)
    return once.checkpoint(eager=True)


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster, spark-submit sets these."""
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
