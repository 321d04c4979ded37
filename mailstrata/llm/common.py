"""Shared helpers of the training-data operators: saved tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts, and what a word is made of.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Rows up to which a dimension table (sources, blocks) is broadcast; above it a shuffle join is used.
BROADCAST_ROWS = 40_000


#: Spark removes the shuffle files of an action when it ends; where the setting is unknown they wait for the driver's garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset and all runs on this machine a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="mailstrata-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, an action's shuffle files go when it ends: what it wrote is a table, which nobody computes again."""
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
    except AnalysisException:
        before = None
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mailstrata/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mailstrata_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Remove tables that saved() wrote, once what was made of them is saved too and nothing will read them again."""
    for t in tables:
        path = getattr(t, "_mailstrata_path", None)
        if path:
            hadoop = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have few rows; df should be a saved or otherwise cheap table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
