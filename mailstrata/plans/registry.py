"""A register of queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers f(tables) under its name; sql: what DuckDB must answer alike."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Tables:
    """tables.orders and so on: Parquet scans, nothing is read before it is needed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def us(c) -> F.Column:
    """Microseconds since 1970; the entry point pins the session's zone to UTC."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt evenly where its scan has fewer splits than the application has cores; a scan of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Partitions up to which a task writes shuffled rows straight to files and holds none of them (spark.shuffle.sort.bypassMergeThreshold).
STRAIGHT = 200


def dealt(df: DataFrame, *key: str, parts: int = 16) -> DataFrame:
    """df by key, in `parts` partitions for each split of its scan: what groups or orders rows of a key needs no other shuffle, and a task's rows don't grow with the table.

    STRAIGHT partitions serve for up to twice their number, so that the scan's tasks hold no rows either.
    """
    n = parts * df.rdd.getNumPartitions()
    return df.repartition(n if n > 2 * STRAIGHT else min(n, STRAIGHT), *key)
