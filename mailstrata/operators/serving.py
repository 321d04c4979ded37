"""Report rows and paged queries over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered(df: DataFrame, equal: dict, search: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """df where each given column has its value (None: no filter) and any of columns contains search, whatever its case."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if search:
        any_ = F.lit(False)
        for c in columns:
            any_ = any_ | F.coalesce(F.col(c).cast("string").ilike(f"%{search}%"), F.lit(False))
        df = df.where(any_)
    return df


def page(df: DataFrame, order: list, offset: int, limit: int, most: int = 500) -> DataFrame:
    """Rows offset to offset + limit of a total order; Spark keeps only the first offset + limit rows of each task."""
    if offset < 0 or not 0 < limit <= most:
        raise ValueError(f"offset must not be negative, limit from 1 to {most}")
    return df.orderBy(*order).offset(offset).limit(limit)


def weakest(df: DataFrame, key: str, score: str) -> DataFrame:
    """The key of the lowest score, with scored, lowest, highest; one row, nulls without any score."""
    return df.agg(F.min(F.when(F.col(score).isNotNull(), F.struct(score, key)))[key].alias("headline"), F.count(score).alias("scored"), F.min(score).alias("lowest"), F.max(score).alias("highest"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value, n; blank and null count as UNKNOWN."""
    value = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit("UNKNOWN"))
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def session_rows(sessions: DataFrame, parts: list[DataFrame], found: DataFrame, key: str) -> DataFrame:
    """sessions with the columns of each part (one row per key at most) and n_findings (0 if none)."""
    for p in parts:
        sessions = sessions.join(p, key, "left")
    n = found.groupBy(key).agg(F.count(F.lit(1)).alias("n_findings"))
    return sessions.join(n, key, "left").fillna(0, ["n_findings"])


def unseen(inventory: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return inventory.join(results.select(key).distinct(), key, "left_anti")


def urgent(df: DataFrame, severity: str, kinds: tuple[str, ...] = ("CRITICAL", "HIGH")) -> DataFrame:
    """The urgent rows, or all rows when none is urgent."""
    some = df.where(F.col(severity).isin(list(kinds)))
    none = some.limit(1).agg((F.count(F.lit(1)) == 0).alias("_none"))
    return df.crossJoin(F.broadcast(none)).where(F.col(severity).isin(list(kinds)) | F.col("_none")).drop("_none")


def by_worst(df: DataFrame, key: str, severity: str, order: Column) -> DataFrame:
    """key, worst: the most severe value of each key."""
    return df.groupBy(key).agg(F.min_by(severity, order).alias("worst"))


def increments(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df with increment over the row before, and exponent: log of the ratio of values over that of order's."""
    w = Window.partitionBy(key).orderBy(order)
    before, size = F.lag(value).over(w), F.lag(order).over(w)
    ok = (before > 0) & (F.col(value) > 0) & (size > 0)
    return df.withColumns({"increment": F.col(value) - before, "exponent": F.when(ok, F.round(F.log(F.col(value) / before) / F.log(F.col(order) / size), 6))})


def extent(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, count, sum, min, max: a size profile."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
