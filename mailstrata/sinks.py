"""Results as files: partitioned Parquet, JSON lines, and one self-contained HTML page of bounded size."""

from __future__ import annotations

import html
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that a switch leaves out of JSON: byte runs and dialogue events.
SEGMENTS, EVENTS = ("runs", "gaps"), ("events",)
#: Columns that never leave in a report: certificates as they were sent.
RAW = ("chain_der",)


def write_json(df: DataFrame, path: str, segments: bool = True, events: bool = True) -> None:
    """A JSON line for each row, nulls left out, written by the executors."""
    left_out = list(RAW) + ([] if segments else list(SEGMENTS)) + ([] if events else list(EVENTS))
    df.drop(*left_out).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def replace_rows(df: DataFrame, path: str, investigation: str) -> None:
    """All rows of one investigation anew; those of others stay. A run that breaks off leaves the old rows in force."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.withColumn("investigation_id", F.lit(investigation)).write.mode("overwrite").partitionBy("investigation_id").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def render_html(title: str, tables: dict[str, DataFrame], rows: int = 500) -> str:
    """A page with the first rows of each table and their whole number; every value is escaped, nothing is loaded from elsewhere."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        shown, total = df.limit(rows).collect(), df.count()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in shown)
        out.append(f"<h2>{html.escape(name)}</h2><p>{len(shown)} of {total} rows</p><table><tr>{head}</tr>{body}</table>")
    return "".join(out)


def work_folder(spark) -> str:
    """A new folder that the driver and all executors share: under spark.checkpoint.dir, or where that is unset and all runs on this machine a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="mailstrata-")
    return f"{found.rstrip('/')}/mailstrata/work-{uuid.uuid4().hex}"
