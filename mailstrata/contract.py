"""Queries over the given tables, by name, with the SQL that each is held against."""

from __future__ import annotations

from .plans import assessment, evidence, inventory, models, packets, pages, profiles, relations, streams
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "OWN_SETTINGS", "QUERIES", "SETTINGS", "flagship"]
#: Settings that queries run with: one zone, and no generated function that is too long for the JVM to compile (beyond 8 000 bytes it stays interpreted).
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000"}
#: Settings of single queries, where the user has set nothing. Nearly all of session_ids' result is hexadecimal digits, four bits in each byte: zstd stores them in half of what snappy takes, its first level in less than its third,
#: and pages of the second version keep lengths and the prefixes of ids apart from the digits.
OWN_SETTINGS = {"session_ids": {"spark.sql.parquet.compression.codec": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.writer.version": "v2"}}
_PLANS = (assessment, evidence, inventory, models, packets, pages, profiles, relations, streams)


def flagship(spark, sf_dir: str):
    """The posture score of every session: rules, units, weights, coverage, band."""
    return QUERIES["posture_score"](spark, sf_dir)
