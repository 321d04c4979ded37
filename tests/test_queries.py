"""Every query over the smallest tables against its SQL in DuckDB, and the streaming form against the batch one."""

import duckdb
import pandas as pd
import pytest

from mailstrata import contract
from mailstrata.shipping import shipped

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _value(x):
    if x is None or x is pd.NA or isinstance(x, float) and x != x:
        return "-"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    return repr(round(float(x), 9)) if isinstance(x, (int, float)) or type(x).__name__.startswith(("int", "uint", "float")) else str(x)


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_value, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(contract.QUERIES))
def test_query(spark, duck, name):
    got = contract.QUERIES[name](shipped(spark), SF).toPandas()
    if name not in contract.ORACLES:
        assert len(got)
        return
    want = duck.sql(contract.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_streaming_sessions_agree_with_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from mailstrata.streaming.sessions import idle_sessions

    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    far = spark.sql("SELECT -1L AS user_id, timestamp'2100-01-01' AS ts")  # moves the watermark past all sessions
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = idle_sessions(stream, "user_id", "ts").writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        far.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("SELECT user_id, first_at, last_at, n FROM sessions_out").collect())
    finally:
        q.stop()
    assert got == sorted(tuple(r) for r in idle_sessions(events, "user_id", "ts").collect())


def test_outcomes_are_never_null(spark):
    from pyspark.sql import functions as F

    from mailstrata.operators import rules
    from mailstrata.plans import assessment
    from mailstrata.plans.registry import Tables

    facts = assessment.facts(Tables(spark, SF))
    value = lambda f: F.lit("x") if f.name in ("capture_id", "session_id") else F.lit(None).cast(f.dataType)
    nulls = spark.range(1).select(*[value(f).alias(f.name) for f in facts.schema.fields])
    got = rules.evaluate(nulls).collect()
    assert len(got) == 25 and all(r["outcome"] in ("NOT_APPLICABLE", "UNKNOWN") for r in got)
    assert rules.score(rules.units(rules.evaluate(nulls)), ["session_id"]).first()["status"] == "SCORE_UNAVAILABLE"


def test_overrides_change_the_policy_fingerprint(spark):
    from mailstrata.operators.rules import Policy

    assert len({Policy().fingerprint(), Policy(minimum_version=0x0304).fingerprint(), Policy(disabled=("CERT-001",)).fingerprint()}) == 3
