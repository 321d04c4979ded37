"""Dialogue matching in relational form: FIFO and tag matches, as-of state, merges, redaction, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), line: the lines of a text, split at line feeds."""
    return df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))


def fifo_match(commands: DataFrame, replies: DataFrame, key: str, order: str) -> DataFrame:
    """key, n, command_at, reply_at: the n-th reply answers the n-th command; what has no partner keeps a null."""
    w = Window.partitionBy(key).orderBy(order)
    a = commands.select(key, F.row_number().over(w).alias("n"), F.col(order).alias("command_at"))
    b = replies.select(key, F.row_number().over(w).alias("n"), F.col(order).alias("reply_at"))
    return a.join(b, [key, "n"], "full")


def as_of(df: DataFrame, key: str, order: list, state: Column, asks: Column, name: str) -> DataFrame:
    """The rows for which asks holds, with the last non-null state before them."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(state, ignorenulls=True).over(w)).where(asks)


def merged(streams: list[tuple[str, DataFrame]], key: str, order: list[str]) -> DataFrame:
    """All rows of the streams by key in one total order: stream, order_index from 0."""
    out = None
    for name, df in streams:
        part = df.withColumn("stream", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("order_index", F.row_number().over(Window.partitionBy(key).orderBy(*order, "stream")) - 1)


def allowed(value: Column, vocabulary: list[str]) -> Column:
    """The upper-cased value if it is in the vocabulary, else null."""
    up = F.upper(F.trim(value))
    return F.when(up.isin(vocabulary), up)


def evidence_score(greeting: Column, matched: Column, commands: Column, upgrade: Column, foreign: Column) -> Column:
    score = 4 * greeting.cast("int") + 3 * F.least(matched, F.lit(4)) + F.least(commands, F.lit(5)) + 2 * upgrade.cast("int") - 2 * F.least(foreign, F.lit(3))
    return F.greatest(score, F.lit(0)).cast("long")


def elected(df: DataFrame, key: str, score: str, hint: Column, order: Column) -> DataFrame:
    """Of each key the row with the highest score; ties to the hinted one, then by order."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.desc(hint.cast("int")), order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upgrade_state(requested: Column, accepted: Column, rejected: Column, tls_bytes: Column, advertised: Column) -> Column:
    return F.when(accepted & tls_bytes, "TLS_BYTES_OBSERVED").when(accepted, "UPGRADE_ACCEPTED").when(rejected, "UPGRADE_REJECTED").when(requested, "UPGRADE_REQUESTED").when(advertised, "ADVERTISED").otherwise("NOT_OBSERVED")


def handshake_state(fatal: Column, degraded: Column, hrr: Column, server_hello: Column, client_hello: Column, tls13: Column, done: Column, ccs: Column) -> Column:
    return (
        F.when(fatal, "FAILED_ALERT").when(degraded, "INDETERMINATE").when(hrr & ~server_hello, "HELLO_RETRY").when(~client_hello & ~server_hello, "NOT_OBSERVED")
        .when(~server_hello, "CLIENT_HELLO_ONLY").when(~client_hello, "SERVER_ONLY").when(tls13, "NEGOTIATED_ENCRYPTED").when(ccs, "CIPHER_CHANGED").when(done, "SERVER_HELLO_DONE").otherwise("NEGOTIATED")
    )


def forward_secrecy(server_hello: Column, suite_known: Column, tls13: Column, kex: Column, share: Column) -> Column:
    return (
        F.when(~server_hello, "UNKNOWN").when(tls13 & share, "EPHEMERAL_OBSERVED").when(tls13 & (kex == "PSK"), "PSK_ONLY").when(tls13, "UNKNOWN")
        .when(~suite_known, "UNKNOWN").when(kex == "RSA", "STATIC_RSA").when(kex.isin("ECDHE", "DHE"), F.when(share, "EPHEMERAL_OBSERVED").otherwise("CAPABLE"))
        .when(kex == "PSK", "PSK_ONLY").otherwise("NOT_FORWARD_SECRET")
    )
