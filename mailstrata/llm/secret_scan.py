"""Secret scans by an incremental blob ledger.

Every version of a text is addressed by its SHA-256. The ledger says which blobs were
scanned under which version of the rules; a scan reads only the blobs whose pair with the
present version is not in it, whatever number of paths or versions hold them, and findings
go back to all paths by the blob's address.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shared_dir, shuffles_removed, small
from .spans import digest, joined, with_matches

#: Named in the ledger: raise it with any change of the rules below.
RULES_VERSION = "2026.1"
BASE = ("assign", "access", "hex")
KINDS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "forge": r"gh[pousr]_[A-Za-z0-9]{36,255}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
LEDGER = "blob string, rules string, spans array<struct<start:int,rank:int,end:int,kind:string>>"


def scan(blobs: DataFrame, text: str = "text") -> DataFrame:
    """blobs with spans: every finding by start, then by kind as listed; a null or empty text has none."""

    def of(rank: int, kind: str):
        found = F.col(f"_{kind}")
        if kind == "assign":
            found = F.filter(found, lambda s: F.length(F.regexp_extract(s["hit"], KINDS["assign"], 2)) >= 12)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    found = with_matches(blobs, F.coalesce(F.col(text), F.lit("")), {f"_{k}": p for k, p in KINDS.items()}, 1)
    return found.select(*[c for c in blobs.columns if c != "spans"], F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(KINDS)])).alias("spans"))


class BlobLedger:
    """A ledger kept as Parquet under a path that all executors share; appended to, never rewritten."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LEDGER)

    def unseen(self, versions: DataFrame, text: str = "text", rules: str = RULES_VERSION) -> DataFrame:
        """blob, text: one row for each distinct text whose (blob, rules) pair the ledger lacks.

        Addresses the ledger knows are left behind before any text moves. Of the rest, copies meet in the map-side half
        of the aggregation, so a text that a third of all rows hold moves once per task.
        """
        rows = versions.select(address(text).alias("blob"), F.col(text).alias("text"))
        known = self.entries().where(F.col("rules") == rules).select("blob").distinct()
        if not known.isEmpty():
            fresh = saved(rows.select("blob").distinct().join(known, "blob", "left_anti"), "unseen")
            rows = rows.join(small(fresh), "blob", "left_semi")
        return rows.groupBy("blob").agg(F.first("text").alias("text"))

    def ingest(self, versions: DataFrame, text: str = "text", rules: str = RULES_VERSION) -> None:
        """Scan what is unseen and append it. An interrupted run appends nothing and can be repeated."""
        new = scan(self.unseen(versions, text, rules)).select("blob", F.lit(rules).alias("rules"), "spans")
        with shuffles_removed(self.spark):
            new.write.mode("append").parquet(self.path)

    def findings(self, versions: DataFrame, text: str = "text", rules: str = RULES_VERSION) -> DataFrame:
        """versions with spans (empty if none) for every row; text is left out. All versions must have been ingested.

        Only blobs with findings are joined, and a blob that many rows hold is split by Spark's skew join.
        """
        found = self.entries().where((F.col("rules") == rules) & (F.size("spans") > 0)).dropDuplicates(["blob"])
        found = saved(found.select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans")), "findings")
        rows = versions.withColumn("_at", address(text)).drop(text)
        out = rows.join(found, F.col("_at") == F.col("_blob"), "left")
        none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
        keep = [c for c in rows.columns if c not in ("_at", "spans")]
        return out.select(*keep, F.coalesce("_spans", none).alias("spans"))


def address(text: str):
    """The content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """A fresh ledger takes in all documents as versions; then findings are joined back to every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = BlobLedger(spark, f"{shared_dir(spark)}/mailstrata/blob-ledger-{uuid.uuid4().hex}")
    ledger.ingest(docs)
    found = ledger.findings(docs)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [_count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, digest(base).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


_DUCK_PATTERNS = {"assign": KINDS["assign"].replace("'", "''"), "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "pem": KINDS["pem"], "forge": KINDS["forge"], "jwt": KINDS["jwt"]}
_DUCK_KEEP = {"assign": f"length(regexp_extract(hit, '{_DUCK_PATTERNS['assign']}', 2)) >= 12", "access": "length(hit) >= 18", "hex": "length(hit) >= 16"}


def _duck(rank: int, kind: str) -> str:
    p = _DUCK_PATTERNS[kind]
    return rf"""
SELECT id, {rank} AS rank, '{kind}' AS kind, s, s + length(hit) AS e FROM (
  SELECT id, m[i + 1] AS hit, CAST(list_sum(list_transform(p[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT id, unnest(range(len(m))) AS i, m, p FROM (
    SELECT id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM d WHERE regexp_matches(t, '{'[0-9a-f]{16}' if kind == 'hex' else p}'))))
WHERE {_DUCK_KEEP.get(kind, 'true')}"""


ORACLE = (
    "WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + " UNION ALL ".join(_duck(i, k) for i, k in enumerate(KINDS))
    + """), g AS (
  SELECT id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM f GROUP BY id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (id)
"""
)
