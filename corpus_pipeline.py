"""A corpus pipeline: toxicity, near-duplicate removal, redaction, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return
the columns of documents. run() writes each stage's rows to the folder that all
executors share and reads them again, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstrata.llm import bpe, jaccard, mixing, pii, toxicity
from mailstrata.llm.common import dropped, saved, small

#: Near duplicates: words of a shingle and percent of Jaccard similarity.
WORDS, PERCENT = 5, 80
#: The share of ordinary documents that may go with the toxic ones: one that stays weighs more here than in F1.
MOST_LOST = 0.03


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on labelled rows outside the held-out fold, doesn't reject; its thresholds catch the most toxic texts while at most MOST_LOST of ordinary ones go.

    Null and empty texts score 0 and stay; rows that repeat go or stay together; a row without an id is scored like any other. An empty table gives
    no rows, and without labels of both kinds all rows stay. Columns keep their names, whatever these are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    return toxicity.classify(scored, labels, MOST_LOST).where(F.col("predicted") == 0).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id (of several texts under that id the one with the smallest hash).

    A repeated row, with the same id and the same text, stays once; different texts under one id are documents of their own.
    Rows without an id are linked like all others and yield to those that have one. Documents without words are linked with nothing and stay.
    An empty table gives no rows. Columns keep their names, whatever these are.
    """
    rows = saved(jaccard.linked_rows(docs, WORDS, PERCENT).where(F.col("group").isNotNull()), "links")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("first")
    firsts = saved(rows.groupBy("group").agg(first, F.count(F.lit(1)).alias("rows")).select("group", "first.key"), "firsts")
    again = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("key").alias("_again")), "again")
    gone = saved(rows.select(F.col("key").alias("_gone")).distinct().join(firsts, F.col("_gone") == F.col("key"), "left_anti"), "gone")
    dropped(rows, firsts)
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), jaccard.row_key("text").alias("_key"))
    kept = keyed.join(small(gone), F.col("_key") == F.col("_gone"), "left_anti")
    if not again.isEmpty():
        twice = small(again)
        once = kept.join(twice, F.col("_key") == F.col("_again"), "left_semi").dropDuplicates(["_key"])
        kept = kept.join(twice, F.col("_key") == F.col("_again"), "left_anti").unionByName(once)
    return kept.select("_row.*")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind.

    A null text stays null and an empty one empty; n_chars is counted anew; rows that repeat stay as often as they stand. An empty table gives no rows.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it.

    A null source is one of its own; rows without an id share one hash, so they are taken together; a text without words has size 0. An empty table gives no rows.
    """
    return mixing.apply_mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its number of tokens and the digests of its ids and of the bytes they decode to.

    A null or empty text has no tokens. Rows stay as often as they stand; a column named like a new one is replaced. An empty table gives no rows.
    """
    return bpe.encode(docs, *bpe.production(), digest=True).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("pii", redact_pii),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: The classifier can't be expressed in SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(before)  # only the last stage's table stays
    return docs
