"""Mixing sources to target weights by hash-threshold histograms.

Every row has a hash of its id. Sizes are summed by (source, leading hash bits);
the running sum shows the one bucket in which a source's budget runs out, and
only the rows of that bucket are summed again by their next bits. What is left
is one hash bound for each source, so rows are chosen by a filter: nothing is
sorted, and no row but the ids, sizes and hashes is ever moved. Bounds nest: a
larger budget takes all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small, word_count

#: Hash bits in all, and those that one round of histograms resolves.
HASH_BITS, STEP_BITS = 60, 12
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0


def hash60(col, seed: str = "mix"):
    """The first 60 bits of an MD5, as every engine computes it; null counts as an empty id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """skey, source, source_size -> with target: share of all sizes by weight, each stopped at cap times its source.

    One row for each source; weights repeat over the sources by code point, null last.
    Sources by rising cap for a unit of weight: those before the first that the
    remaining budget doesn't fill are at their cap, the others share what is left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_i") % len(weights) + 1)
    s = sizes.withColumn("_i", (F.row_number().over(by_name) - 1).cast("int")).withColumn("_w", pick)
    s = s.withColumn("_cap", F.lit(float(cap)) * F.col("source_size")).withColumn("_r", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_r", "_i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(whole)
    left = budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    s = s.withColumn("_level", left / weight).withColumn("_capped", F.col("_r") <= F.col("_level"))
    level = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(whole)
    s = s.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * level))
    return s.select("skey", "source", "source_size", "target")


def thresholds(base: DataFrame, goal: DataFrame) -> DataFrame:
    """skey, copies, bound: every row of the source is taken copies times, and once more if its hash is under bound.

    base: skey, size, h (saved). goal: skey, source_size, target. The rows of one hash are
    taken together or not, as comes nearer to the target.
    """
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goal.select("skey", "source_size", "target", ratio.alias("copies")).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    # at: the hash bits found so far; below: sizes of the rows whose hash is under at; rows: those whose hash begins with at
    state = saved(state.select("skey", "copies", "rest", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("below"), F.lit(2).cast("long").alias("rows"), F.lit(0).cast("long").alias("inside")), "mix-state")
    done = 0
    while done < HASH_BITS:
        shift = HASH_BITS - done
        done += STEP_BITS
        inside = base.join(small(state), "skey").where(F.shiftright("h", shift) == F.col("at"))
        hist = inside.groupBy("skey", "copies", "rest", "below", F.shiftright("h", HASH_BITS - done).alias("bucket")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
        w = Window.partitionBy("skey").orderBy("bucket")
        hist = hist.withColumn("upto", F.col("below") + F.sum("size").over(w)).withColumn("last", F.max("bucket").over(Window.partitionBy("skey")))
        over = F.col("upto") > F.col("rest")
        # the first bucket whose running sum exceeds the budget, or else the last one
        first = hist.where(over | (F.col("bucket") == F.col("last"))).groupBy("skey").agg(F.min(F.struct((~over).alias("none"), "bucket", "copies", "rest", "upto", "size", "rows")).alias("x"))
        state = saved(first.select("skey", "x.copies", "x.rest", F.col("x.bucket").alias("at"), (F.col("x.upto") - F.col("x.size")).alias("below"), "x.rows", F.col("x.size").alias("inside")), "mix-state")
        if (state.agg(F.max("rows")).first()[0] or 0) <= 1:
            break
    taken = (F.col("below") + F.col("inside") <= F.col("rest")) | (2 * (F.col("rest") - F.col("below")) >= F.col("inside"))
    return state.select("skey", "copies", F.shiftleft(F.col("at") + taken.cast("long"), HASH_BITS - done).alias("bound"))


def mix(docs: DataFrame, size=None, source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, share=SHARE, cap=CAP, seed: str = "mix") -> DataFrame:
    """doc_id, source, h, size, source_size, target, copies, taken for every row of docs.

    A null text has size 0, a null source is a source of its own, a row repeated is taken
    as often as its twin, an empty table gives no rows; other columns are not looked at.
    """
    size = word_count(F.col("text")) if size is None else size
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    base = saved(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("skey"), size.alias("size"), hash60(F.col(doc_id), seed).alias("h")), "mix-base")
    sizes = base.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = saved(targets(sizes, weights, share, cap), "mix-goal")
    plan = saved(thresholds(base, goal).join(goal.select("skey", "source_size", "target"), "skey"), "mix-plan")
    copies = F.col("copies") + (F.col("h") < F.col("bound")).cast("long")
    return base.join(small(plan), "skey").select("doc_id", "source", "h", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the same columns, whatever their names. A null source is one of its own, rows without words are taken with their source, an empty table gives no rows."""
    plan = mix(docs, **kw)
    bounds = plan.groupBy("source").agg(F.max(F.when(F.col("copies") > 0, F.struct("copies", "h"))).alias("top"), F.min("copies").alias("least"))
    bounds = saved(bounds.select(F.col("source").alias("_source"), F.col("least").alias("_least"), F.col("top.copies").alias("_most"), F.col("top.h").alias("_last")), "mix-bounds")
    # a row travels as one column, so its names meet none of the plan's
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_of"), hash60(F.col("doc_id"), kw.get("seed", "mix")).alias("_h"))
    copies = F.when((F.col("_most") > F.col("_least")) & (F.col("_h") <= F.col("_last")), F.col("_most")).otherwise(F.col("_least")).cast("int")
    out = rows.join(small(bounds), F.col("_of").eqNullSafe(F.col("_source"))).select("_row", copies.alias("_copies"))
    return out.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
sizes AS (SELECT skey, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY skey),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sizes),
weighed AS (SELECT *, CAST([5.0, 2.0, 1.0][CAST(i % 3 + 1 AS INT)] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM named),
ranked AS (SELECT *, cap / w AS r FROM weighed),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM ranked WINDOW b AS (ORDER BY r, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT skey, source_size, CASE WHEN r <= level THEN cap ELSE w * max(CASE WHEN r > level THEN level END) OVER () END AS target FROM levels),
budget AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM goal),
running AS (SELECT b.*, g.source_size, g.target, g.copies, g.target - g.copies * g.source_size AS rest,
         sum(size) OVER (PARTITION BY b.skey ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY b.skey, h) AS same
  FROM base b JOIN budget g USING (skey))
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN upto <= rest OR (upto - same <= rest AND 2 * (rest - (upto - same)) >= same) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""
