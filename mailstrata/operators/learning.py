"""Frequency models, encodings, metrics and explanations over session features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_hot(value: Column, vocabulary: list[str]) -> Column:
    """Doubles for each word of a fixed vocabulary, then for any other value, then for none."""
    known = value.isin(vocabulary)
    return F.array(*[F.when(value == v, 1.0).otherwise(0.0) for v in vocabulary], F.when(value.isNotNull() & ~known, 1.0).otherwise(0.0), F.when(value.isNull(), 1.0).otherwise(0.0))


def scaled(value: Column, scale: float, most: float = 2.0) -> Column:
    """The value over its scale up to most, and whether it is missing."""
    return F.array(F.coalesce(F.least(value / scale, F.lit(most)), F.lit(0.0)), F.when(value.isNull(), 1.0).otherwise(0.0))


def rarity(rows: DataFrame, reference: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """rows with frequency (share of the reference with the same values, 0 if none) and anomalous."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("<MISSING>")).alias(f"_{c}") for c in columns]
    total = reference.agg(F.count(F.lit(1)).alias("_total"))
    seen = reference.select(*keys).groupBy(*[f"_{c}" for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    x = rows.select("*", *keys).join(seen, [f"_{c}" for c in columns], "left").crossJoin(F.broadcast(total))
    freq = F.coalesce(F.col("_n") / F.col("_total"), F.lit(0.0))
    return x.withColumn("frequency", freq).withColumn("anomalous", freq <= threshold).drop(*[f"_{c}" for c in columns], "_n", "_total")


def threshold_pick(scores: DataFrame, score: str, label: str, max_fpr: float = 0.2) -> DataFrame:
    """threshold, f1, fpr: of all cuts (score <= cut is positive) with a bearable false positive rate the one of largest F1, then lower rate, then lower cut.

    Counts are made per distinct score first; only distinct scores are ordered.
    """
    by = scores.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("n"))
    w = Window.orderBy(score)
    x = by.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("n").over(w)})
    x = x.crossJoin(F.broadcast(by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))))
    x = x.withColumns({"f1": 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_p")), "fpr": F.col("fp") / F.greatest(F.col("all_n"), F.lit(1))}).where(F.col("fpr") <= max_fpr)
    best = x.agg(F.max(F.struct(F.col("f1"), (-F.col("fpr")).alias("f"), (-F.col(score)).alias("s"))).alias("b"))
    return best.select((-F.col("b.s")).alias("threshold"), F.col("b.f1").alias("f1"), (-F.col("b.f")).alias("fpr"))


def binary_metrics(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1; what is undefined is null."""
    x = rows.agg(*[F.count_if(c).alias(n) for n, c in (("tp", predicted & actual), ("fp", predicted & ~actual), ("tn", ~predicted & ~actual), ("fn", ~predicted & actual))])
    ratio = lambda a, b: F.when(b > 0, F.bround(a / b, 4))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return x.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def class_metrics(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """class, support, predicted, correct, precision, recall, f1 for every class that appears."""
    cells = rows.groupBy(F.col(predicted).alias("p"), F.col(actual).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    a = cells.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("p") == F.col("a"), F.col("n")).otherwise(0)).alias("correct"))
    p = cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    x = a.join(p, "class", "full").fillna(0, ["support", "correct", "predicted"])
    ratio = lambda u, v: F.when(v > 0, F.bround(u / v, 4))
    return x.withColumns({"precision": ratio(F.col("correct"), F.col("predicted")), "recall": ratio(F.col("correct"), F.col("support")), "f1": ratio(2 * F.col("correct"), F.col("support") + F.col("predicted"))})


#: Distinct values of a feature up to which their counts are broadcast; beyond, Spark joins them as it sees fit.
BROADCAST_VALUES = 40_000


def explain(rows: DataFrame, key: str, features: list[str], k: int) -> DataFrame:
    """For each row its k rarest feature values: key, rank, feature, value, frequency; ties by feature name, a missing value has frequency 1.

    Values are counted for each feature and looked up feature by feature, and the rarest are picked within the row: rows are neither multiplied before that nor moved to be ordered.
    """
    total = rows.agg(F.count(F.lit(1)).alias("_t"))
    x = rows.select(key, *[F.col(f).cast("string").alias(f"_v{i}") for i, f in enumerate(features)]).crossJoin(F.broadcast(total))
    for i, f in enumerate(features):
        seen = rows.where(F.col(f).isNotNull()).groupBy(F.col(f).cast("string").alias(f"_s{i}")).agg(F.count(F.lit(1)).alias(f"_n{i}"))
        few = seen.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
        x = x.join(F.broadcast(seen) if few else seen, F.col(f"_v{i}") == F.col(f"_s{i}"), "left")
    share = lambda i: F.when(F.col(f"_v{i}").isNull(), 1.0).otherwise(F.col(f"_n{i}") / F.col("_t"))
    each = [F.struct(share(i).alias("frequency"), F.lit(f).alias("feature"), F.col(f"_v{i}").alias("value")) for i, f in enumerate(features)]
    rarest = x.select(key, F.posexplode(F.slice(F.sort_array(F.array(*each)), 1, k)).alias("_at", "_e"))
    return rarest.select(key, "_e.feature", "_e.value", "_e.frequency", (F.col("_at") + 1).alias("rank"))


def split(rows: DataFrame, group: str, seed: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """rows with part: TRAIN, VALIDATION or TEST by the hash of the group, so a group never lies in two parts."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(group).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("part", F.when(u < train, "TRAIN").when(u < train + validation, "VALIDATION").otherwise("TEST"))


def rubric(version: Column, encryption: Column, kex: Column, key_bits: Column) -> Column:
    """The label of a server's configuration, the worst ground first."""
    return (
        F.when(encryption.isin("NULL", "RC4_40", "DES40_CBC") | (kex == "ANONYMOUS"), "CRITICAL")
        .when((version < 0x0303) | encryption.isin("RC4_128", "DES_CBC") | (key_bits < 2048), "HIGH")
        .when((kex == "RSA") | (encryption == "3DES_EDE_CBC"), "MODERATE").otherwise("LOW")
    )
