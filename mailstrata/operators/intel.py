"""Relations across captures: fingerprints, entities, correlations, drift, timeline, reach.

All of it is joins, groups and windows over tables of sessions; values that many entities share
are never expanded into all pairs beyond a limit that the caller names, see relations().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import correlation_id, drift_id, event_id, short_id, text

COMPONENTS = ["version", "suite", "group", "alpn", "leaf_sha256", "spki_sha256", "issuer"]
SETTINGS = ["version", "suite", "group", "alpn"]
#: Property of a session: does the client's offer decide it?
DRIFTS = {"version": True, "suite": True, "group": True, "leaf_sha256": False, "spki_sha256": False, "issuer": False}


def canonical(components: list[str], version: str = "smp/1") -> Column:
    return F.concat_ws("\n", F.lit(f"version={version}"), *[F.concat(F.lit(f"{c}="), text(c, "<ABSENT>")) for c in components])


def fingerprints(sessions: DataFrame, prefix: str = "smp/1:") -> DataFrame:
    """sessions with fingerprint_id, config_fingerprint (null without version and suite) and completeness."""
    core = F.col("version").isNotNull() & F.col("suite").isNotNull()
    absent = sum((F.col(c).isNull().cast("int") for c in COMPONENTS), F.lit(0))
    state = F.when(~core, "INSUFFICIENT").when(absent > 0, "PARTIAL").otherwise("COMPLETE")
    return sessions.withColumns({"fingerprint_id": short_id(prefix, canonical(COMPONENTS), 16), "config_fingerprint": F.when(core, short_id(f"{prefix[:-1]}/cfg:", canonical(SETTINGS), 16)), "completeness": state})


def compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, verdict, matched, differing, missing (counts) for fingerprints paired by key."""
    a, b = left.select(key, *[F.col(c).alias(f"a_{c}") for c in COMPONENTS]), right.select(key, *[F.col(c).alias(f"b_{c}") for c in COMPONENTS])
    both = [F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull() for c in COMPONENTS]
    same = [F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False)) for c in COMPONENTS]
    count = lambda xs: sum((x.cast("long") for x in xs), F.lit(0).cast("long"))
    x = a.join(b, key).withColumns({"matched": count(same), "differing": count([p & ~s for p, s in zip(both, same, strict=True)]), "missing": count([~p for p in both])})
    core = both[0] & both[1]
    return x.withColumn("verdict", F.when(~core, "INSUFFICIENT").when(F.col("differing") > 0, "CONFLICTING").when(F.col("missing") > 0, "PARTIAL").otherwise("EXACT")).select(key, "verdict", "matched", "differing", "missing")


def entities(rows: DataFrame, key: list[str], sets: list[str], at: str) -> DataFrame:
    """key, n_<set> (distinct values), first and last time, for each server."""
    return rows.groupBy(*key).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in sets], F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def relations(members: DataFrame, entity: str, value: str, kind: str, most: int | None = None) -> DataFrame:
    """Ordered pairs of entities that share a value: entity_a, entity_b, kind, shared (number of values).

    most: a value that more entities hold is left to shared_values(), which names its members without pairs.
    """
    m = members.where(F.col(value).isNotNull()).select(F.col(entity).alias("entity"), F.col(value).alias("value")).distinct()
    if most is not None:
        m = m.join(m.groupBy("value").count().where(F.col("count") <= most).select("value"), "value", "left_semi")
    pairs = m.withColumnRenamed("entity", "entity_a").join(m.withColumnRenamed("entity", "entity_b"), "value").where("entity_a <> entity_b")
    return pairs.groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("shared")).withColumn("kind", F.lit(kind))


def shared_values(members: DataFrame, entity: str, value: str) -> DataFrame:
    """value, members (distinct entities) of every value that two or more entities hold."""
    m = members.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_distinct(entity).alias("members"))
    return m.where("members >= 2").withColumnRenamed(value, "value")


def possible_relations(pairs: DataFrame, weak: list[str], strong: list[str]) -> DataFrame:
    """Pairs with two or more weak kinds and no strong one."""
    linked = pairs.where(F.col("kind").isin(strong)).select("entity_a", "entity_b").distinct()
    two = pairs.where(F.col("kind").isin(weak)).groupBy("entity_a", "entity_b").agg(F.count_distinct("kind").alias("weak_kinds")).where("weak_kinds >= 2")
    return two.join(linked, ["entity_a", "entity_b"], "left_anti")


def correlations(members: DataFrame, kind: str, basis: str, session: str, capture: str, at: str) -> DataFrame:
    """Groups of two or more sessions with one basis: kind, basis, sessions, captures, first_at, last_at, correlation_id."""
    m = members.where(F.col(basis).isNotNull()).groupBy(F.col(basis).cast("string").alias("basis")).agg(
        F.sort_array(F.collect_set(F.col(session).cast("string"))).alias("_s"), F.sort_array(F.collect_set(F.col(capture).cast("string"))).alias("_c"), F.min(at).alias("first_at"), F.max(at).alias("last_at")
    )
    m = m.where(F.size("_s") >= 2).withColumn("kind", F.lit(kind))
    made = correlation_id(F.col("kind"), F.col("basis"), F.array_join("_s", ","), F.array_join("_c", ","))
    return m.select("kind", "basis", F.size("_s").cast("long").alias("sessions"), F.size("_c").cast("long").alias("captures"), "first_at", "last_at", made.alias("correlation_id"))


def capped(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows by order and whether there were more: a top-k, so only k rows of each task meet."""
    top = df.orderBy(*order).limit(most)
    return top.crossJoin(F.broadcast(df.limit(most + 1).agg((F.count(F.lit(1)) > most).alias("truncated"))))


def divergence(rows: DataFrame, entity: str, session: str, config: str) -> DataFrame:
    """Entities with two or more sessions and more than one configuration."""
    x = rows.groupBy(entity).agg(F.count_distinct(session).alias("sessions"), F.count_distinct(config).alias("configs"))
    return x.where("sessions >= 2 AND configs > 1")


def drift(rows: DataFrame, entity: str, period: str, order: list, kinds: dict[str, bool], offer: str, session: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """Changes from an entity's first session of a period to that of its next one.

    entity, kind, before, after, status, drift_id, and the columns carried of the later session. A value that the client's offer decides and whose offers differ is INCONCLUSIVE.
    """
    first = Window.partitionBy(entity, period).orderBy(*order)
    snaps = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    w = Window.partitionBy(entity).orderBy(period)
    before = {c: F.lag(c).over(w).alias(f"_{c}") for c in [*kinds, offer, session]}
    pairs = snaps.select(entity, *kinds, offer, session, *carried, *before.values(), F.row_number().over(w).alias("_i")).where("_i > 1")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").cast("string").alias("before"), F.col(k).cast("string").alias("after"), F.lit(s).alias("sensitive")) for k, s in kinds.items()]))
    x = pairs.select(entity, offer, session, *carried, f"_{offer}", f"_{session}", each.alias("e")).select("*", "e.*")
    offers_differ = ~F.col(offer).eqNullSafe(F.col(f"_{offer}"))
    status = F.when(F.col("before").isNull() | F.col("after").isNull(), "NOT_COMPARABLE").when(F.col("before") == F.col("after"), "UNCHANGED_WITH_EVIDENCE").when(F.col("sensitive") & offers_differ, "INCONCLUSIVE").otherwise("OBSERVED_CHANGE")
    made = drift_id(F.col(entity).cast("string"), F.col("kind"), F.col("before"), F.col("after"), F.col(f"_{session}").cast("string"), F.col(session).cast("string"))
    return x.select(entity, "kind", "before", "after", status.alias("status"), made.alias("drift_id"), *carried)


def score_drift(rows: DataFrame, entity: str, period: str, score: str, policy: str) -> DataFrame:
    """entity, period, before, after, status of the score from one period to the next; two missing scores give no row."""
    w = Window.partitionBy(entity).orderBy(period)
    x = rows.select(entity, period, F.lag(score).over(w).alias("before"), F.col(score).alias("after"), F.lag(policy).over(w).alias("_p"), F.col(policy).alias("_q"), F.row_number().over(w).alias("_i"))
    x = x.where((F.col("_i") > 1) & (F.col("before").isNotNull() | F.col("after").isNotNull()))
    same = F.col("_p").eqNullSafe(F.col("_q"))
    status = F.when(F.col("before").isNull() | F.col("after").isNull() | ~same, "NOT_COMPARABLE").when(F.col("before") == F.col("after"), "UNCHANGED_WITH_EVIDENCE").otherwise("OBSERVED_CHANGE")
    return x.select(entity, period, "before", "after", status.alias("status"))


def with_event_ids(events: DataFrame) -> DataFrame:
    """events (capture_id, session_id, kind, anchor, ...) with event_id."""
    return events.withColumn("event_id", event_id(F.col("capture_id"), F.col("session_id"), F.col("kind"), F.col("anchor")))


def timeline(events: DataFrame, at: str, order: list[str], most: int | None = None) -> DataFrame:
    """events with order_index from 0 in a total order, unknown times last; with most, the first ones and whether there were more.

    A rank within each day and the count of all days before it; a very busy day, or all rows without a time, are one task each.
    """
    keys = [F.col(at).asc_nulls_last(), *[F.asc(c) for c in order]]
    if most is not None:
        top = capped(events, keys, most)
        return top.withColumn("order_index", (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))
    days = F.coalesce(F.floor(F.col(at) / 86_400_000_000).cast("long"), F.lit(1 << 60))
    x = events.withColumn("_day", days)
    counts = x.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return x.join(before, "_day").withColumn("order_index", F.col("_before") + F.row_number().over(Window.partitionBy("_day").orderBy(*keys)) - 1).drop("_day", "_before")


def blast_radius(members: DataFrame, subject: str, session: str, entity: str, capture: str, protocol: str, at: str) -> DataFrame:
    """For each subject the distinct sessions, entities and captures it reaches, its members, their protocols as k=v and the time span."""
    by = members.groupBy(subject, F.col(protocol).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    spread = by.groupBy(subject).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "_p", F.col("_n").cast("string")))), ",").alias("protocols"))
    reach = members.groupBy(subject).agg(F.count_distinct(session).alias("sessions"), F.count_distinct(entity).alias("entities"), F.count_distinct(capture).alias("captures"), F.count(F.lit(1)).alias("members"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return reach.join(spread, subject)


def dedupe(rows: DataFrame, content: Column, order: list) -> DataFrame:
    """rows with content_id and status: ANALYZED for the first of each content, DUPLICATE for later ones."""
    x = rows.withColumn("content_id", F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256)))
    n = F.row_number().over(Window.partitionBy("content_id").orderBy(*order))
    return x.withColumn("status", F.when(n == 1, "ANALYZED").otherwise("DUPLICATE"))


def investigation_id(captures: DataFrame, key: list[str], content: str) -> DataFrame:
    """key, investigation_id: from the sorted distinct contents, whatever their order."""
    x = captures.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set(content)), "|").alias("_m"))
    return x.select(*key, short_id("inv-", F.col("_m"), 16).alias("investigation_id"))
