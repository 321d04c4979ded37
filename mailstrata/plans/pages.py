"""Report rows, tallies and paged queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules, serving
from .assessment import FINDINGS_SQL, facts
from .registry import query, us


@query("SELECT arg_min(c_custkey, (c_acctbal, c_custkey)) FILTER (c_acctbal > 0) AS headline, count(*) FILTER (c_acctbal > 0) AS scored, min(c_acctbal) FILTER (c_acctbal > 0) AS lowest, max(c_acctbal) FILTER (c_acctbal > 0) AS highest FROM customer")
def weakest_capture(t):
    c = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("score"))
    return serving.weakest(c, "c_custkey", "score")


@query("SELECT coalesce(nullif(trim(CASE WHEN user_id % 9 = 0 THEN ' ' ELSE event_type END), ''), 'UNKNOWN') AS value, count(*) AS n FROM events GROUP BY 1")
def distributions(t):
    e = t.events.withColumn("kind", F.when(F.col("user_id") % 9 == 0, " ").otherwise(F.col("event_type")))
    return serving.distribution(e, "kind")


@query("""SELECT c_custkey, n_name, r_name, coalesce(n, 0) AS n_findings FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey""")
def session_rows(t):
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    where = nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_nationkey", "n_name", "r_name")
    c = t.customer.join(where, "c_nationkey", "left").select("c_custkey", "n_name", "r_name")
    found = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return serving.session_rows(c, [], found, "c_custkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unseen_captures(t):
    return serving.unseen(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND (o_orderpriority ILIKE '%URG%' OR CAST(o_orderkey AS VARCHAR) ILIKE '%URG%') ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20")
def session_search(t):
    x = serving.filtered(t.orders, {"o_orderstatus": "O", "o_custkey": None}, "urg", ("o_orderpriority", "o_orderkey"))
    return serving.page(x, [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 50).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH {FINDINGS_SQL} SELECT finding_id, rule_id, session_id FROM found WHERE severity = 'CRITICAL' ORDER BY rule_id, finding_id LIMIT 100 OFFSET 10")
def findings_page(t):
    f = serving.filtered(rules.findings(rules.failures(facts(t))), {"severity": "CRITICAL"})
    return serving.page(f, ["rule_id", "finding_id"], 10, 100).select("finding_id", "rule_id", "session_id")


@query("SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 40 OFFSET 60")
def timeline_page(t):
    x = serving.filtered(t.events, {"event_type": "click"})
    return serving.page(x, ["ts", "event_id"], 60, 40).select("event_id", "user_id", us("ts").alias("us"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def urgent_subset(t):
    return serving.urgent(t.events, "event_type", ("error", "purchase")).select("event_id", "event_type")


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderpriority) AS worst FROM orders GROUP BY o_custkey")
def worst_severity(t):
    return serving.by_worst(t.orders, "o_custkey", "o_orderpriority", F.col("o_orderpriority"))


@query("""WITH m AS (SELECT p_brand, p_size, sum(p_retailprice) AS cost FROM part GROUP BY ALL)
SELECT p_brand, p_size, round(cost - lag(cost) OVER w, 2) AS increment, round(ln(cost / lag(cost) OVER w) / ln(p_size / lag(p_size) OVER w), 6) AS exponent FROM m WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""")
def scaling_exponent(t):
    m = t.part.groupBy("p_brand", "p_size").agg(F.sum("p_retailprice").alias("cost"))
    return serving.increments(m, "p_brand", "p_size", "cost").select("p_brand", "p_size", F.round("increment", 2).alias("increment"), "exponent")


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source")
def size_profile(t):
    return serving.extent(t.documents, "source", "n_chars")


@query("SELECT count(*) AS sessions, count(DISTINCT o_custkey) AS captures, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_totalprice IS NULL) AS unscored, min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders")
def fleet_totals(t):
    return t.orders.agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("o_custkey").alias("captures"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.count_if(F.col("o_totalprice").isNull()).alias("unscored"), F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest"))
