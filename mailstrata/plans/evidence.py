"""Packet evidence and certificate paths over the given tables: line items stand for segments of an order's stream, suppliers for servers with chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains, evidence
from .registry import dealt, query

SEGMENTS = """items AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber),
segments AS (SELECT l_orderkey, l_linenumber AS packet, l_partkey % 150 AS s, l_partkey % 150 + 20 + l_suppkey % 60 AS e, l_returnflag AS b FROM items),
lines AS (SELECT l_orderkey, l_linenumber, l_linenumber * 25 AS s, l_linenumber * 25 + CAST(l_quantity AS BIGINT) % 30 AS e FROM items)"""
CONFLICTS = f"""{SEGMENTS}, cuts AS (SELECT DISTINCT l_orderkey, unnest([s, e]) AS s FROM segments), el AS (SELECT l_orderkey, s, lead(s) OVER (PARTITION BY l_orderkey ORDER BY s) AS e FROM cuts),
cov AS (SELECT el.l_orderkey, el.s, el.e, g.packet, g.b, min(g.packet) OVER (PARTITION BY el.l_orderkey, el.s) AS owner FROM el JOIN segments g ON g.l_orderkey = el.l_orderkey AND g.s <= el.s AND g.e >= el.e),
late AS (SELECT *, coalesce(s > lag(e) OVER (PARTITION BY l_orderkey, owner, packet ORDER BY s), true)::INT AS n FROM cov WHERE packet > owner),
runs AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey, owner, packet ORDER BY s) AS run FROM late),
pieces AS (SELECT l_orderkey, owner, packet, any_value(b) AS b, min(s) AS s, max(e) AS e FROM runs GROUP BY l_orderkey, owner, packet, run),
conflicts AS (SELECT p.l_orderkey, p.s, p.e, p.owner, p.packet, sha256(repeat(o.b, p.e - p.s)) AS a, sha256(repeat(p.b, p.e - p.s)) AS c FROM pieces p JOIN segments o ON o.l_orderkey = p.l_orderkey AND o.packet = p.owner WHERE o.b <> p.b)"""


def _items(t):
    """One line item for each order and number."""
    return dealt(t.lineitem, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")])


def _segments(t):
    start, length = F.col("l_partkey") % 150, 20 + F.col("l_suppkey") % 60
    rows = _items(t).select("l_orderkey", F.col("l_linenumber").alias("packet"), start.alias("start"), (start + length).alias("end"), "l_returnflag")
    return rows.withColumn("payload", F.expr("repeat(l_returnflag, cast(end - start AS int))")).drop("l_returnflag")


def _lines(t):
    start = F.col("l_linenumber") * 25
    return _items(t).select("l_orderkey", "l_linenumber", start.alias("start"), (start + F.col("l_quantity").cast("long") % 30).alias("end"))


@query(f"""WITH {SEGMENTS} SELECT n.l_orderkey, n.l_linenumber, coalesce(string_agg(DISTINCT g.packet::VARCHAR, ',' ORDER BY g.packet::VARCHAR), '') AS packets
FROM lines n LEFT JOIN segments g ON g.l_orderkey = n.l_orderkey AND g.s < greatest(n.e, n.s + 1) AND n.s < g.e GROUP BY n.l_orderkey, n.l_linenumber""")
def range_packets(t):
    """Packets of every line of an order."""
    found = evidence.carriers(_lines(t), _segments(t), ["l_orderkey"], "l_linenumber")
    return found.select("l_orderkey", "l_linenumber", F.array_join(F.col("packets").cast("array<string>"), ",").alias("packets"))


@query(f"""WITH {CONFLICTS} SELECT l_orderkey, s AS start, e AS "end", owner AS accepted_packet, packet AS conflicting_packet, a AS accepted_sha256, c AS conflicting_sha256 FROM conflicts""")
def overlap_conflicts(t):
    """Where line items disagree, with both digests."""
    return evidence.disagreements(_segments(t), ["l_orderkey"])


@query(f"""WITH {CONFLICTS} SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM conflicts c WHERE c.l_orderkey = n.l_orderkey AND c.s < greatest(n.e, n.s + 1) AND n.s < c.e) AS ambiguous FROM lines n""")
def range_ambiguity(t):
    """Lines that lie where line items disagree."""
    found = evidence.ambiguous(_lines(t), evidence.disagreements(_segments(t), ["l_orderkey"], digests=False), ["l_orderkey"])
    return found.select("l_orderkey", "l_linenumber", "ambiguous")


@query(f"""WITH {SEGMENTS}, a AS (SELECT l_orderkey, max(l_partkey % 260) AS acked, max((l_linestatus = 'F')::INT) AS fin FROM lineitem GROUP BY l_orderkey), g AS (SELECT l_orderkey, max(l_partkey % 150 + 20 + l_suppkey % 60) AS e FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(acked - fin - e AS BIGINT) AS missing FROM a JOIN g USING (l_orderkey) WHERE acked - fin - e > 0""")
def acked_missing(t):
    """Bytes that were acknowledged and not captured."""
    x = t.lineitem.select("l_orderkey", (F.col("l_partkey") % 260).alias("acked"), (F.col("l_partkey") % 150 + 20 + F.col("l_suppkey") % 60).alias("end"), (F.col("l_linestatus") == "F").alias("fin"))
    return evidence.acked_missing(x, ["l_orderkey"], "acked", "end", "fin")


@query("""WITH RECURSIVE certs AS (SELECT 'S' || s_suppkey AS id, s_suppkey % 7 AS since, 100 + s_suppkey % 50 AS until FROM supplier),
members AS (SELECT s_suppkey AS chain, 'S' || s_suppkey AS node FROM supplier UNION ALL SELECT s_suppkey, 'N' || s_nationkey FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, 'X' || s_nationkey FROM supplier WHERE s_suppkey % 3 = 0),
edges AS (
  SELECT 'S' || s_suppkey AS child, 'N' || s_nationkey AS parent, false AS goal, s_suppkey % 11 <> 0 AS ok, s_nationkey AS since, 90 + s_nationkey AS until, 1 AS path_len FROM supplier
  UNION ALL SELECT 'S' || s_suppkey, 'X' || s_nationkey, false, true, 10, 80, NULL FROM supplier
  UNION ALL SELECT 'X' || n_nationkey, 'N' || n_nationkey, false, true, n_nationkey, 90 + n_nationkey, 1 FROM nation
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, true, n_nationkey % 6 <> 0, 0, 200, CASE WHEN n_regionkey = 2 THEN 1 END FROM nation WHERE n_regionkey < 3
  UNION ALL SELECT 'N' || n_nationkey, 'X' || n_nationkey, false, true, 10, 80, NULL FROM nation),
walk AS (
  SELECT s_suppkey AS chain, 'S' || s_suppkey AS node, 'OPEN' AS state, CAST(s_suppkey % 7 AS BIGINT) AS since, CAST(100 + s_suppkey % 50 AS BIGINT) AS until, 1 AS length, ['S' || s_suppkey] AS seen FROM supplier
  UNION ALL SELECT w.chain, coalesce(k.parent, w.node), CASE WHEN k.parent IS NULL THEN 'MISSING' WHEN NOT k.ok OR greatest(w.since, k.since) > least(w.until, k.until) OR coalesce(k.path_len < w.length - 1, false) THEN 'BROKEN' WHEN k.goal THEN 'DONE' ELSE 'OPEN' END,
    greatest(w.since, k.since), least(w.until, k.until), w.length + (k.parent IS NOT NULL)::INT, CASE WHEN k.parent IS NULL THEN w.seen ELSE list_append(w.seen, k.parent) END
  FROM walk w LEFT JOIN (SELECT m.chain, e.* FROM members m JOIN edges e ON e.child = m.node WHERE e.goal OR EXISTS (SELECT 1 FROM members p WHERE p.chain = m.chain AND p.node = e.parent)) k
    ON k.chain = w.chain AND k.child = w.node AND NOT list_contains(w.seen, k.parent) WHERE w.state = 'OPEN' AND w.length < 5)
SELECT DISTINCT chain, CASE WHEN state = 'OPEN' THEN 'LONG' ELSE state END AS state, since, until, CAST(length AS INT) AS length FROM walk WHERE state <> 'OPEN' OR length = 5""")
def certificate_paths(t):
    """All ways from a supplier's certificate to regions that are anchors: through its nation's certificate, a second one of the same name, and between these two."""
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    supplier, nation = t.supplier, t.nation
    leaf, of_nation, other = named("S", "s_suppkey"), named("N", "s_nationkey"), named("X", "s_nationkey")
    whole = lambda x: F.lit(x).cast("long")

    def edge(rows, child, parent, goal, ok, since, until, path_len):
        return rows.select(child.alias("child"), parent.alias("parent"), F.lit(goal).alias("goal"), ok.alias("ok"), since.cast("long").alias("since"), until.cast("long").alias("until"), path_len.cast("int").alias("path_len"))

    key, yes, none = F.col("n_nationkey"), F.lit(True), F.lit(None)
    edges = [
        edge(supplier, leaf, of_nation, False, F.col("s_suppkey") % 11 != 0, F.col("s_nationkey"), 90 + F.col("s_nationkey"), F.lit(1)),
        edge(supplier, leaf, other, False, yes, whole(10), whole(80), none),
        edge(nation, named("X", "n_nationkey"), named("N", "n_nationkey"), False, yes, key, 90 + key, F.lit(1)),
        edge(nation.where("n_regionkey < 3"), named("N", "n_nationkey"), named("R", "n_regionkey"), True, key % 6 != 0, whole(0), whole(200), F.when(F.col("n_regionkey") == 2, 1)),
        edge(nation, named("N", "n_nationkey"), named("X", "n_nationkey"), False, yes, whole(10), whole(80), none),
    ]
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    starts = supplier.select(F.col("s_suppkey").alias("chain"), leaf.alias("node"), (F.col("s_suppkey") % 7).cast("long").alias("since"), (100 + F.col("s_suppkey") % 50).cast("long").alias("until"))
    own = lambda rows, node: rows.select(F.col("s_suppkey").alias("chain"), node.alias("node"))
    members = own(supplier, leaf).unionByName(own(supplier.where("s_suppkey % 5 <> 0"), of_nation)).unionByName(own(supplier.where("s_suppkey % 3 = 0"), other))
    return chains.paths(starts, members, every, depth=5)
