"""Feature encodings, frequency models, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classifier, forest, learning
from .registry import query, spread

KINDS = ["click", "view", "purchase"]


@query("SELECT event_id, concat_ws(',', " + ", ".join(f"(event_type = '{k}')::INT" for k in KINDS) + ", (event_type NOT IN ('click', 'view', 'purchase'))::INT, (event_type IS NULL)::INT) AS encoded, least(value / 50.0, 2.0) AS scaled, (value IS NULL)::INT::DOUBLE AS missing FROM events")
def one_hot(t):
    bits = F.transform(learning.one_hot(F.col("event_type"), KINDS), lambda x: x.cast("int").cast("string"))
    number = learning.scaled(F.col("value"), 50.0)
    return t.events.select("event_id", F.array_join(bits, ",").alias("encoded"), F.element_at(number, 1).alias("scaled"), F.element_at(number, 2).alias("missing"))


@query("""WITH ref AS (SELECT p_brand, p_size % 5 AS s, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), tot AS (SELECT count(*) AS t FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, coalesce(n / t, 0.0) AS frequency, coalesce(n / t, 0.0) <= 0.008 AS anomalous FROM part p CROSS JOIN tot LEFT JOIN ref ON ref.p_brand = p.p_brand AND ref.s = p.p_size % 5""")
def rarity(t):
    p = t.part.select("p_partkey", "p_brand", (F.col("p_size") % 5).alias("s"))
    return learning.rarity(p, p.where("p_partkey % 2 = 0"), ["p_brand", "s"], 0.008).select("p_partkey", "frequency", "anomalous")


@query("""WITH b AS (SELECT d.n_chars // 100 AS s, sum(toxic) AS p, sum(1 - toxic) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1), c AS (SELECT s, sum(p) OVER (ORDER BY s) AS tp, sum(n) OVER (ORDER BY s) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM b),
m AS (SELECT s, 2 * tp / (tp + fp + ap) AS f1, fp / greatest(an, 1) AS fpr FROM c)
SELECT s AS threshold, f1, fpr FROM m WHERE fpr <= 0.2 ORDER BY f1 DESC, fpr, s LIMIT 1""")
def threshold_pick(t):
    x = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.expr("n_chars div 100").alias("s"), "toxic")
    return learning.threshold_pick(x, "s", "toxic")


@query("""WITH x AS (SELECT d.n_chars < 1000 AS p, l.toxic = 1 AS a FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND NOT a) AS tn, count(*) FILTER (NOT p AND a) AS fn FROM x)
SELECT *, CASE WHEN tp + fp > 0 THEN round_even(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round_even(tp / (tp + fn), 4) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round_even(2 * tp / (2 * tp + fp + fn), 4) END AS f1 FROM c""")
def binary_metrics(t):
    x = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return learning.binary_metrics(x, F.col("n_chars") < 1000, F.col("toxic") == 1)


@query("""WITH x AS (SELECT CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END AS p, lang AS a FROM documents), k AS (SELECT p AS class FROM x UNION SELECT a FROM x),
c AS (SELECT class, count(*) FILTER (a = class) AS support, count(*) FILTER (a = class AND p = class) AS correct, count(*) FILTER (p = class) AS predicted FROM k CROSS JOIN x GROUP BY class)
SELECT *, CASE WHEN predicted > 0 THEN round_even(correct / predicted, 4) END AS precision, CASE WHEN support > 0 THEN round_even(correct / support, 4) END AS recall, round_even(2 * correct / (support + predicted), 4) AS f1 FROM c""")
def multiclass_metrics(t):
    x = t.documents.select(F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")).alias("p"), F.col("lang").alias("a"))
    return learning.class_metrics(x, "p", "a")


@query("""WITH e AS (UNPIVOT (SELECT p_partkey, p_brand, p_type, p_size::VARCHAR AS p_size FROM part) ON p_brand, p_type, p_size INTO NAME feature VALUE value), n AS (SELECT feature, value, count(*) / (SELECT count(*) FROM part) AS frequency FROM e GROUP BY ALL)
SELECT p_partkey, feature, value, frequency, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY frequency, feature) AS INT) AS rank FROM e JOIN n USING (feature, value) QUALIFY rank <= 2""")
def explain_topk(t):
    p = t.part.select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    return learning.explain(p, "p_partkey", ["p_brand", "p_type", "p_size"], 2)


PARTS_SQL = "sp AS (SELECT doc_id, source, CASE WHEN u < 0.6 THEN 'TRAIN' WHEN u < 0.8 THEN 'VALIDATION' ELSE 'TEST' END AS part FROM (SELECT *, CAST('0x' || substr(md5('seed|' || source), 1, 8) AS BIGINT) / 4294967296 AS u FROM documents))"


@query(f"WITH {PARTS_SQL} SELECT * FROM sp")
def group_split(t):
    return learning.split(t.documents.select("doc_id", "source"), "source", "seed")


@query(f"WITH {PARTS_SQL} SELECT source FROM sp WHERE part = 'TRAIN' INTERSECT SELECT source FROM sp WHERE part <> 'TRAIN'")
def split_leakage(t):
    s = learning.split(t.documents.select("doc_id", "source"), "source", "seed")
    return s.where("part = 'TRAIN'").select("source").intersect(s.where("part <> 'TRAIN'").select("source"))


@query("""SELECT p_partkey, CASE WHEN p_size % 9 = 0 OR p_size % 7 = 0 THEN 'CRITICAL' WHEN 768 + p_size % 5 < 771 OR p_size % 9 = 1 OR 1024 * (1 + p_size % 4) < 2048 THEN 'HIGH' WHEN p_size % 7 = 1 OR p_size % 9 = 2 THEN 'MODERATE' ELSE 'LOW' END AS posture FROM part""")
def posture_rubric(t):
    s = F.col("p_size")
    enc = F.when(s % 9 == 0, "NULL").when(s % 9 == 1, "RC4_128").when(s % 9 == 2, "3DES_EDE_CBC").otherwise("AES_128_GCM")
    kex = F.when(s % 7 == 0, "ANONYMOUS").when(s % 7 == 1, "RSA").otherwise("ECDHE")
    return t.part.select("p_partkey", learning.rubric(768 + s % 5, enc, kex, 1024 * (1 + s % 4)).alias("posture"))


ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query()
def isolation_scores(t):
    """Every line item's isolation score; the trees come from a seeded sample, so tests hold scores against plain Python on the same trees."""
    items = spread(t.lineitem.select("l_orderkey", "l_linenumber", *ITEM))
    grown = forest.fit(items, ["l_orderkey", "l_linenumber"], ITEM, seed=20, trees=100)
    return items.select("l_orderkey", "l_linenumber", F.round(forest.score(grown), 9).alias("score"))


@query()
def classifier_choice(t):
    """Candidates for the posture of a customer's orders, with their macro-F1 on groups that none was fitted on."""
    words = {"version": "768 + o_orderkey % 5", "bits": "1024 * (1 + o_custkey % 4)", "weak": "cast(o_orderpriority = '1-URGENT' as int)", "total": "o_totalprice"}
    label = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'CRITICAL' WHEN 768 + o_orderkey % 5 < 771 OR o_custkey % 4 = 0 THEN 'HIGH' WHEN o_totalprice < 50000 THEN 'MODERATE' ELSE 'LOW' END"
    rows = learning.split(spread(t.orders).selectExpr("o_custkey", *[f"{e} AS {n}" for n, e in words.items()], f"{label} AS label"), "o_custkey", "posture")
    _, figures = classifier.choose(rows, list(words), "label")
    return t.spark.createDataFrame([(f["model"], f["validation_f1"], f["test_f1"], f["chosen"]) for f in figures], "model string, validation_f1 double, test_f1 double, chosen boolean")
