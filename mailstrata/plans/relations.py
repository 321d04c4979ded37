"""Relations across captures over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import intel, investigation, rules
from ..sinks import work_folder
from .assessment import REACH_SQL, UNITS_SQL, _score_sql, facts, reach
from .registry import query, us

#: TLS settings of a session, from an order: the same words for both engines.
SETTINGS = {
    "session": "o_orderkey",
    "entity": "o_custkey % 97",
    "version": "case when o_orderkey % 5 = 4 then null else concat('TLS1.', cast(o_orderkey % 4 as {text})) end",
    "suite": "case when o_orderkey % 11 = 0 then null else concat('S', cast(o_orderkey % 6 as {text})) end",
    "`group`": "case when o_orderkey % 3 = 0 then null else concat('G', cast(o_custkey % 3 as {text})) end",
    "alpn": "case when o_custkey % 4 = 0 then null else 'imap' end",
    "leaf_sha256": "case when o_custkey % 6 = 0 then null else concat('L', cast(o_custkey % 50 as {text})) end",
    "spki_sha256": "case when o_custkey % 6 = 0 then null else concat('K', cast(o_custkey % 40 as {text})) end",
    "issuer": "case when o_custkey % 6 = 0 then null else concat('CA', cast(o_custkey % 3 as {text})) end",
    "offer": "o_custkey % 2 + o_orderkey % 3",
    "period": "year(o_orderdate)",
    "capture": "o_orderpriority",
    "sni": "case when o_custkey % 5 = 0 then null else concat('h', cast(o_custkey % 30 as {text})) end",
}
_NAMES = [n.strip("`") for n in SETTINGS]
SETTINGS_SQL = "st AS (SELECT " + ", ".join(f'{e.format(text="varchar")} AS "{n.strip("`")}"' for n, e in SETTINGS.items()) + ", epoch_us(o_orderdate) AS at FROM orders)"
_FORM = "'version=smp/1' || chr(10) || " + " || chr(10) || ".join(f"""'{c}=' || coalesce("{c}", '<ABSENT>')""" for c in intel.COMPONENTS)
_CONF = "'version=smp/1' || chr(10) || " + " || chr(10) || ".join(f"""'{c}=' || coalesce("{c}", '<ABSENT>')""" for c in intel.SETTINGS)
PRINTS_SQL = SETTINGS_SQL + f""", fp AS (SELECT *, 'smp/1:' || substr(sha256({_FORM}), 1, 16) AS fingerprint_id, CASE WHEN version IS NOT NULL AND suite IS NOT NULL THEN 'smp/1/cfg:' || substr(sha256({_CONF}), 1, 16) END AS config_fingerprint,
  CASE WHEN version IS NULL OR suite IS NULL THEN 'INSUFFICIENT' WHEN {' OR '.join(f'"{c}" IS NULL' for c in intel.COMPONENTS)} THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness FROM st)"""


def settings(t):
    return t.orders.selectExpr(*[f"{e.format(text='string')} AS {n}" for n, e in SETTINGS.items()], "unix_micros(cast(o_orderdate as timestamp)) AS at")


@query(f"WITH {PRINTS_SQL} SELECT session, fingerprint_id, completeness FROM fp")
def fingerprints(t):
    return intel.fingerprints(settings(t)).select("session", "fingerprint_id", "completeness")


@query(f"WITH {PRINTS_SQL} SELECT session, config_fingerprint FROM fp")
def config_fingerprints(t):
    return intel.fingerprints(settings(t)).select("session", "config_fingerprint")


_SAME = " + ".join(f'coalesce(a."{c}" = b."{c}", false)::INT' for c in intel.COMPONENTS)
_DIFF = " + ".join(f'coalesce(a."{c}" <> b."{c}", false)::INT' for c in intel.COMPONENTS)
_MISS = " + ".join(f'(a."{c}" IS NULL OR b."{c}" IS NULL)::INT' for c in intel.COMPONENTS)


@query(f"""WITH {SETTINGS_SQL}, f AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY entity ORDER BY session) = 1), l AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY entity ORDER BY session DESC) = 1),
x AS (SELECT a.entity, {_SAME} AS m, {_DIFF} AS d, {_MISS} AS s, a.version IS NULL OR a.suite IS NULL OR b.version IS NULL OR b.suite IS NULL AS core FROM f a JOIN l b USING (entity))
SELECT entity, CASE WHEN core THEN 'INSUFFICIENT' WHEN d > 0 THEN 'CONFLICTING' WHEN s > 0 THEN 'PARTIAL' ELSE 'EXACT' END AS verdict, CAST(m AS BIGINT) AS matched, CAST(d AS BIGINT) AS differing, CAST(s AS BIGINT) AS missing FROM x""")
def fingerprint_compare(t):
    s = settings(t)
    pick = lambda f: s.groupBy("entity").agg(f(F.struct("session", *intel.COMPONENTS)).alias("x")).select("entity", "x.*")
    return intel.compare(pick(F.min), pick(F.max), "entity")


@query(f"WITH {PRINTS_SQL} SELECT entity, count(DISTINCT session) AS n_session, count(DISTINCT capture) AS n_capture, count(DISTINCT leaf_sha256) AS n_leaf_sha256, count(DISTINCT sni) AS n_sni, count(DISTINCT fingerprint_id) AS n_fingerprint_id, min(\"at\") AS first_at, max(\"at\") AS last_at FROM fp GROUP BY entity")
def entities(t):
    return intel.entities(intel.fingerprints(settings(t)), ["entity"], ["session", "capture", "leaf_sha256", "sni", "fingerprint_id"], "at")


KINDS = {"CERTIFICATE": "leaf_sha256", "PUBLIC_KEY": "spki_sha256", "SNI": "sni", "CONFIG": "config_fingerprint"}
PAIRS_SQL = PRINTS_SQL + ", pairs AS (" + " UNION ALL ".join(
    f"SELECT a.entity AS entity_a, b.entity AS entity_b, '{k}' AS kind, count(*) AS shared FROM (SELECT DISTINCT entity, {c} AS v FROM fp) a JOIN (SELECT DISTINCT entity, {c} AS v FROM fp) b USING (v) WHERE a.entity <> b.entity GROUP BY a.entity, b.entity" for k, c in KINDS.items()
) + ")"


def _pairs(t):
    x, out = intel.fingerprints(settings(t)), None
    for kind, c in KINDS.items():
        p = intel.relations(x, "entity", c, kind)
        out = p if out is None else out.unionByName(p)
    return out


@query(f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def relations(t):
    return _pairs(t)


@query(f"WITH {PAIRS_SQL} SELECT entity_a, entity_b, count(DISTINCT kind) AS weak_kinds FROM pairs p WHERE kind IN ('SNI', 'CONFIG') AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.entity_a = p.entity_a AND q.entity_b = p.entity_b AND q.kind IN ('CERTIFICATE', 'PUBLIC_KEY')) GROUP BY ALL HAVING count(DISTINCT kind) >= 2")
def possible_relations(t):
    return intel.possible_relations(_pairs(t), ["SNI", "CONFIG"], ["CERTIFICATE", "PUBLIC_KEY"])


@query(f"WITH {PRINTS_SQL} SELECT leaf_sha256 AS value, count(DISTINCT entity) AS members FROM fp WHERE leaf_sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT entity) >= 2")
def shared_certificates(t):
    return intel.shared_values(settings(t), "entity", "leaf_sha256")


def _groups(kind: str, basis: str, source: str) -> str:
    return f"""SELECT '{kind}' AS kind, {basis}::VARCHAR AS basis, count(DISTINCT session_id) AS sessions, count(DISTINCT capture_id) AS captures, min("at") AS first_at, max("at") AS last_at,
  'corr-' || substr(sha256('{kind}|' || {basis}::VARCHAR || '|sessions=' || array_to_string(list_sort(list_distinct(list(session_id))), ',') || '|captures=' || array_to_string(list_sort(list_distinct(list(capture_id))), ',')), 1, 12) AS correlation_id
FROM {source} GROUP BY {basis} HAVING count(DISTINCT session_id) >= 2"""


@query(f"WITH {REACH_SQL} {_groups('SHARED_RULE_FAILURE', 'rule_id', 'reach')} UNION ALL {_groups('SHARED_ENDPOINT', 'entity', 'reach')}")
def correlations(t):
    r = reach(t)
    a = intel.correlations(r, "SHARED_RULE_FAILURE", "rule_id", "session_id", "capture_id", "at")
    return a.unionByName(intel.correlations(r, "SHARED_ENDPOINT", "entity", "session_id", "capture_id", "at"))


@query(f"WITH {PRINTS_SQL} SELECT entity, count(DISTINCT session) AS sessions, count(DISTINCT config_fingerprint) AS configs FROM fp GROUP BY entity HAVING count(DISTINCT session) >= 2 AND count(DISTINCT config_fingerprint) > 1")
def endpoint_divergence(t):
    return intel.divergence(intel.fingerprints(settings(t)), "entity", "session", "config_fingerprint")


_DRIFTS = " UNION ALL ".join(f"""SELECT entity, '{k}' AS kind, "_{k}" AS before, "{k}" AS after, {str(s).lower()} AS sensitive, offer, _offer, session, _session FROM p""" for k, s in intel.DRIFTS.items())


@query(f"""WITH {SETTINGS_SQL}, f AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY "at", session) = 1),
p AS (SELECT *, lag(offer) OVER w AS _offer, lag(session) OVER w AS _session, {', '.join(f'lag("{k}") OVER w AS "_{k}"' for k in intel.DRIFTS)}, row_number() OVER w AS i FROM f WINDOW w AS (PARTITION BY entity ORDER BY period) QUALIFY i > 1), u AS ({_DRIFTS})
SELECT entity, kind, before, after, CASE WHEN before IS NULL OR after IS NULL THEN 'NOT_COMPARABLE' WHEN before = after THEN 'UNCHANGED_WITH_EVIDENCE' WHEN sensitive AND offer IS DISTINCT FROM _offer THEN 'INCONCLUSIVE' ELSE 'OBSERVED_CHANGE' END AS status,
  'drift-' || substr(sha256(entity || '|' || kind || '|' || coalesce(before, 'None') || '|' || coalesce(after, 'None') || '|' || _session || '|' || session), 1, 12) AS drift_id FROM u""")
def drift(t):
    return intel.drift(settings(t), "entity", "period", ["at", "session"], intel.DRIFTS, "offer", "session")


_OWN = {"session_id": "cast(o_orderkey as {text})", "capture_id": "concat('cap-', cast(o_orderkey % 6 as {text}))", "entity": "o_custkey % 97"}
CAPTURES_SQL = SETTINGS_SQL.replace("st AS (SELECT ", "cs AS (SELECT " + ", ".join(f"{e.format(text='varchar')} AS {n}" for n, e in _OWN.items() if n != "entity") + ", ", 1)
_SNAPSHOTS_SQL = f"""{CAPTURES_SQL}, f AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY entity, capture_id ORDER BY "at", session_id) = 1),
p AS (SELECT *, lag(offer) OVER w AS _offer, lag(session_id) OVER w AS _session, {', '.join(f'lag("{k}") OVER w AS "_{k}"' for k in intel.DRIFTS)}, row_number() OVER w AS i FROM f WINDOW w AS (PARTITION BY entity ORDER BY "at", capture_id) QUALIFY i > 1),
u AS ({" UNION ALL ".join(f"""SELECT entity, '{k}' AS kind, "_{k}" AS before, "{k}" AS after, {str(s).lower()} AS sensitive, offer, _offer, session_id, _session, capture_id, "at" FROM p""" for k, s in intel.DRIFTS.items())}),
d AS (SELECT *, CASE WHEN before IS NULL OR after IS NULL THEN 'NOT_COMPARABLE' WHEN before = after THEN 'UNCHANGED_WITH_EVIDENCE' WHEN sensitive AND offer IS DISTINCT FROM _offer THEN 'INCONCLUSIVE' ELSE 'OBSERVED_CHANGE' END AS status,
  'drift-' || substr(sha256(entity || '|' || kind || '|' || coalesce(before, 'None') || '|' || coalesce(after, 'None') || '|' || _session || '|' || session_id), 1, 12) AS drift_id FROM u)"""


def _captured(t):
    """Sessions of six captures, from orders."""
    return t.orders.selectExpr("o_orderkey", *[f"{e.format(text='string')} AS {n}" for n, e in {**SETTINGS, **_OWN}.items()], "unix_micros(cast(o_orderdate as timestamp)) AS at")


def _investigated(t, parts: int) -> dict:
    """The state of an investigation that takes these captures in so many parts, one after the other."""
    rows, root, state = intel.fingerprints(_captured(t)), work_folder(t.spark), {}
    for i in range(parts):
        state = investigation.add_captures(t.spark, root, rows.where(F.col("o_orderkey") % parts == i).drop("o_orderkey"))
    return state


@query(f"""WITH {_SNAPSHOTS_SQL} SELECT entity, kind, before, after, status, drift_id, capture_id, session_id, "at" FROM d""")
def incremental_drift(t):
    """Drift between captures that came in two parts: what one batch gives."""
    return _investigated(t, 2)["drift"]


@query(f"""WITH {_SNAPSHOTS_SQL}, e AS (SELECT capture_id, session_id, "at", 'CONFIGURATION_DRIFT' AS kind, 'drift:' || drift_id AS anchor FROM d WHERE status = 'OBSERVED_CHANGE')
SELECT *, 'evt-' || substr(sha256(capture_id || '|' || session_id || '|' || kind || '|' || anchor), 1, 12) AS event_id FROM e""")
def timeline_drift(t):
    """The changes that go on the timeline."""
    return investigation.timeline_events({"drift": investigation.drift_rows(investigation.snapshot_rows(_captured(t)))})


@query(f"""WITH {_SNAPSHOTS_SQL} SELECT status, count(*) AS n FROM d GROUP BY status""")
def drift_status_counts(t):
    return investigation.drift_rows(investigation.snapshot_rows(_captured(t))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_SCORES = _score_sql("session_id").replace("SELECT session_id, e AS", "SELECT session_id, e AS", 1)


@query(f"""WITH {UNITS_SQL}, sc AS (SELECT * FROM (WITH {_SCORES})), o AS (SELECT s.score, o_custkey, o_orderkey, o_orderkey % 3 AS policy FROM sc s JOIN orders ON s.session_id = 's' || o_orderkey),
l AS (SELECT o_custkey, o_orderkey, lag(score) OVER w AS before, score AS after, lag(policy) OVER w AS p, policy AS q, row_number() OVER w AS i FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, before, after, CASE WHEN before IS NULL OR after IS NULL OR p IS DISTINCT FROM q THEN 'NOT_COMPARABLE' WHEN before = after THEN 'UNCHANGED_WITH_EVIDENCE' ELSE 'OBSERVED_CHANGE' END AS status FROM l WHERE i > 1 AND (before IS NOT NULL OR after IS NOT NULL)""")
def score_drift(t):
    s = rules.posture(facts(t)).select("session_id", "score")
    o = t.orders.select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("session_id"), "o_custkey", "o_orderkey", (F.col("o_orderkey") % 3).alias("policy"))
    return intel.score_drift(o.join(s, "session_id"), "o_custkey", "o_orderkey", "score", "policy")


EVENTS_SQL = """ev AS (SELECT 'cap' AS capture_id, 'u' || user_id AS session_id, event_type AS kind, event_id::VARCHAR AS anchor, CASE WHEN event_id % 50 = 0 THEN NULL ELSE epoch_us(ts) END AS at FROM events
UNION ALL SELECT 'cap', 'c' || o_custkey, 'ORDER', o_orderkey::VARCHAR, epoch_us(o_orderdate) FROM orders UNION ALL SELECT 'cap', NULL, 'LINE', l_orderkey || '-' || l_linenumber, max(epoch_us(l_shipdate)) FROM lineitem GROUP BY l_orderkey, l_linenumber),
tl AS (SELECT 'evt-' || substr(sha256(capture_id || '|' || coalesce(session_id, '') || '|' || kind || '|' || anchor), 1, 12) AS event_id, session_id, kind, anchor, "at", coalesce(session_id, '') AS skey FROM ev)"""


def _events(t):
    text = lambda c: F.col(c).cast("string")
    e = t.events.select(F.concat(F.lit("u"), text("user_id")).alias("session_id"), F.col("event_type").alias("kind"), text("event_id").alias("anchor"), F.when(F.col("event_id") % 50 != 0, us("ts")).alias("at"))
    o = t.orders.select(F.concat(F.lit("c"), text("o_custkey")).alias("session_id"), F.lit("ORDER").alias("kind"), text("o_orderkey").alias("anchor"), us("o_orderdate").alias("at"))
    i = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(us(F.max("l_shipdate")).alias("at"))
    i = i.select(F.lit(None).cast("string").alias("session_id"), F.lit("LINE").alias("kind"), F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("anchor"), "at")
    x = e.unionByName(o).unionByName(i).withColumn("capture_id", F.lit("cap"))
    return intel.with_event_ids(x).withColumn("skey", ids.text("session_id"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, kind, anchor, \"at\", row_number() OVER (ORDER BY \"at\" NULLS LAST, skey, kind, anchor) - 1 AS order_index FROM tl")
def timeline(t):
    return intel.timeline(_events(t), "at", ["skey", "kind", "anchor"]).select("event_id", "kind", "anchor", "at", F.col("order_index").cast("long").alias("order_index"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, kind, anchor, row_number() OVER (ORDER BY \"at\" NULLS LAST, skey, kind, anchor) - 1 AS order_index, true AS truncated FROM tl QUALIFY order_index < 200")
def timeline_topk(t):
    return intel.timeline(_events(t), "at", ["skey", "kind", "anchor"], 200).select("event_id", "kind", "anchor", "order_index", "truncated")


@query(f"""WITH {REACH_SQL}, d AS (SELECT rule_id, string_agg(protocol || '=' || n, ',' ORDER BY protocol || '=' || n) AS protocols FROM (SELECT rule_id, protocol, count(*) AS n FROM reach GROUP BY ALL) GROUP BY rule_id)
SELECT rule_id, count(DISTINCT session_id) AS sessions, count(DISTINCT entity) AS entities, count(DISTINCT capture_id) AS captures, count(*) AS members, min("at") AS first_at, max("at") AS last_at, any_value(protocols) AS protocols FROM reach JOIN d USING (rule_id) GROUP BY rule_id""")
def blast_radius(t):
    return intel.blast_radius(reach(t), "rule_id", "session_id", "entity", "capture_id", "protocol", "at")


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN 'ANALYZED' ELSE 'DUPLICATE' END AS status FROM documents")
def capture_dedupe(t):
    return intel.dedupe(t.documents.select("doc_id", "text"), F.col("text"), ["doc_id"]).select("doc_id", "content_id", "status")


@query("SELECT source, 'inv-' || substr(sha256(array_to_string(list_sort(list_distinct(list(sha256(text)))), '|')), 1, 16) AS investigation_id FROM documents GROUP BY source")
def investigation_ids(t):
    d = t.documents.select("source", F.sha2(F.col("text").cast("binary"), 256).alias("content"))
    return intel.investigation_id(d, ["source"], "content")


