"""Inventories, events, features, chains and page content over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inventory, profiles, rules
from .assessment import FACTS_SQL, FINDINGS_SQL, RESULTS_SQL, UNITS_SQL, _score_sql, facts
from .registry import dealt, query

_YES = "('UPGRADE_ACCEPTED', 'TLS_BYTES_OBSERVED')"


@query(f"""WITH {FACTS_SQL} SELECT capture_id, count(*) AS analysed_session_count,
  count(*) FILTER (detection = 'CONFIRMED' AND protocol = 'SMTP') AS confirmed_smtp_count, count(*) FILTER (detection = 'CONFIRMED' AND protocol = 'IMAP') AS confirmed_imap_count,
  count(*) FILTER (detection = 'CONFIRMED' AND protocol = 'POP3') AS confirmed_pop3_count, count(*) FILTER (detection = 'PROBABLE') AS probable_count, count(*) FILTER (detection = 'PORT_HINT') AS port_hint_only_count,
  count(*) FILTER (detection = 'NOT_IDENTIFIED') AS unknown_count, count(*) FILTER (upgrade_advertised) AS upgrade_advertised_count, count(*) FILTER (upgrade_requested) AS upgrade_requested_count,
  count(*) FILTER (upgrade_state IN {_YES}) AS upgrade_accepted_count, count(*) FILTER (upgrade_state = 'UPGRADE_REJECTED') AS upgrade_rejected_count,
  count(*) FILTER (upgrade_state IN ('INCOMPLETE', 'UPGRADE_REQUESTED')) AS upgrade_incomplete_count, count(*) FILTER (upgrade_state = 'TLS_BYTES_OBSERVED') AS tls_bytes_observed_count,
  count(*) FILTER (implicit_tls) AS implicit_tls_session_count, CAST(sum(auth_count) AS BIGINT) AS authentication_observation_count, CAST(sum(auth_before_upgrade) AS BIGINT) AS authentication_before_upgrade_count,
  CAST(0 AS BIGINT) AS tls_handshakes_analysed FROM facts GROUP BY capture_id""")
def protocol_inventory(t):
    return inventory.protocol_inventory(facts(t), ["capture_id"])


@query(f"""WITH {FACTS_SQL} SELECT capture_id, count(*) AS tls_session_count, count(*) FILTER (implicit_tls) AS implicit_tls_count, count(*) FILTER (NOT implicit_tls) AS starttls_upgrade_count,
  count(*) FILTER (handshake_state NOT IN ('NOT_OBSERVED', 'CLIENT_HELLO_ONLY', 'INDETERMINATE')) AS negotiated_count, count(*) FILTER (selected_version = 772) AS tls13_count, count(*) FILTER (selected_version = 771) AS tls12_count,
  count(*) FILTER (selected_version BETWEEN 768 AND 770) AS legacy_version_count, count(*) FILTER (cert_visibility = 'OBSERVED') AS certificates_observed_count, count(*) FILTER (cert_visibility = 'ENCRYPTED_TLS13') AS certificates_encrypted_count,
  count(*) FILTER (chain_status = 'PASSED') AS chain_verified_count, count(*) FILTER (hostname_status = 'PASSED') AS hostname_verified_count, count(*) FILTER (fs_status IN ('EPHEMERAL_OBSERVED', 'CAPABLE')) AS forward_secret_count,
  count(*) FILTER (fs_status = 'STATIC_RSA') AS static_rsa_count, count(*) FILTER (fatal_alert) AS alert_count, CAST(0 AS BIGINT) AS handshakes_cryptographically_verified, CAST(0 AS BIGINT) AS revocation_checks_performed
FROM facts WHERE has_tls GROUP BY capture_id""")
def tls_inventory(t):
    return inventory.tls_inventory(facts(t), ["capture_id"])


_TEXT = "::VARCHAR"
_EVENTS = [
    ("true", "'SESSION_FIRST_PACKET'", "'first-packet'"),
    ("detection IN ('CONFIRMED', 'PROBABLE')", "'PROTOCOL_IDENTIFIED'", "'detect:' || coalesce(protocol, 'UNKNOWN') || ':' || detection"),
    ("upgrade_advertised", "'UPGRADE_ADVERTISED'", "'upgrade-advertised'"),
    ("upgrade_requested", "'UPGRADE_REQUESTED'", "'upgrade-requested'"),
    (f"upgrade_state IN {_YES} OR upgrade_state = 'UPGRADE_REJECTED'", f"CASE WHEN upgrade_state IN {_YES} THEN 'UPGRADE_ACCEPTED' ELSE 'UPGRADE_REJECTED' END", "'upgrade-response:' || upgrade_state"),
    ("auth_count > 0", "'AUTHENTICATION_OBSERVED'", f"'auth:' || auth_count{_TEXT}"),
    ("has_tls AND client_hello", "'CLIENT_HELLO'", "'msg:client_hello'"),
    ("has_tls AND selected_version IS NOT NULL", "'SERVER_HELLO'", "'msg:server_hello'"),
    ("has_tls AND cert_visibility = 'OBSERVED'", "'CERTIFICATE_OBSERVED'", "'msg:certificate'"),
    ("has_tls AND selected_version IS NOT NULL AND suite IS NOT NULL", "'CRYPTO_PARAMETERS_SELECTED'", f"'negotiated:' || selected_version{_TEXT} || ':' || suite{_TEXT}"),
    ("has_tls AND fatal_alert", "'TLS_ALERT'", "'alert'"),
]
_EVENTS_SQL = " UNION ALL ".join(f"SELECT capture_id, session_id, capture_us AS at, {kind} AS kind, {anchor} AS anchor FROM facts WHERE {test}" for test, kind, anchor in _EVENTS)


@query(f"""WITH {FINDINGS_SQL}, e AS ({_EVENTS_SQL} UNION ALL SELECT d.capture_id, d.session_id, f.capture_us, 'SECURITY_FINDING', 'finding:' || finding_id FROM found d JOIN facts f USING (session_id))
SELECT *, 'evt-' || substr(sha256(capture_id || '|' || session_id || '|' || kind || '|' || anchor), 1, 12) AS event_id FROM e""")
def timeline_events(t):
    f = facts(t)
    return inventory.session_events(f, "capture_us").unionByName(inventory.finding_events(rules.findings(rules.failures(f)), f, "capture_us"))


_PATTERN = " ".join(f"WHEN '{r}' THEN '{k}'" for r, k in inventory.PATTERNS.items())


@query(f"""WITH {FINDINGS_SQL} SELECT CASE rule_id {_PATTERN} END AS kind, rule_id AS basis, count(DISTINCT session_id) AS sessions, count(DISTINCT capture_id) AS captures FROM found
WHERE rule_id IN ({", ".join(f"'{r}'" for r in inventory.PATTERNS)}) GROUP BY rule_id HAVING count(DISTINCT session_id) >= 2""")
def pattern_correlations(t):
    return inventory.patterns(rules.findings(rules.failures(facts(t))))


@query(f"""WITH {FACTS_SQL}, m AS (SELECT 'SHARED_CERTIFICATE' AS kind, leaf_sha256 AS basis, capture_id, session_id FROM facts UNION ALL SELECT 'SHARED_PUBLIC_KEY', spki_sha256, capture_id, session_id FROM facts),
g AS (SELECT kind, basis, count(DISTINCT session_id) AS sessions, count(DISTINCT capture_id) AS captures, string_agg(DISTINCT session_id, ',' ORDER BY session_id) AS s, string_agg(DISTINCT capture_id, ',' ORDER BY capture_id) AS c FROM m WHERE basis IS NOT NULL GROUP BY kind, basis)
SELECT kind, basis, sessions, captures, 'corr-' || substr(sha256(kind || '|' || basis || '|sessions=' || s || '|captures=' || c), 1, 12) AS correlation_id FROM g WHERE sessions >= 2""")
def certificate_correlations(t):
    return inventory.correlated(inventory.shared_material(facts(t), {"SHARED_CERTIFICATE": "leaf_sha256", "SHARED_PUBLIC_KEY": "spki_sha256"}, "capture_id", "session_id"))


_LEAF = "(has_tls AND cert_visibility = 'OBSERVED')"


@query(f"""WITH {FACTS_SQL} SELECT capture_id, session_id,
  CASE WHEN has_tls THEN CASE WHEN selected_version IS NULL THEN 'MISSING' ELSE CASE selected_version WHEN 769 THEN 'TLS 1.0' WHEN 770 THEN 'TLS 1.1' WHEN 771 THEN 'TLS 1.2' WHEN 772 THEN 'TLS 1.3' ELSE 'OTHER' END END END AS tls_version,
  CASE WHEN has_tls THEN CASE WHEN tls_group IS NOT NULL THEN 'OBSERVED' WHEN selected_version < 772 AND kex = 'RSA' THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END END AS group_absence_reason,
  CASE WHEN has_tls THEN CASE WHEN {_LEAF} THEN 'OBSERVED' WHEN selected_version = 772 THEN 'NOT_AVAILABLE' ELSE 'UNKNOWN' END END AS certificate_absence_reason,
  CASE WHEN has_tls THEN {_LEAF} END AS certificate_observed, CASE WHEN has_tls THEN fs_status IN ('EPHEMERAL_OBSERVED', 'CAPABLE') END AS forward_secrecy_observed,
  CASE WHEN has_tls THEN CASE WHEN {_LEAF} THEN coalesce(key_algorithm, 'MISSING') ELSE 'MISSING' END END AS cert_key_algorithm,
  CASE WHEN {_LEAF} THEN CAST(key_bits AS DOUBLE) END AS cert_key_bits, CASE WHEN {_LEAF} THEN CAST(floor((not_after_us - not_before_us) / 86400000000.0) AS BIGINT) END AS cert_lifetime_days,
  CASE WHEN has_tls THEN ((selected_version IS NOT NULL)::INT + (suite IS NOT NULL)::INT + (tls_group IS NOT NULL)::INT + {_LEAF}::INT) / 4.0::DOUBLE END AS evidence_completeness,
  CASE WHEN has_tls AND selected_version IS NOT NULL AND suite IS NOT NULL THEN 'ELIGIBLE' ELSE 'ML_NOT_EVALUABLE' END AS eligibility FROM facts""")
def ml_features(t):
    named = ["tls_version", "group_absence_reason", "certificate_absence_reason", "certificate_observed", "forward_secrecy_observed", "cert_key_algorithm", "cert_key_bits"]
    days = F.col("cert_lifetime_days").cast("long").alias("cert_lifetime_days")
    return profiles.profile(facts(t)).select("capture_id", "session_id", *named, days, "evidence_completeness", "eligibility")


@query(f"""WITH {FACTS_SQL} SELECT capture_id, count(*) AS sessions, count(*) FILTER (has_tls AND selected_version IS NOT NULL AND suite IS NOT NULL) AS eligible,
  count(*) FILTER (NOT (has_tls AND selected_version IS NOT NULL AND suite IS NOT NULL)) AS not_evaluable FROM facts GROUP BY capture_id""")
def ml_summary(t):
    counts = {"sessions": F.count(F.lit(1)), "eligible": F.count_if(F.col("eligibility") == "ELIGIBLE"), "not_evaluable": F.count_if(F.col("eligibility") != "ELIGIBLE")}
    return profiles.profile(facts(t)).groupBy("capture_id").agg(*[c.alias(n) for n, c in counts.items()])


@query("""SELECT 'train' AS part, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('MACHINERY') UNION ALL SELECT 'holdout', count(*) FROM customer WHERE c_mktsegment IN ('MACHINERY')
UNION ALL SELECT 'overlap', count(*) FROM (SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('MACHINERY') INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY'))""")
def family_holdout(t):
    stay, out = inventory.holdout(t.customer, "c_mktsegment", ["MACHINERY"])
    parts = {"train": stay, "holdout": out, "overlap": inventory.overlap(stay, out, ["c_custkey"])}
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n") for part, df in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("""SELECT o_orderkey AS session_id, count(l_linenumber) AS n_warnings, coalesce(string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus), '') AS codes
FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def warning_routing(t):
    warnings = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("session_id"), F.col("l_linestatus").alias("code"))
    return inventory.routed(warnings, t.orders.select(F.col("o_orderkey").alias("session_id")))


@query("""SELECT l_orderkey AS session_id, 'SEQUENCE_GAP' AS code, CAST(l_quantity AS BIGINT)::VARCHAR || ' bytes missing at ' || l_linenumber || ' of ' || l_linestatus AS message FROM lineitem WHERE l_returnflag = 'A'""")
def gap_warnings(t):
    gaps = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("session_id"), F.col("l_linestatus").alias("direction"), F.col("l_linenumber").alias("offset"), F.col("l_quantity").cast("long").alias("length"))
    return inventory.gap_warnings(gaps)


@query("""SELECT l_orderkey, min(l_linenumber) AS start, max(l_linenumber + 1) AS "end", count(*) AS lines, count(DISTINCT l_suppkey) AS packets, bool_and(l_linestatus = 'F') AS whole, bool_or(l_returnflag = 'R') AS ambiguous FROM lineitem GROUP BY l_orderkey""")
def merged_spans(t):
    lines = dealt(t.lineitem, "l_orderkey").select("l_orderkey", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.col("l_suppkey").alias("packet"), (F.col("l_linestatus") == "F").alias("whole"), (F.col("l_returnflag") == "R").alias("ambiguous"))
    return inventory.merged_spans(lines, ["l_orderkey"])


@query(f"""WITH {FACTS_SQL}, n AS (SELECT capture_id, session_id, row_number() OVER (PARTITION BY capture_id ORDER BY session_id) AS i FROM facts) SELECT capture_id, session_id, i <= 100 AS admitted FROM n""")
def session_admission(t):
    return inventory.admitted(facts(t).select("capture_id", "session_id"), "capture_id", ["session_id"], 100)


@query()
def admission_limits(t):
    """Sessions of orders as a sensor with little room would take them; a walk that SQL can't state, so tests hold it against plain Python."""
    start = F.col("o_orderkey") * 3
    rows = t.orders.select(F.concat(F.lit("cap-"), (F.col("o_custkey") % 20).cast("string")).alias("capture_id"), F.col("o_custkey").alias("flow"), start.alias("start"), (start + 50 + F.col("o_orderkey") % 400).alias("end"))
    return inventory.admission(rows, "flow", 8, 1000)


#: Chains from suppliers: a supplier's certificate is issued by its nation, that by its region; two regions are anchors.
_CHAIN_SQL = """held AS (SELECT s_suppkey AS session_id, 0 AS position, 'S' || s_suppkey AS subject, 'N' || s_nationkey AS issuer, s_suppkey % 11 <> 0 AS valid FROM supplier
  UNION ALL SELECT s_suppkey, 1, 'N' || s_nationkey, 'R' || n_regionkey, s_nationkey % 7 <> 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0)"""


@query(f"""WITH {_CHAIN_SQL} SELECT l.session_id, l.subject AS leaf, CASE WHEN NOT l.valid THEN 'FAILED' WHEN p.subject IS NULL THEN 'NOT_AVAILABLE' WHEN NOT p.valid THEN 'FAILED' WHEN p.issuer IN ('R0', 'R1') THEN 'PASSED' ELSE 'NOT_AVAILABLE' END AS status
FROM held l LEFT JOIN held p ON p.session_id = l.session_id AND p.subject = l.issuer AND p.position = 1 WHERE l.position = 0""")
def chain_checks(t):
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    leaves = t.supplier.select(F.col("s_suppkey").alias("session_id"), F.lit(0).alias("position"), named("S", "s_suppkey").alias("subject"), named("N", "s_nationkey").alias("issuer"), (F.col("s_suppkey") % 11 != 0).alias("ok"))
    middle = t.supplier.where("s_suppkey % 5 <> 0").join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    middle = middle.select(F.col("s_suppkey").alias("session_id"), F.lit(1).alias("position"), named("N", "s_nationkey").alias("subject"), named("R", "n_regionkey").alias("issuer"), (F.col("s_nationkey") % 7 != 0).alias("ok"))
    dated = leaves.unionByName(middle).withColumns({"not_before_us": F.lit(0), "not_after_us": F.when(F.col("ok"), 100).otherwise(1), "at": F.lit(50)})
    return inventory.chains(dated, t.region.where("r_regionkey < 2").select(named("R", "r_regionkey").alias("subject")), "at", depth=3)


@query("""SELECT count(DISTINCT n_name) AS anchors, sha256(array_to_string(list_sort(list_distinct(list(n_name))), chr(10))) AS digest FROM nation""")
def trust_store_digest(t):
    return inventory.anchor_digest(t.nation, "n_name")


@query(f"""WITH {FACTS_SQL} SELECT capture_id, session_id, concat_ws(',', CASE WHEN lower(signature_hash) = 'md5' THEN 'MD5_SIGNATURE' END, CASE WHEN lower(signature_hash) = 'sha1' THEN 'SHA1_SIGNATURE' END,
  CASE WHEN key_algorithm IN ('RSA', 'DSA') AND key_bits < 2048 THEN 'SHORT_RSA_OR_DSA_KEY' END, CASE WHEN key_algorithm = 'EC' AND key_bits < 224 THEN 'SHORT_EC_KEY' END, CASE WHEN key_algorithm IN ('ED25519', 'ED448') THEN 'EDWARDS_KEY' END) AS notes FROM facts""")
def policy_notes(t):
    return inventory.policy_notes(facts(t))


@query(f"""WITH {RESULTS_SQL}, bad AS (SELECT DISTINCT session_id FROM results WHERE counts) SELECT coalesce(selected_version::VARCHAR, 'UNKNOWN') AS version, coalesce(protocol, 'UNKNOWN') AS protocol, count(*) AS sessions, count(*) FILTER (has_tls) AS with_tls,
  count(*) FILTER (cert_visibility = 'OBSERVED') AS certificate_observed, count(*) FILTER (cert_visibility = 'ENCRYPTED_TLS13') AS certificate_encrypted, count(bad.session_id) AS with_findings FROM facts LEFT JOIN bad USING (session_id) GROUP BY ALL""")
def module_counts(t):
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias(n) for c, n in (("selected_version", "version"), ("protocol", "protocol"))]
    counts = {"with_tls": F.col("has_tls"), "certificate_observed": F.col("cert_visibility") == "OBSERVED", "certificate_encrypted": F.col("cert_visibility") == "ENCRYPTED_TLS13"}
    f = facts(t)
    bad = rules.failures(f).select(F.col("session_id").alias("_bad")).distinct()
    rows = f.join(bad, F.col("session_id") == F.col("_bad"), "left")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("sessions"), *[F.count_if(c).alias(n) for n, c in counts.items()], F.count("_bad").alias("with_findings"))


_SCORES = _score_sql("session_id").removeprefix(UNITS_SQL)


@query(f"""WITH {UNITS_SQL}{_SCORES.replace("SELECT session_id, e AS weighted_evaluated", ", s AS (SELECT session_id, e AS weighted_evaluated", 1)}) SELECT session_id, score FROM s ORDER BY score ASC NULLS LAST, session_id LIMIT 50""")
def posture_strip(t):
    """The weakest sessions first, unscored ones last: a page of 50, a top-k of each task."""
    return rules.posture(facts(t)).select("session_id", "score").orderBy(F.col("score").asc_nulls_last(), "session_id").limit(50)


@query(f"""WITH {UNITS_SQL}{_SCORES.replace("SELECT session_id, e AS weighted_evaluated", ", s AS (SELECT session_id, e AS weighted_evaluated", 1)}) SELECT count(*) AS sessions, count(*) FILTER (score IS NULL) AS unscored, min(score) AS weakest, max(score) AS strongest, round_even(avg(coverage), 4) AS mean_coverage FROM s""")
def posture_span(t):
    counts = [F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("score").isNull()).alias("unscored"), F.min("score").alias("weakest"), F.max("score").alias("strongest"), F.bround(F.avg("coverage"), 4).alias("mean_coverage")]
    return rules.posture(facts(t)).agg(*counts)


@query(f"""WITH {FINDINGS_SQL} SELECT f.session_id, f.selected_version, f.suite, f.protocol, count(finding_id) AS findings, coalesce(string_agg(rule_id, ',' ORDER BY sr, rule_id), '') AS rules
FROM facts f LEFT JOIN found d USING (session_id) WHERE f.capture_id = 'cap-3' GROUP BY ALL""")
def session_detail(t):
    """The sessions of one capture with their findings by severity: a filtered join."""
    f = facts(t).where("capture_id = 'cap-3'")
    found = rules.findings(rules.failures(f)).groupBy("session_id").agg(F.count(F.lit(1)).alias("findings"), F.sort_array(F.collect_list(F.struct(rules.rank(F.col("severity"), rules.SEVERITIES).alias("s"), "rule_id"))).alias("_r"))
    names = F.coalesce(F.array_join(F.transform("_r", lambda x: x["rule_id"]), ","), F.lit(""))
    return f.join(found, "session_id", "left").select("session_id", "selected_version", "suite", "protocol", F.coalesce("findings", F.lit(0)).alias("findings"), names.alias("rules"))
