"""Rules, scores and priorities over facts that are derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules
from .registry import query, spread, us

#: Input for the rules: a wide row of session facts for each order, in words that both engines read alike.
FACTS = {
    "capture_id": "concat('cap-', cast(o_custkey % 20 as {text}))",
    "session_id": "concat('s', cast(o_orderkey as {text}))",
    "has_tls": "o_orderkey % 10 <> 0",
    "client_hello": "o_orderkey % 13 <> 0",
    "selected_version": "case when o_orderkey % 5 = 4 then null else 769 + o_orderkey % 5 end",
    "lowest_offered": "769 + o_custkey % 4",
    "fatal_alert": "o_orderkey % 17 = 0",
    "handshake_state": "case o_orderkey % 4 when 0 then 'NOT_OBSERVED' when 1 then 'INDETERMINATE' else 'NEGOTIATED' end",
    "suite": "case when o_orderkey % 11 = 0 then null else o_orderkey % 100 end",
    "suite_known": "o_custkey % 7 <> 0",
    "tls13_suite": "o_custkey % 8 = 0",
    "encryption": "case o_custkey % 6 when 0 then 'NULL' when 1 then 'RC4_128' when 2 then '3DES_EDE_CBC' when 3 then 'AES_128_CBC' when 4 then 'AES_256_GCM' else 'CHACHA20_POLY1305' end",
    "authentication": "case when o_custkey % 12 = 1 then 'ANONYMOUS' else 'RSA' end",
    "fs_status": "case o_orderkey % 6 when 0 then 'STATIC_RSA' when 1 then 'PSK_ONLY' when 2 then 'CAPABLE' when 3 then 'UNKNOWN' else 'EPHEMERAL_OBSERVED' end",
    "group_family": "case when o_custkey % 5 = 0 then 'HYBRID' else 'ECDHE' end",
    "cert_visibility": "case when o_orderkey % 3 = 0 then 'ENCRYPTED_TLS13' else 'OBSERVED' end",
    "not_before_us": "1000 + o_custkey % 300",
    "not_after_us": "1500 + o_custkey % 400",
    "capture_us": "1000 + o_orderkey % 1000",
    "analysis_us": "cast(null as bigint)",
    "key_algorithm": "case o_custkey % 4 when 0 then 'RSA' when 1 then 'EC' when 2 then 'DSA' else null end",
    "key_bits": "case when o_custkey % 9 = 0 then null when o_custkey % 4 = 1 then 192 + o_orderkey % 2 * 64 else 1024 + o_orderkey % 2 * 1024 end",
    "signature_hash": "case o_custkey % 5 when 0 then 'md5' when 1 then 'SHA1' when 2 then null else 'sha256' end",
    "chain_status": "case o_custkey % 3 when 0 then 'PASSED' when 1 then 'FAILED' else 'NOT_AVAILABLE' end",
    "hostname_status": "case o_orderkey % 7 when 0 then 'FAILED' when 1 then 'PASSED' else null end",
    "eku_count": "o_custkey % 3",
    "eku_server_auth": "o_custkey % 2 = 0",
    "detection": "case o_orderkey % 3 when 0 then 'CONFIRMED' when 1 then 'PROBABLE' else 'NOT_IDENTIFIED' end",
    "implicit_tls": "o_custkey % 10 = 3",
    "parse_state": "case o_custkey % 3 when 0 then 'COMPLETE' when 1 then 'HANDED_OFF' else 'TRUNCATED' end",
    "auth_count": "o_orderkey % 3",
    "auth_before_upgrade": "o_custkey % 2 * (o_orderkey % 3)",
    "upgrade_state": "case o_orderkey % 5 when 0 then 'UPGRADE_ACCEPTED' when 1 then 'TLS_BYTES_OBSERVED' when 2 then 'UPGRADE_REJECTED' when 3 then 'UPGRADE_REQUESTED' else 'NOT_OBSERVED' end",
    "upgrade_requested": "o_orderkey % 5 < 4",
    "commands_after_refusal": "o_custkey % 4",
    "capabilities_seen": "o_custkey % 6 <> 0",
    "upgrade_advertised": "o_orderkey % 4 <> 0",
    "protocol": "case o_custkey % 4 when 0 then 'SMTP' when 1 then 'IMAP' when 2 then 'POP3' else null end",
    "tls_group": "case when o_orderkey % 6 = 0 then null else 23 + o_custkey % 3 end",
    "kex": "case o_custkey % 3 when 0 then 'RSA' when 1 then 'ECDHE' else null end",
    "sni": "case when o_orderkey % 4 = 0 then null else 'mail.example' end",
    "offered_suites": "o_custkey % 45",
    "offered_versions": "o_orderkey % 7",
    "offered_tls13": "o_custkey % 3 = 2",
    "leaf_sha256": "case when o_custkey % 6 = 0 then null else concat('L', cast(o_custkey % 50 as {text})) end",
    "spki_sha256": "case when o_custkey % 6 = 0 then null else concat('K', cast(o_custkey % 40 as {text})) end",
}
FACTS_SQL = "facts AS (SELECT " + ", ".join(f"{e.format(text='varchar')} AS {n}" for n, e in FACTS.items()) + " FROM orders)"


def facts(t) -> DataFrame:
    return spread(t.orders).selectExpr(*[f"{e.format(text='string')} AS {n}" for n, e in FACTS.items()])


_CIPHER = "CASE WHEN NOT has_tls THEN 'NOT_APPLICABLE' WHEN suite IS NULL OR NOT suite_known THEN 'UNKNOWN' WHEN {} THEN 'FAIL' ELSE 'PASS' END"
_CERT = "CASE WHEN NOT has_tls OR cert_visibility <> 'OBSERVED' THEN 'NOT_APPLICABLE' WHEN {} IS NULL THEN 'UNKNOWN' WHEN {} THEN 'FAIL' ELSE 'PASS' END"
_CHECK = "CASE WHEN NOT has_tls OR cert_visibility <> 'OBSERVED' THEN 'NOT_APPLICABLE' WHEN {0} = 'FAILED' THEN 'FAIL' WHEN {0} = 'PASSED' THEN 'PASS' ELSE 'UNKNOWN' END"
_MAIL = "CASE WHEN implicit_tls OR detection NOT IN ('CONFIRMED', 'PROBABLE') {} END"
_ANONYMOUS = "authentication = 'ANONYMOUS'"
_OK = "upgrade_state IN ('UPGRADE_ACCEPTED', 'TLS_BYTES_OBSERVED')"
CASES = {
    "CERT-001": _CERT.format("not_after_us", "capture_us > not_after_us"),
    "CERT-002": _CERT.format("not_before_us", "capture_us < not_before_us"),
    "CERT-003": "CASE WHEN NOT has_tls OR cert_visibility <> 'OBSERVED' THEN 'NOT_APPLICABLE' WHEN key_algorithm IS NULL THEN 'UNKNOWN' WHEN key_bits IS NULL THEN 'NOT_APPLICABLE' WHEN key_bits < CASE WHEN key_algorithm IN ('RSA', 'DSA') THEN 2048 ELSE 224 END THEN 'FAIL' ELSE 'PASS' END",
    "CERT-004": _CERT.format("signature_hash", "lower(signature_hash) IN ('md5', 'sha1')"),
    "CERT-005": _CHECK.format("chain_status"),
    "CERT-006": _CHECK.format("hostname_status"),
    "CERT-007": _CERT.format("nullif(eku_count, 0)", "NOT eku_server_auth"),
    "MAIL-001": _MAIL.format(f"THEN 'NOT_APPLICABLE' WHEN auth_count = 0 THEN CASE WHEN parse_state IN ('COMPLETE', 'HANDED_OFF') THEN 'PASS' ELSE 'UNKNOWN' END WHEN {_OK} AND auth_before_upgrade = 0 THEN 'PASS' ELSE 'FAIL'"),
    "MAIL-002": _MAIL.format(f"OR NOT {_OK} THEN 'NOT_APPLICABLE' WHEN auth_before_upgrade > 0 THEN 'FAIL' ELSE 'PASS'"),
    "MAIL-003": _MAIL.format(f"OR NOT upgrade_requested THEN 'NOT_APPLICABLE' WHEN upgrade_state = 'UPGRADE_REJECTED' THEN 'FAIL' WHEN {_OK} THEN 'PASS' ELSE 'UNKNOWN'"),
    "MAIL-004": _MAIL.format(f"OR NOT {_OK} THEN 'NOT_APPLICABLE' WHEN upgrade_state = 'UPGRADE_ACCEPTED' THEN 'FAIL' ELSE 'PASS'"),
    "MAIL-005": _MAIL.format("OR upgrade_state <> 'UPGRADE_REJECTED' THEN 'NOT_APPLICABLE' WHEN commands_after_refusal > 0 THEN 'FAIL' ELSE 'PASS'"),
    "MAIL-006": _MAIL.format("THEN 'NOT_APPLICABLE' WHEN NOT capabilities_seen THEN 'UNKNOWN' WHEN upgrade_advertised THEN 'PASS' ELSE 'FAIL'"),
    "MAIL-007": "CASE WHEN NOT implicit_tls THEN 'NOT_APPLICABLE' WHEN selected_version IS NOT NULL THEN 'PASS' ELSE 'UNKNOWN' END",
    "TLS-CIPHER-001": _CIPHER.format("encryption = 'NULL'"),
    "TLS-CIPHER-002": f"CASE WHEN tls13_suite THEN 'NOT_APPLICABLE' ELSE {_CIPHER.format(_ANONYMOUS)} END",
    "TLS-CIPHER-003": _CIPHER.format("encryption IN ('RC4_128', 'RC4_40', 'DES_CBC', 'DES40_CBC', 'RC2_CBC_40')"),
    "TLS-CIPHER-004": _CIPHER.format("encryption = '3DES_EDE_CBC'"),
    "TLS-CIPHER-005": _CIPHER.format("encryption NOT IN ('AES_128_GCM', 'AES_256_GCM', 'AES_128_CCM', 'AES_256_CCM', 'CHACHA20_POLY1305')"),
    "TLS-CIPHER-006": "CASE WHEN NOT has_tls OR suite IS NULL THEN 'NOT_APPLICABLE' WHEN NOT suite_known THEN 'UNKNOWN' ELSE 'PASS' END",
    "TLS-KEX-001": "CASE WHEN NOT has_tls THEN 'NOT_APPLICABLE' WHEN fs_status IN ('STATIC_RSA', 'PSK_ONLY', 'NOT_FORWARD_SECRET') THEN 'FAIL' WHEN fs_status IN ('EPHEMERAL_OBSERVED', 'CAPABLE') THEN 'PASS' ELSE 'UNKNOWN' END",
    "TLS-KEX-002": "CASE WHEN has_tls AND group_family = 'HYBRID' THEN 'PASS' ELSE 'NOT_APPLICABLE' END",
    "TLS-PROTO-001": "CASE WHEN NOT has_tls THEN 'NOT_APPLICABLE' WHEN selected_version IS NULL THEN 'UNKNOWN' WHEN selected_version < 771 THEN 'FAIL' ELSE 'PASS' END",
    "TLS-PROTO-002": "CASE WHEN NOT has_tls THEN 'NOT_APPLICABLE' WHEN NOT client_hello THEN 'UNKNOWN' WHEN lowest_offered < 771 THEN 'FAIL' ELSE 'PASS' END",
    "TLS-PROTO-003": "CASE WHEN NOT has_tls THEN 'NOT_APPLICABLE' WHEN fatal_alert THEN 'FAIL' WHEN handshake_state IN ('NOT_OBSERVED', 'INDETERMINATE') THEN 'UNKNOWN' ELSE 'PASS' END",
}
_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}
_W = {"CRITICAL": 10, "HIGH": 6, "MEDIUM": 3, "LOW": 1, "INFO": 0}
RESULTS_SQL = FACTS_SQL + ", r AS (" + " UNION ALL ".join(
    f"SELECT capture_id, session_id, '{i}' AS rule_id, '{s}' AS severity, {_RANK[s]} AS sr, '{g}' AS dedup_group, {_W[s]}.0::DOUBLE AS weight, {CASES[i]} AS outcome, "
    + ("'LOW'" if i == "MAIL-004" else "CASE WHEN detection IN ('CONFIRMED', 'PROBABLE') THEN detection ELSE 'LOW' END" if i.startswith("MAIL") else "CASE WHEN NOT has_tls OR handshake_state = 'INDETERMINATE' THEN 'LOW' WHEN selected_version IS NOT NULL THEN 'CONFIRMED' ELSE 'PROBABLE' END")
    + " AS confidence FROM facts"
    for i, s, g, _ in rules.RULES
) + """), results AS (SELECT *, outcome = 'FAIL' AND row_number() OVER (PARTITION BY session_id, dedup_group ORDER BY CASE WHEN outcome = 'FAIL' THEN 0 ELSE 1 END, sr, rule_id) = 1 AS counts FROM r)"""
UNITS_SQL = RESULTS_SQL + """, units AS (SELECT capture_id, session_id, dedup_group, rule_id, outcome, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, dedup_group ORDER BY CASE outcome WHEN 'FAIL' THEN 0 WHEN 'PASS' THEN 1 WHEN 'UNKNOWN' THEN 2 ELSE 3 END, sr, rule_id) AS n FROM r) WHERE n = 1)"""


def _score_sql(key: str) -> str:
    return UNITS_SQL + f""", a AS (SELECT {key}, sum(CASE WHEN outcome IN ('FAIL', 'PASS') THEN weight ELSE 0 END) AS e, sum(CASE WHEN outcome = 'FAIL' THEN weight ELSE 0 END) AS d, sum(CASE WHEN outcome <> 'NOT_APPLICABLE' THEN weight ELSE 0 END) AS p FROM units GROUP BY {key}),
b AS (SELECT *, CASE WHEN e > 0 AND e / p >= 0.5 THEN CAST(greatest(0, least(100, round_even(100 * (e - d) / e, 0))) AS BIGINT) END AS score FROM a)
SELECT {key}, e AS weighted_evaluated, d AS weighted_deductions, p AS weighted_applicable, CASE WHEN p > 0 THEN round_even(e / p, 4) END AS coverage, score, CASE WHEN score IS NULL THEN 'SCORE_UNAVAILABLE' ELSE 'SCORED' END AS status,
  CASE WHEN score >= 90 THEN 'STRONG' WHEN score >= 70 THEN 'ADEQUATE' WHEN score >= 40 THEN 'WEAK' WHEN score IS NOT NULL THEN 'CRITICAL' END AS band FROM b"""


FINDINGS_SQL = RESULTS_SQL + f""", found AS (SELECT 'find-' || substr(sha256('default|{rules.Policy().fingerprint()}|' || rule_id || '|' || capture_id || '|' || session_id || '||'), 1, 16) AS finding_id, capture_id, session_id, rule_id, severity, sr, dedup_group, confidence, weight FROM results WHERE counts)"""


@query(f"WITH {RESULTS_SQL} SELECT capture_id, session_id, rule_id, severity, dedup_group, weight, outcome, confidence, counts FROM results")
def rule_results(t):
    return rules.evaluate(facts(t))


@query(f"WITH {RESULTS_SQL} SELECT session_id, count(*) FILTER (outcome = 'FAIL') AS n_fail, count(*) FILTER (outcome = 'PASS') AS n_pass, count(*) FILTER (outcome = 'UNKNOWN') AS n_unknown, count(*) FILTER (outcome = 'NOT_APPLICABLE') AS n_not_applicable, count(*) FILTER (outcome = 'FAIL' AND NOT counts) AS n_suppressed FROM results GROUP BY session_id")
def rule_pivot(t):
    return rules.tally(rules.evaluate(facts(t)), ["session_id"])


@query(f"WITH {RESULTS_SQL} SELECT session_id, dedup_group, rule_id, severity FROM results WHERE counts")
def rule_dedup(t):
    return rules.failures(facts(t)).select("session_id", "dedup_group", "rule_id", "severity")


@query(f"WITH {FINDINGS_SQL} SELECT finding_id, capture_id, session_id, rule_id, severity, dedup_group, confidence, weight FROM found")
def findings(t):
    return rules.findings(rules.failures(facts(t)))


@query(f"WITH {UNITS_SQL} SELECT * FROM units")
def scoring_units(t):
    return rules.session_units(facts(t))


@query("WITH " + _score_sql("session_id"))
def posture_score(t):
    return rules.posture(facts(t)).drop("capture_id")


@query("WITH " + _score_sql("capture_id"))
def capture_score(t):
    return rules.posture(facts(t), ["capture_id"])


_PRIORITY = " ".join(f"WHEN severity = '{s}' AND confidence = '{c}' THEN '{p}'" for s, row in rules.PRIORITIES.items() for c, p in zip(rules.CONFIDENCES, row, strict=True))


@query(f"""WITH {FINDINGS_SQL}, s AS (SELECT *, count(*) OVER (PARTITION BY rule_id) AS scope FROM found)
SELECT finding_id, rule_id, severity, confidence, scope, CASE {_PRIORITY} END AS priority,
  row_number() OVER (ORDER BY sr, CASE confidence WHEN 'CONFIRMED' THEN 0 WHEN 'PROBABLE' THEN 1 ELSE 2 END, scope DESC, rule_id, finding_id) AS rank FROM s""")
def prioritised(t):
    return rules.prioritised(rules.findings(rules.failures(facts(t)))).select("finding_id", "rule_id", "severity", "confidence", "scope", "priority", F.col("rank").cast("long").alias("rank"))


_REMEDIES = " ".join(f"WHEN '{i}' THEN '{m}'" for i, _, _, m in rules.RULES)


@query(f"""WITH {FINDINGS_SQL}, m AS (SELECT sr, unnest(string_split(CASE rule_id {_REMEDIES} END, ',')) AS remediation_id FROM found)
SELECT remediation_id, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'][min(sr) + 1] AS severity, count(*) AS findings FROM m WHERE remediation_id <> '' GROUP BY remediation_id""")
def remediation_plan(t):
    return rules.remediations(rules.findings(rules.failures(facts(t))))


@query(f"""WITH {FINDINGS_SQL} SELECT session_id, count(*) AS deductions, string_agg(dedup_group, ',' ORDER BY weight DESC, dedup_group) AS lines FROM found WHERE weight > 0 GROUP BY session_id""")
def deduction_lines(t):
    f = rules.findings(rules.failures(facts(t))).where("weight > 0")
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "dedup_group"))), lambda x: x["dedup_group"])
    return f.groupBy("session_id").agg(F.count(F.lit(1)).alias("deductions"), F.array_join(lines, ",").alias("lines"))


@query("""SELECT o_custkey, epoch_us(min(o_orderdate)) AS first_us, epoch_us(max(o_orderdate)) AS last_us, count(*) AS evidence FROM orders GROUP BY o_custkey""")
def evidence_window(t):
    return t.orders.groupBy("o_custkey").agg(us(F.min("o_orderdate")).alias("first_us"), us(F.max("o_orderdate")).alias("last_us"), F.count(F.lit(1)).alias("evidence"))


def reach(t) -> DataFrame:
    """Findings with what the relations across captures need."""
    f = rules.findings(rules.failures(facts(t)))
    o = t.orders.select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("session_id"), (F.col("o_custkey") % 97).alias("entity"), F.col("o_orderpriority").alias("protocol"), us("o_orderdate").alias("at"))
    return f.join(o, "session_id")


REACH_SQL = FINDINGS_SQL + ", reach AS (SELECT f.*, o.o_custkey % 97 AS entity, o.o_orderpriority AS protocol, epoch_us(o.o_orderdate) AS at FROM found f JOIN orders o ON f.session_id = 's' || o.o_orderkey)"
