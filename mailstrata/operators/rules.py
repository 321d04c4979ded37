"""The rule catalogue as data and its evaluation over a wide table of session facts.

Outcomes have four values: FAIL, PASS, UNKNOWN, NOT_APPLICABLE; none is ever null. A rule is a
CASE over columns of the facts that gives the outcome's place in this order, and all rules come from one pass: small numbers are exploded,
and what the catalogue says of a rule is looked up in literal arrays, so there is no join with it and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import finding_id

# Rule ids, severities, dedup groups, remediations, weights, ciphers and the priority matrix are the output contract.
RULES = [
    ("CERT-001", "HIGH", "CERT_VALIDITY", "REM-CERT-RENEW"),
    ("CERT-002", "HIGH", "CERT_VALIDITY", "REM-CERT-RENEW"),
    ("CERT-003", "HIGH", "CERT_KEY_STRENGTH", "REM-CERT-KEY"),
    ("CERT-004", "HIGH", "CERT_SIGNATURE", "REM-CERT-SIGALG"),
    ("CERT-005", "HIGH", "CERT_CHAIN", "REM-CERT-CHAIN"),
    ("CERT-006", "HIGH", "CERT_IDENTITY", "REM-CERT-IDENTITY"),
    ("CERT-007", "MEDIUM", "CERT_EKU", "REM-CERT-EKU"),
    ("MAIL-001", "CRITICAL", "PLAINTEXT_AUTH", "REM-MAIL-TLS-BEFORE-AUTH,REM-MAIL-ENABLE-STARTTLS"),
    ("MAIL-002", "HIGH", "PLAINTEXT_AUTH", "REM-MAIL-TLS-BEFORE-AUTH"),
    ("MAIL-003", "MEDIUM", "UPGRADE_OUTCOME", "REM-MAIL-ENABLE-STARTTLS,REM-MAIL-IMPLICIT-TLS"),
    ("MAIL-004", "LOW", "UPGRADE_OUTCOME", ""),
    ("MAIL-005", "HIGH", "PLAINTEXT_CONTINUATION", "REM-MAIL-TLS-BEFORE-AUTH,REM-MAIL-ENABLE-STARTTLS"),
    ("MAIL-006", "MEDIUM", "UPGRADE_AVAILABILITY", "REM-MAIL-ENABLE-STARTTLS,REM-MAIL-IMPLICIT-TLS"),
    ("MAIL-007", "INFO", "IMPLICIT_TLS_VISIBILITY", ""),
    ("TLS-CIPHER-001", "CRITICAL", "NEGOTIATED_CIPHER_SUITE", "REM-TLS-CIPHER"),
    ("TLS-CIPHER-002", "CRITICAL", "NEGOTIATED_CIPHER_SUITE", "REM-TLS-CIPHER"),
    ("TLS-CIPHER-003", "HIGH", "NEGOTIATED_CIPHER_SUITE", "REM-TLS-CIPHER"),
    ("TLS-CIPHER-004", "MEDIUM", "NEGOTIATED_CIPHER_SUITE", "REM-TLS-CIPHER"),
    ("TLS-CIPHER-005", "MEDIUM", "NEGOTIATED_CIPHER_SUITE", "REM-TLS-CIPHER"),
    ("TLS-CIPHER-006", "INFO", "UNKNOWN_CIPHER_SUITE", ""),
    ("TLS-KEX-001", "HIGH", "FORWARD_SECRECY", "REM-TLS-FS"),
    ("TLS-KEX-002", "INFO", "HYBRID_GROUP", ""),
    ("TLS-PROTO-001", "HIGH", "NEGOTIATED_PROTOCOL_VERSION", "REM-TLS-VERSION"),
    ("TLS-PROTO-002", "INFO", "OFFERED_PROTOCOL_VERSION", "REM-TLS-VERSION"),
    ("TLS-PROTO-003", "LOW", "NEGOTIATION_OUTCOME", ""),
]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
WEIGHTS = {"CRITICAL": 10.0, "HIGH": 6.0, "MEDIUM": 3.0, "LOW": 1.0, "INFO": 0.0}
WEAK = ["RC4_128", "RC4_40", "DES_CBC", "DES40_CBC", "RC2_CBC_40"]
APPROVED = ["AES_128_GCM", "AES_256_GCM", "AES_128_CCM", "AES_256_CCM", "CHACHA20_POLY1305"]
PRIORITIES = {
    "CRITICAL": ("P1", "P1", "P2"),
    "HIGH": ("P1", "P2", "P3"),
    "MEDIUM": ("P2", "P3", "P3"),
    "LOW": ("P3", "P4", "P4"),
    "INFO": ("P4", "P4", "P4"),
}
CONFIDENCES = ["CONFIRMED", "PROBABLE", "LOW"]
OUTCOMES = ["FAIL", "PASS", "UNKNOWN", "NOT_APPLICABLE"]
FAIL, PASS, UNKNOWN, NOT_APPLICABLE = range(4)


@dataclass(frozen=True)
class Policy:
    """Thresholds and overrides; part of every finding's id by its fingerprint."""

    policy_id: str = "default"
    version: str = "1"
    minimum_version: int = 0x0303
    minimum_rsa_bits: int = 2048
    minimum_ec_bits: int = 224
    minimum_coverage: float = 0.5
    current_time: bool = False
    disabled: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=dict)

    def fingerprint(self) -> str:
        import hashlib

        plain = Policy(self.policy_id, self.version)
        changed = sorted(f"{k}={v}" for k, v in vars(self).items() if v != vars(plain)[k])
        return hashlib.sha256("|".join([self.policy_id, self.version, *changed]).encode()).hexdigest()[:12]


def rank(c: Column, values: list[str]) -> Column:
    """The place of a value in a list, from 0."""
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(c == v, i).otherwise(out)
    return out


def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _fails(test: Column) -> Column:
    return F.when(test, FAIL).otherwise(PASS)


def outcomes(p: Policy) -> dict[str, Column]:
    """rule id -> place of the outcome in OUTCOMES, over the columns of session facts."""
    na, unknown = F.lit(NOT_APPLICABLE), F.lit(UNKNOWN)
    no_tls, enc = ~_true("has_tls"), F.col("encryption")
    cipher = lambda test: F.when(no_tls, na).when(F.col("suite").isNull() | ~_true("suite_known"), unknown).otherwise(_fails(F.coalesce(test, F.lit(False))))
    cert = lambda verdict: F.when(no_tls | (F.coalesce(F.col("cert_visibility"), F.lit("")) != "OBSERVED"), na).otherwise(verdict)
    at = F.col("analysis_us") if p.current_time else F.col("capture_us")
    dates = lambda c, test: cert(F.when(F.col(c).isNull() | at.isNull(), unknown).otherwise(_fails(test)))
    check = lambda c: cert(F.when(F.col(c) == "FAILED", FAIL).when(F.col(c) == "PASSED", PASS).otherwise(unknown))
    identified = F.coalesce(F.col("detection").isin("CONFIRMED", "PROBABLE"), F.lit(False)) & ~_true("implicit_tls")
    upgraded = F.coalesce(F.col("upgrade_state").isin("UPGRADE_ACCEPTED", "TLS_BYTES_OBSERVED"), F.lit(False))
    rejected = F.coalesce(F.col("upgrade_state") == "UPGRADE_REJECTED", F.lit(False))
    no_auth = F.coalesce(F.col("auth_count"), F.lit(0)) == 0
    early = F.coalesce(F.col("auth_before_upgrade"), F.lit(0)) > 0
    rsa_like = F.coalesce(F.col("key_algorithm").isin("RSA", "DSA"), F.lit(False))
    weak_key = F.when(rsa_like, F.col("key_bits") < p.minimum_rsa_bits).otherwise(F.col("key_bits") < p.minimum_ec_bits)
    fs = F.col("fs_status")
    return {
        "CERT-001": dates("not_after_us", at > F.col("not_after_us")),
        "CERT-002": dates("not_before_us", at < F.col("not_before_us")),
        "CERT-003": cert(F.when(F.col("key_algorithm").isNull(), unknown).when(F.col("key_bits").isNull(), na).otherwise(_fails(weak_key))),
        "CERT-004": cert(F.when(F.col("signature_hash").isNull(), unknown).otherwise(_fails(F.lower("signature_hash").isin("md5", "sha1")))),
        "CERT-005": check("chain_status"),
        "CERT-006": check("hostname_status"),
        "CERT-007": cert(F.when(F.coalesce(F.col("eku_count"), F.lit(0)) == 0, unknown).otherwise(_fails(~_true("eku_server_auth")))),
        "MAIL-001": F.when(~identified, na).when(no_auth, F.when(F.col("parse_state").isin("COMPLETE", "HANDED_OFF"), PASS).otherwise(unknown)).when(upgraded & ~early, PASS).otherwise(FAIL),
        "MAIL-002": F.when(~identified | ~upgraded, na).otherwise(_fails(early)),
        "MAIL-003": F.when(~identified | ~_true("upgrade_requested"), na).when(rejected, FAIL).when(upgraded, PASS).otherwise(unknown),
        "MAIL-004": F.when(~identified | ~upgraded, na).otherwise(_fails(F.col("upgrade_state") == "UPGRADE_ACCEPTED")),
        "MAIL-005": F.when(~identified | ~rejected, na).otherwise(_fails(F.coalesce(F.col("commands_after_refusal"), F.lit(0)) > 0)),
        "MAIL-006": F.when(~identified, na).when(~_true("capabilities_seen"), unknown).otherwise(_fails(~_true("upgrade_advertised"))),
        "MAIL-007": F.when(~_true("implicit_tls"), na).when(F.col("selected_version").isNotNull(), PASS).otherwise(unknown),
        "TLS-CIPHER-001": cipher(enc == "NULL"),
        "TLS-CIPHER-002": F.when(_true("tls13_suite"), na).otherwise(cipher(F.col("authentication") == "ANONYMOUS")),
        "TLS-CIPHER-003": cipher(enc.isin(WEAK)),
        "TLS-CIPHER-004": cipher(enc == "3DES_EDE_CBC"),
        "TLS-CIPHER-005": cipher(~enc.isin(APPROVED)),
        "TLS-CIPHER-006": F.when(no_tls | F.col("suite").isNull(), na).when(~_true("suite_known"), unknown).otherwise(PASS),
        "TLS-KEX-001": F.when(no_tls, na).when(fs.isin("STATIC_RSA", "PSK_ONLY", "NOT_FORWARD_SECRET"), FAIL).when(fs.isin("EPHEMERAL_OBSERVED", "CAPABLE"), PASS).otherwise(unknown),
        "TLS-KEX-002": F.when(~no_tls & (F.col("group_family") == "HYBRID"), PASS).otherwise(na),
        "TLS-PROTO-001": F.when(no_tls, na).when(F.col("selected_version").isNull(), unknown).otherwise(_fails(F.col("selected_version") < p.minimum_version)),
        "TLS-PROTO-002": F.when(no_tls, na).when(~_true("client_hello"), unknown).otherwise(_fails(F.coalesce(F.col("lowest_offered") < p.minimum_version, F.lit(False)))),
        "TLS-PROTO-003": F.when(no_tls, na).when(_true("fatal_alert"), FAIL).when(F.coalesce(F.col("handshake_state"), F.lit("NOT_OBSERVED")).isin("NOT_OBSERVED", "INDETERMINATE"), unknown).otherwise(PASS),
    }


def confidence(family: Column) -> Column:
    """CONFIRMED, PROBABLE or LOW by what a family of rules rests on: MAIL or TLS."""
    tls = F.when(~_true("has_tls") | F.coalesce(F.col("handshake_state") == "INDETERMINATE", F.lit(False)), "LOW").when(F.col("selected_version").isNotNull(), "CONFIRMED").otherwise("PROBABLE")
    mail = F.when(F.col("detection") == "CONFIRMED", "CONFIRMED").when(F.col("detection") == "PROBABLE", "PROBABLE").otherwise("LOW")
    return F.when(family == "MAIL", mail).otherwise(tls)


def _outcome_columns(facts: DataFrame, policy: Policy) -> tuple[DataFrame, list]:
    """facts' ids, the confidences and for each enabled rule, the most severe first, a column _o<number> with the place of its outcome; and these rules."""
    cases = outcomes(policy)
    enabled = sorted((r for r in RULES if r[0] not in policy.disabled), key=lambda r: (SEVERITIES.index(r[1]), r[0]))
    sure = [confidence(F.lit("TLS")).alias("_tls"), confidence(F.lit("MAIL")).alias("_mail")]
    return facts.select("capture_id", "session_id", *[cases[r].alias(f"_o{i}") for i, (r, *_) in enumerate(enabled)], *sure, *[c for c in EVIDENCE if c in facts.columns]), enabled


#: Columns of facts, where they have them, that hold what a family of rules rests on: offsets and numbers of packets.
EVIDENCE = ["tls_packets", "certificate_packets", "mail_offsets", "mail_packets"]


def _looked_up(values: list, number: str) -> str:
    each = ", ".join(f"{v!r}D" if isinstance(v, float) else f"'{v}'" for v in values)
    return f"element_at(array({each}), {number} + 1)"


def _weights(enabled: list, policy: Policy) -> list[float]:
    return [float(policy.weights.get(r, WEIGHTS[s])) for r, s, *_ in enabled]


def evaluate(facts: DataFrame, policy: Policy | None = None) -> DataFrame:
    """A row for every enabled rule and row of facts: capture_id, session_id, rule_id, severity, dedup_group, weight, outcome, confidence, counts.

    counts is false for the failures of a group that a more severe one, or one of equal severity with a smaller rule id, stands for. Where facts have
    the columns of EVIDENCE a result also has offsets and packets: of mail rules those of the dialogue, of certificate rules the packets that brought the certificates, of the others the hellos' packets.
    """
    policy = policy or Policy()
    first, enabled = _outcome_columns(facts, policy)

    def row(i: int, group: str) -> str:
        before = "".join(f" AND _o{j} <> {FAIL}" for j in range(i) if enabled[j][2] == group)
        return f"named_struct('n', {i}, 'o', _o{i}, 'counts', _o{i} = {FAIL}{before})"

    each = ", ".join(row(i, g) for i, (_, _, g, _) in enumerate(enabled))
    held = [c for c in EVIDENCE if c in facts.columns]
    # the array is written inside explode: of a column, Spark would infer a filter that holds all of it once more
    rows = first.select("capture_id", "session_id", "_tls", "_mail", *held, F.expr(f"explode(array({each}))").alias("r"))
    mail, lowest = [i for i, r in enumerate(enabled) if r[0].startswith("MAIL")], [i for i, r in enumerate(enabled) if r[0] == "MAIL-004"]
    of_certificate = f"r.n IN ({', '.join(map(str, [i for i, r in enumerate(enabled) if r[0].startswith('CERT')] or [-1]))})"
    of_mail = f"r.n IN ({', '.join(map(str, mail or [-1]))})"
    sure = f"CASE WHEN r.n IN ({', '.join(map(str, lowest or [-1]))}) THEN 'LOW' WHEN {of_mail} THEN _mail ELSE _tls END"
    names = {"rule_id": 0, "severity": 1, "dedup_group": 2}
    fixed = [F.expr(_looked_up([r[k] for r in enabled], "r.n")).alias(n) for n, k in names.items()]
    evidence = [F.expr(f"CASE WHEN {of_mail} THEN mail_offsets ELSE array() END").alias("offsets"), F.expr(f"CASE WHEN {of_mail} THEN mail_packets WHEN {of_certificate} THEN certificate_packets ELSE tls_packets END").alias("packets")] if len(held) == len(EVIDENCE) else []
    return rows.select(
        "capture_id", "session_id", *fixed, F.expr(_looked_up(_weights(enabled, policy), "r.n")).alias("weight"), F.expr(_looked_up(OUTCOMES, "r.o")).alias("outcome"),
        F.expr(sure).alias("confidence"), "r.counts", *evidence,
    )


def failures(facts: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The rows of evaluate() that count."""
    return evaluate(facts, policy).where("counts")


#: A unit is 32 times the place of its outcome and the number of its rule, so the least of a group's rules decides.
UNIT = 32  # 1 << 5


def _unit_columns(facts: DataFrame, policy: Policy) -> tuple[DataFrame, list, dict[str, str]]:
    """capture_id, session_id and for each dedup group its deciding unit: FAIL before PASS before UNKNOWN before NOT_APPLICABLE; the enabled rules; group -> column."""
    first, enabled = _outcome_columns(facts, policy)
    groups: dict[str, list[int]] = {}
    for i, (_, _, g, _) in enumerate(enabled):
        groups.setdefault(g, []).append(i)
    columns = {g: f"_u{n}" for n, g in enumerate(groups)}

    def unit(members: list[int]) -> str:
        coded = [f"_o{i} * {UNIT} + {i}" for i in members]
        return coded[0] if len(coded) == 1 else f"least({', '.join(coded)})"

    return first.select("capture_id", "session_id", *[F.expr(unit(groups[g])).alias(u) for g, u in columns.items()]), enabled, columns


def session_units(facts: DataFrame, policy: Policy | None = None) -> DataFrame:
    """units(evaluate(facts)) for facts with one row a session, without a shuffle."""
    policy = policy or Policy()
    rows, enabled, columns = _unit_columns(facts, policy)
    rows = rows.select("capture_id", "session_id", F.expr(f"explode(array({', '.join(columns.values())}))").alias("_u"))
    number = f"_u % {UNIT}"
    fixed = [F.expr(_looked_up([r[k] for r in enabled], number)).alias(n) for n, k in (("dedup_group", 2), ("rule_id", 0))]
    return rows.select("capture_id", "session_id", *fixed, F.expr(_looked_up(OUTCOMES, "shiftright(_u, 5)")).alias("outcome"), F.expr(_looked_up(_weights(enabled, policy), number)).alias("weight"))


def posture(facts: DataFrame, key: list[str] | None = None, policy: Policy | None = None) -> DataFrame:
    """score(session_units(facts), key): every session's weights are sums over its own row. Without a key a row for each session, with its ids, and no shuffle."""
    policy = policy or Policy()
    rows, enabled, columns = _unit_columns(facts, policy)
    weights = [max(0.0, w) for w in _weights(enabled, policy)]

    def total(below: int) -> str:
        return " + ".join(f"CASE WHEN {u} < {below * UNIT} THEN {_looked_up(weights, f'{u} % {UNIT}')} ELSE 0D END" for u in columns.values())

    totals = {"weighted_evaluated": total(UNKNOWN), "weighted_deductions": total(PASS), "weighted_applicable": total(NOT_APPLICABLE)}
    rows = rows.select("capture_id", "session_id", *[F.expr(c).alias(n) for n, c in totals.items()])
    if key is not None:
        rows = rows.groupBy(*key).agg(*[F.sum(n).alias(n) for n in totals])
    return _graded(rows, policy.minimum_coverage)


def tally(results: DataFrame, key: list[str]) -> DataFrame:
    """Outcomes of each key, zero-filled, and the failures that a group's representative stands for."""
    each = [F.count_if(F.col("outcome") == o).alias(f"n_{o.lower()}") for o in OUTCOMES]
    return results.groupBy(*key).agg(*each, F.count_if((F.col("outcome") == "FAIL") & ~F.col("counts")).alias("n_suppressed"))


def units(results: DataFrame) -> DataFrame:
    """One row for each session and dedup group: the deciding outcome (FAIL before PASS before UNKNOWN before NOT_APPLICABLE) and the rule that stands for it."""
    best = F.min(F.struct(rank(F.col("outcome"), OUTCOMES).alias("o"), rank(F.col("severity"), SEVERITIES).alias("s"), "rule_id", "outcome", "weight"))
    return results.groupBy("capture_id", "session_id", "dedup_group").agg(best.alias("x")).select("capture_id", "session_id", "dedup_group", "x.rule_id", "x.outcome", "x.weight")


def score(unit_rows: DataFrame, key: list[str], floor: float = 0.5) -> DataFrame:
    """Posture of each key from all its units: evaluated, failed and applicable weight, coverage, status, score, band.

    The score of a capture is this over all units of its sessions, never a mean of their scores.
    """
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    total = lambda *o: F.sum(F.when(F.col("outcome").isin(*o), w).otherwise(0.0))
    x = unit_rows.groupBy(*key).agg(total("FAIL", "PASS").alias("weighted_evaluated"), total("FAIL").alias("weighted_deductions"), total("FAIL", "PASS", "UNKNOWN").alias("weighted_applicable"))
    return _graded(x, floor)


def _graded(x: DataFrame, floor: float) -> DataFrame:
    """x (the three weights) with coverage, score, status, band."""
    raw = F.when(F.col("weighted_applicable") > 0, F.col("weighted_evaluated") / F.col("weighted_applicable"))
    scored = (F.col("weighted_evaluated") > 0) & (raw >= floor)
    value = F.bround(100 * (F.col("weighted_evaluated") - F.col("weighted_deductions")) / F.col("weighted_evaluated"), 0)
    x = x.withColumn("coverage", F.bround(raw, 4)).withColumn("score", F.when(scored, F.greatest(F.lit(0), F.least(F.lit(100), value)).cast("long")))
    return x.withColumn("status", F.when(F.col("score").isNull(), "SCORE_UNAVAILABLE").otherwise("SCORED")).withColumn("band", band(F.col("score")))


def band(score: Column) -> Column:
    return F.when(score >= 90, "STRONG").when(score >= 70, "ADEQUATE").when(score >= 40, "WEAK").when(score.isNotNull(), "CRITICAL")


def findings(results: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The counting failures with their ids, over the offsets and packets they rest on where results have them."""
    p = policy or Policy()
    held = {"offsets", "packets"} <= set(results.columns)
    joined = [F.array_join(F.col(c).cast("array<string>"), ",") if held else F.lit("") for c in ("offsets", "packets")]
    made = finding_id(F.lit(p.policy_id), F.lit(p.fingerprint()), F.col("rule_id"), F.col("capture_id"), F.col("session_id"), *joined)
    shown = ["finding_id", "capture_id", "session_id", "rule_id", "severity", "dedup_group", "confidence", "weight", *(["offsets", "packets"] if held else [])]
    return results.where("counts").withColumn("finding_id", made).select(*shown)


#: Leading characters of a finding id, with its prefix, by which the ranks of one group are dealt: 256 parts of each.
ID_PART = len("find-") + 2


def prioritised(found: DataFrame, criticality: Column | None = None) -> DataFrame:
    """findings with scope (findings of the rule), priority (P1 to P4) and a dense rank from 1 over all of them.

    The rank is a total order of the whole report, by severity, confidence, criticality, scope, rule and finding id. It is a count of all
    (..., leading characters of the id) before a row's own and a rank within those; the counts are one small table of bounded size, and
    no task holds all findings of a rule.
    """
    prio = F.lit(None).cast("string")
    for s, row in PRIORITIES.items():
        for c, p in zip(CONFIDENCES, row, strict=True):
            prio = F.when((F.col("severity") == s) & (F.col("confidence") == c), p).otherwise(prio)
    crit = criticality if criticality is not None else F.lit(None).cast("string")
    order = ["_s", "_k", "_c"]
    keyed = found.withColumns({"_s": rank(F.col("severity"), SEVERITIES), "_k": rank(F.col("confidence"), CONFIDENCES), "_c": rank(crit, SEVERITIES[:4]), "_part": F.left("finding_id", F.lit(ID_PART))})
    group = [*order, "rule_id", "_part"]
    counts = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("scope", F.sum("_n").over(Window.partitionBy("rule_id")))
    whole = Window.orderBy(*order, F.desc("scope"), "rule_id", "_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(whole), F.lit(0))).drop("_n")
    x = keyed.join(F.broadcast(counts), group).withColumn("priority", prio)
    return x.withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy(*group).orderBy("finding_id"))).drop(*order, "_part", "_before")


def remediations(found: DataFrame) -> DataFrame:
    """remediation_id, severity (the best of its findings), findings."""
    table = F.lit("")
    for r, _, _, ids in RULES:
        table = F.when(F.col("rule_id") == r, ids).otherwise(table)
    each = found.select("severity", F.explode(F.split(table, ",")).alias("remediation_id")).where("remediation_id <> ''")
    best = each.groupBy("remediation_id").agg(F.min(rank(F.col("severity"), SEVERITIES)).alias("_s"), F.count(F.lit(1)).alias("findings"))
    return best.select("remediation_id", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("_s") + 1).alias("severity"), "findings")
