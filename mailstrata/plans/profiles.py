"""Session profiles, their vectors, and judgements against a reference population, over facts derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning, profiles
from ..operators.inventory import VERSION_NAMES
from ..sources.tls import MACS
from .assessment import FACTS_SQL, facts
from .registry import query

_LEAF = "(cert_visibility = 'OBSERVED')"
#: The reference population, and the share up to which a combination is rare.
REFERENCE, RARE = "capture_id < 'cap-15'", 0.03
_SUITES = " ".join(f"WHEN suite IN ({', '.join(map(str, codes))}) THEN '{name}'" for name, codes in MACS.items())


def _names(code: str, names: dict[int, str]) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items())
    return f"CASE WHEN {code} IS NOT NULL THEN CASE {code} {cases} ELSE 'OTHER' END END"


WORDS = {
    "tls_version": _names("selected_version", VERSION_NAMES),
    "cipher_encryption": "encryption",
    "cipher_key_exchange": "kex",
    "cipher_authentication": "authentication",
    "cipher_mac": f"CASE WHEN suite_known THEN CASE {_SUITES} ELSE 'SHA1' END END",
    "key_exchange_group": _names("tls_group", profiles.GROUP_NAMES),
    "cert_key_algorithm": f"CASE WHEN {_LEAF} THEN key_algorithm END",
    "cert_signature_hash": f"CASE WHEN {_LEAF} THEN lower(signature_hash) END",
    "entry_point": "CASE WHEN implicit_tls THEN 'IMPLICIT' ELSE 'STARTTLS' END",
    "handshake_state": "handshake_state",
    "protocol_detection": "CASE WHEN detection = 'NOT_IDENTIFIED' THEN 'UNKNOWN' ELSE detection END",
}
OTHERS = {
    "certificate_absence_reason": f"CASE WHEN {_LEAF} THEN 'OBSERVED' WHEN selected_version = 772 THEN 'NOT_AVAILABLE' ELSE 'UNKNOWN' END",
    "group_absence_reason": "CASE WHEN tls_group IS NOT NULL THEN 'OBSERVED' WHEN selected_version < 772 AND kex = 'RSA' THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END",
    "cipher_is_aead": "coalesce(regexp_matches(encryption, '_(GCM|CCM|POLY1305)'), false)",
    "forward_secrecy_observed": "fs_status IN ('EPHEMERAL_OBSERVED', 'CAPABLE')",
    "certificate_observed": _LEAF,
    "client_offered_tls13": "offered_tls13",
    "sni_present": "coalesce(sni <> '', false)",
    "cert_key_bits": f"CASE WHEN {_LEAF} THEN key_bits::DOUBLE END",
    "cert_lifetime_days": f"CASE WHEN {_LEAF} THEN floor((not_after_us - not_before_us) / 86400000000.0)::DOUBLE END",
    "offered_suite_count": "CASE WHEN offered_suites > 0 THEN offered_suites::DOUBLE END",
    "offered_version_count": "CASE WHEN offered_versions > 0 THEN offered_versions::DOUBLE END",
    "evidence_completeness": f"((selected_version IS NOT NULL)::INT + (suite IS NOT NULL)::INT + (tls_group IS NOT NULL)::INT + {_LEAF}::INT) / 4.0::DOUBLE",
}


def _word(value: str, feature: str) -> str:
    known = ", ".join(f"'{w}'" for w in profiles.VOCABULARY[feature])
    return f"CASE WHEN {value} IS NULL THEN 'MISSING' WHEN {value} IN ({known}) THEN {value} ELSE 'OTHER' END"


_ALL = {n: _word(f"({e})", n) for n, e in WORDS.items()} | OTHERS
_ELIGIBLE = "CASE WHEN has_tls AND selected_version IS NOT NULL AND suite IS NOT NULL THEN 'ELIGIBLE' ELSE 'ML_NOT_EVALUABLE' END AS eligibility"
PROFILES_SQL = f"{FACTS_SQL}, profiles AS (SELECT capture_id, session_id, {', '.join(f'CASE WHEN has_tls THEN {e} END AS {n}' for n, e in _ALL.items())}, {_ELIGIBLE} FROM facts)"


@query(f"WITH {PROFILES_SQL} SELECT * FROM profiles")
def session_profiles(t):
    return profiles.profile(facts(t))


def _places() -> str:
    """The places of the ones among the words and booleans of a vector."""
    out, before = [], 0
    for f, words in profiles.VOCABULARY.items():
        out.append(f"{before} + list_position([{', '.join(repr(w) for w in words)}], {f})")
        before += len(words)
    out += [f"CASE WHEN {b} THEN {before + i} END" for i, b in enumerate(profiles.BOOLEANS, 1)]
    return f"concat_ws(',', {', '.join(out)})"


_NUMBERS = ", ".join(f"coalesce(least({n} / {s}::DOUBLE, 2.0), 0.0)::DOUBLE AS {n}, CAST({n} IS NULL AS INT) AS {n}_missing" for n, s in profiles.SCALES.items())


@query(f"WITH {PROFILES_SQL} SELECT session_id, {_places()} AS ones, {_NUMBERS} FROM profiles WHERE tls_version IS NOT NULL")
def profile_vectors(t):
    held = profiles.profile(facts(t)).where("tls_version IS NOT NULL").select("session_id", profiles.vector().alias("v"))
    words = len(profiles.PLACES) - 2 * len(profiles.SCALES)
    at = F.transform(F.slice("v", 1, words), lambda x, i: F.when(x == 1.0, (i + 1).cast("string")))
    numbers = [F.element_at("v", i).cast("int" if n.endswith("_missing") else "double").alias(n) for i, n in enumerate(profiles.PLACES[words:], words + 1)]
    return held.select("session_id", F.array_join(F.filter(at, lambda x: x.isNotNull()), ",").alias("ones"), *numbers)


_COMBINATION = "concat_ws('|', tls_version, cipher_encryption, cipher_key_exchange)"
_JUDGED_SQL = f"""{PROFILES_SQL}, ref AS (SELECT *, {_COMBINATION} AS c FROM profiles WHERE eligibility = 'ELIGIBLE' AND {REFERENCE}), total AS (SELECT count(*) AS t FROM ref),
seen AS (SELECT c, count(*) AS n FROM ref GROUP BY c), shares AS (SELECT p.*, coalesce(n / t, 0.0)::DOUBLE AS share FROM profiles p CROSS JOIN total LEFT JOIN seen ON c = {_COMBINATION}),
judged AS (SELECT capture_id, session_id, CASE WHEN eligibility <> 'ELIGIBLE' THEN 'NOT_EVALUABLE' WHEN share <= {RARE} THEN 'ANOMALOUS' ELSE 'NOT_ANOMALOUS' END AS status,
  CASE WHEN eligibility = 'ELIGIBLE' THEN share END AS raw_score, CASE WHEN eligibility = 'ELIGIBLE' THEN {RARE}::DOUBLE END AS threshold FROM shares)"""


def _judged(t):
    held = profiles.profile(facts(t))
    return profiles.judged(held, profiles.fit(held.where(REFERENCE), RARE))


@query(f"WITH {_JUDGED_SQL} SELECT * FROM judged")
def anomaly_verdicts(t):
    return _judged(t).select("capture_id", "session_id", "status", "raw_score", "threshold")


@query(f"""WITH {_JUDGED_SQL}, cells AS (UNPIVOT (SELECT session_id, {", ".join(profiles.EXPLAINED)} FROM profiles WHERE eligibility = 'ELIGIBLE') ON {", ".join(profiles.EXPLAINED)} INTO NAME feature VALUE value),
known AS (UNPIVOT (SELECT {", ".join(profiles.EXPLAINED)} FROM ref) ON {", ".join(profiles.EXPLAINED)} INTO NAME feature VALUE value),
often AS (SELECT feature, value, count(*) / (SELECT t FROM total) AS f FROM known GROUP BY ALL)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY coalesce(f, 0.0), feature) AS INT) AS rank, feature, value, coalesce(f, 0.0)::DOUBLE AS reference_frequency
FROM cells LEFT JOIN often USING (feature, value) QUALIFY rank <= {profiles.EXPLANATIONS}""")
def anomaly_explanations(t):
    told = _judged(t).select("session_id", F.posexplode("explanations").alias("i", "e"))
    return told.select("session_id", (F.col("i") + 1).alias("rank"), "e.*")


@query(f"""WITH {_JUDGED_SQL} SELECT capture_id, count(*) AS sessions, count(*) FILTER (status <> 'NOT_EVALUABLE') AS evaluated, count(*) FILTER (status = 'ANOMALOUS') AS anomalous,
  count(*) FILTER (status = 'NOT_EVALUABLE') AS not_evaluable, CAST(0 AS BIGINT) AS without_model FROM judged GROUP BY capture_id""")
def anomaly_summary(t):
    return profiles.summary(_judged(t), ["capture_id"])


LABELS, PARTS = ["CRITICAL", "HIGH", "MODERATE", "LOW"], ["TRAIN", "VALIDATION", "TEST"]
_LABEL = """CASE WHEN encryption IN ('NULL', 'RC4_40', 'DES40_CBC') OR kex = 'ANONYMOUS' THEN 'CRITICAL' WHEN selected_version < 771 OR encryption IN ('RC4_128', 'DES_CBC') OR key_bits < 2048 THEN 'HIGH'
WHEN kex = 'RSA' OR encryption = '3DES_EDE_CBC' THEN 'MODERATE' ELSE 'LOW' END"""
_PART = "CAST('0x' || substr(md5('profiles|' || capture_id), 1, 8) AS BIGINT) / 4294967296"


@query(f"""WITH {FACTS_SQL}, s AS (SELECT {_LABEL} AS label, CASE WHEN {_PART} < 0.6 THEN 'TRAIN' WHEN {_PART} < 0.8 THEN 'VALIDATION' ELSE 'TEST' END AS part FROM facts WHERE has_tls AND selected_version IS NOT NULL AND suite IS NOT NULL),
every AS (SELECT * FROM unnest({LABELS}) a(label) CROSS JOIN unnest({PARTS}) b(part))
SELECT label, part, count(s.label) AS n FROM every LEFT JOIN s USING (label, part) GROUP BY label, part""")
def label_counts(t):
    """The classes of a data set in which a capture lies in one part, 0 where a part has none of a class."""
    rows = facts(t).where("has_tls AND selected_version IS NOT NULL AND suite IS NOT NULL")
    label = learning.rubric(F.col("selected_version"), F.col("encryption"), F.col("kex"), F.col("key_bits"))
    return profiles.label_counts(learning.split(rows.withColumn("label", label), "capture_id", "profiles"), "label", LABELS, "part", PARTS)
