"""Session profiles: the features of a session in fixed vocabularies, their vector, and what a reference population says of them.

A profile is a projection of the session's facts, so it needs no shuffle. The vocabularies never depend on the data, so the
counts of a population are bounded by them (420 combinations, 50 values): they are held as a literal map, and sessions are
judged where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tls import MACS
from . import registry
from .inventory import VERSION_NAMES

# The words of every categorical feature in the order of the vector.
REASONS = ["OBSERVED", "UNKNOWN", "NOT_AVAILABLE", "NOT_APPLICABLE"]
VOCABULARY = {
    "tls_version": ["TLS 1.0", "TLS 1.1", "TLS 1.2", "TLS 1.3", "OTHER", "MISSING"],
    "cipher_encryption": ["AES_128_GCM", "AES_256_GCM", "CHACHA20_POLY1305", "AES_128_CBC", "AES_256_CBC", "3DES_EDE_CBC", "RC4_128", "NULL", "OTHER", "MISSING"],
    "cipher_key_exchange": ["ECDHE", "DHE", "RSA", "PSK", "ECDH", "OTHER", "MISSING"],
    "cipher_authentication": ["ECDSA", "RSA", "PSK", "ANON", "OTHER", "MISSING"],
    "cipher_mac": ["SHA1", "SHA256", "SHA384", "OTHER", "MISSING"],
    "key_exchange_group": ["x25519", "secp256r1", "secp384r1", "ffdhe2048", "OTHER", "MISSING"],
    "cert_key_algorithm": ["RSA", "EC", "Ed25519", "Ed448", "DSA", "OTHER", "MISSING"],
    "cert_signature_hash": ["sha256", "sha384", "sha512", "sha1", "OTHER", "MISSING"],
    "entry_point": ["IMPLICIT", "STARTTLS", "UNKNOWN", "OTHER", "MISSING"],
    "handshake_state": ["SERVER_FLIGHT_COMPLETE", "SERVER_HELLO_SEEN", "CLIENT_HELLO_ONLY", "NONE_OBSERVED", "OTHER", "MISSING"],
    "protocol_detection": ["CONFIRMED", "PROBABLE", "PORT_HINT", "UNKNOWN", "OTHER", "MISSING"],
    "certificate_absence_reason": REASONS,
    "group_absence_reason": REASONS,
}
BOOLEANS = ["cipher_is_aead", "forward_secrecy_observed", "certificate_observed", "client_offered_tls13", "sni_present"]
# What a number is divided by in the vector; a quotient ends at 2.
SCALES = {"cert_key_bits": 4096.0, "cert_lifetime_days": 3650.0, "offered_suite_count": 32.0, "offered_version_count": 4.0, "evidence_completeness": 1.0}
# Names of groups by their code.
GROUP_NAMES = {0x0017: "secp256r1", 0x0018: "secp384r1", 0x001D: "x25519", 0x0100: "ffdhe2048"}
# The features whose combination is judged, those that are explained, and how many of these are told.
JUDGED = ["tls_version", "cipher_encryption", "cipher_key_exchange"]
EXPLAINED = [*JUDGED, "cert_key_algorithm", "cert_signature_hash", "key_exchange_group", "certificate_absence_reason"]
EXPLANATIONS = 6
#: What each place of the vector stands for, and the name of its column in expanded().
PLACES = [f"{f}={w}" for f, words in VOCABULARY.items() for w in words] + BOOLEANS + [n for f in SCALES for n in (f, f"{f}_missing")]
SLOTS = [f"v{i:02d}" for i in range(1, len(PLACES) + 1)]


def _word(value: Column, feature: str) -> Column:
    """The value if its feature's vocabulary has it, OTHER if not, MISSING for null."""
    return F.when(value.isNull(), "MISSING").when(value.isin(VOCABULARY[feature]), value).otherwise("OTHER")


def _looked_up(code: Column, names: dict[int, str]) -> Column:
    """The name of a code, OTHER for a code without one, null for null."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.element_at(table, code.cast("int")), F.lit("OTHER")))


def profile(facts: DataFrame) -> DataFrame:
    """capture_id, session_id, every feature of VOCABULARY, BOOLEANS and SCALES, and eligibility of every session of facts.

    What a capture can never show (a TLS 1.3 certificate) is NOT_AVAILABLE, what doesn't apply (a group under an RSA exchange) NOT_APPLICABLE, what it might have
    shown UNKNOWN. A session without TLS can't be evaluated and has null in every feature; one without a version or a suite can't be evaluated either.
    """
    c = F.col
    tls, version, leaf = F.coalesce(c("has_tls"), F.lit(False)), c("selected_version"), F.coalesce(c("cert_visibility") == "OBSERVED", F.lit(False))
    of_leaf = lambda x: F.when(leaf, x)
    yes = lambda x: F.coalesce(x, F.lit(False))
    mac = F.when(c("suite_known"), F.coalesce(*[F.when(c("suite").isin(suites), name) for name, suites in MACS.items()], F.lit("SHA1")))
    observed = sum((x.cast("int") for x in (version.isNotNull(), c("suite").isNotNull(), c("tls_group").isNotNull(), leaf)), F.lit(0))
    words = {
        "tls_version": _looked_up(version, VERSION_NAMES),
        "cipher_encryption": c("encryption"),
        "cipher_key_exchange": c("kex"),
        "cipher_authentication": c("authentication"),
        "cipher_mac": mac,
        "key_exchange_group": _looked_up(c("tls_group"), GROUP_NAMES),
        "cert_key_algorithm": of_leaf(c("key_algorithm")),
        "cert_signature_hash": of_leaf(F.lower("signature_hash")),
        "entry_point": F.when(yes(c("implicit_tls")), "IMPLICIT").otherwise("STARTTLS"),
        "handshake_state": c("handshake_state"),
        "protocol_detection": F.when(c("detection") == "NOT_IDENTIFIED", "UNKNOWN").otherwise(c("detection")),
    }
    reasons = {
        "certificate_absence_reason": F.when(leaf, "OBSERVED").when(version == 0x0304, "NOT_AVAILABLE").otherwise("UNKNOWN"),
        "group_absence_reason": F.when(c("tls_group").isNotNull(), "OBSERVED").when((version < 0x0304) & (c("kex") == "RSA"), "NOT_APPLICABLE").otherwise("UNKNOWN"),
    }
    truths = {
        "cipher_is_aead": yes(c("encryption").rlike("_(GCM|CCM|POLY1305)")),
        "forward_secrecy_observed": yes(c("fs_status").isin("EPHEMERAL_OBSERVED", "CAPABLE")),
        "certificate_observed": leaf,
        "client_offered_tls13": yes(c("offered_tls13")),
        "sni_present": yes(c("sni") != ""),
    }
    counted = lambda n: F.when(c(n) > 0, c(n).cast("double"))
    numbers = {
        "cert_key_bits": of_leaf(c("key_bits").cast("double")),
        "cert_lifetime_days": of_leaf(F.floor((c("not_after_us") - c("not_before_us")) / 86_400_000_000).cast("double")),
        "offered_suite_count": counted("offered_suites"),
        "offered_version_count": counted("offered_versions"),
        "evidence_completeness": observed / 4.0,
    }
    made = {n: _word(x, n) for n, x in words.items()} | reasons | truths | numbers
    eligible = F.when(tls & version.isNotNull() & c("suite").isNotNull(), "ELIGIBLE").otherwise("ML_NOT_EVALUABLE")
    return facts.select("capture_id", "session_id", *[F.when(tls, x).alias(n) for n, x in made.items()], eligible.alias("eligibility"))


def vector() -> Column:
    """The vector of a profile, a place for each of PLACES: one for the word of a feature, zero for the others; numbers scaled, each with whether it is missing. Null without TLS."""
    hot = [F.transform(F.array(*map(F.lit, words)), lambda w: (w == F.col(f)).cast("double")) for f, words in VOCABULARY.items()]  # noqa: B023
    truths = F.array(*[F.col(b).cast("double") for b in BOOLEANS])
    numbers = [F.array(F.coalesce(F.least(F.col(n) / s, F.lit(2.0)), F.lit(0.0)), F.col(n).isNull().cast("double")) for n, s in SCALES.items()]
    return F.when(F.col("tls_version").isNotNull(), F.concat(*hot, truths, *numbers))


def expanded(profiles: DataFrame) -> DataFrame:
    """profiles with a column of SLOTS for each place of the vector, as forests and classifiers take them."""
    held = profiles.withColumn("_vector", vector())
    return held.select("*", *[F.element_at("_vector", i).alias(n) for i, n in enumerate(SLOTS, 1)]).drop("_vector")


@dataclass(frozen=True)
class Baseline:
    """Counts of a reference population: sessions, those of each combination of JUDGED, those of each value of EXPLAINED (as feature=value), and the share up to which a combination is rare."""

    total: int
    combinations: dict[str, int]
    values: dict[str, int]
    threshold: float


def _combination() -> Column:
    return F.concat_ws("|", *JUDGED)


def fit(reference: DataFrame, threshold: float) -> Baseline:
    """The baseline of all profiles of reference that can be evaluated, counted in one pass; no more counts than the vocabularies allow reach the driver."""
    rows = reference.where(F.col("eligibility") == "ELIGIBLE")
    entries = F.array(F.struct(F.lit("").alias("kind"), _combination().alias("key")), *[F.struct(F.lit(f).alias("kind"), F.col(f).alias("key")) for f in EXPLAINED])
    counts = rows.select(F.explode(entries).alias("e")).groupBy("e.kind", "e.key").count().collect()
    combinations = {r["key"]: r["count"] for r in counts if not r["kind"]}
    return Baseline(sum(combinations.values()), combinations, {f"{r['kind']}={r['key']}": r["count"] for r in counts if r["kind"]}, threshold)


def _share(key: Column, counts: dict[str, int], total: int) -> Column:
    if not counts:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, n / total)])
    return F.coalesce(F.element_at(table, key), F.lit(0.0))


def judged(profiles: DataFrame, baseline: Baseline | None) -> DataFrame:
    """profiles with status, raw_score (the combination's share of the population), threshold and explanations.

    Without a baseline all are MODEL_UNAVAILABLE; a session that can't be evaluated is NOT_EVALUABLE, since a capture's limits aren't its server's. An empty population
    holds no combination, so every share is 0, and it knows no frequency. Explanations are the EXPLANATIONS rarest values, ties by feature; where no frequency is known it is null and comes last.
    """
    share = F.lit(None).cast("double") if baseline is None else _share(_combination(), baseline.combinations, baseline.total)
    threshold = F.lit(None if baseline is None else baseline.threshold).cast("double")
    eligible = F.col("eligibility") == "ELIGIBLE"
    known = baseline is not None and baseline.total > 0

    def told(feature: str) -> Column:
        frequency = _share(F.concat(F.lit(f"{feature}="), F.col(feature)), baseline.values, baseline.total) if known else F.lit(None).cast("double")
        return F.struct(F.coalesce(frequency, F.lit(1.0)).alias("by"), F.lit(feature).alias("feature"), F.col(feature).alias("value"), frequency.alias("reference_frequency"))

    rarest = F.slice(F.array_sort(F.array(*map(told, EXPLAINED))), 1, EXPLANATIONS)
    if baseline is None:
        status = F.lit("MODEL_UNAVAILABLE")
    else:
        status = F.when(~eligible, "NOT_EVALUABLE").when(share <= threshold, "ANOMALOUS").otherwise("NOT_ANOMALOUS")
    evaluated = eligible & F.lit(baseline is not None)
    return profiles.withColumns({
        "status": status, "raw_score": F.when(evaluated, share), "threshold": F.when(evaluated, threshold),
        "explanations": F.when(evaluated, F.transform(rarest, lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["reference_frequency"].alias("reference_frequency")))),
    })


def summary(judgements: DataFrame, key: list[str]) -> DataFrame:
    """For each key the sessions, those that were evaluated, are anomalous or can't be evaluated, and whether any was without a model."""
    of = lambda *kinds: F.count_if(F.col("status").isin(*kinds))
    counts = {"sessions": F.count(F.lit(1)), "evaluated": of("ANOMALOUS", "NOT_ANOMALOUS"), "anomalous": of("ANOMALOUS"), "not_evaluable": of("NOT_EVALUABLE"), "without_model": of("MODEL_UNAVAILABLE")}
    return judgements.groupBy(*key).agg(*[c.alias(n) for n, c in counts.items()])


def label_counts(rows: DataFrame, label: str, labels: list[str], part: str, parts: list[str]) -> DataFrame:
    """label, part, n for every label of every part, 0 where there is none; rows of other labels or parts aren't counted."""
    cells = rows.where(F.col(label).isin(labels) & F.col(part).isin(parts)).groupBy(F.col(label).alias("_l"), F.col(part).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    every = rows.sparkSession.createDataFrame([(x, y) for x in labels for y in parts], "label string, part string")
    return every.join(cells, (F.col("label") == F.col("_l")) & (F.col("part") == F.col("_p")), "left").select("label", "part", F.coalesce("_n", F.lit(0)).alias("n"))


def save(spark: SparkSession, baseline: Baseline, path: str) -> dict:
    """Store a baseline; see registry."""
    rows = [("combination", k, n) for k, n in sorted(baseline.combinations.items())] + [("value", k, n) for k, n in sorted(baseline.values.items())]
    return registry.save(spark.createDataFrame(rows, "kind string, key string, n long"), spark, path, "rarity", PLACES, threshold=baseline.threshold)


def load(spark: SparkSession, path: str | None, enabled: bool = True) -> tuple[Baseline | None, str, str | None]:
    """(baseline, status, reason): the baseline only where the status is COMPLETED, so an analysis goes on without its model."""
    status, reason = registry.status(spark, path, "rarity", PLACES, enabled)
    if status != "COMPLETED":
        return None, status, reason
    threshold = registry.manifest(spark, path, "rarity", PLACES)["threshold"]
    counts: dict[str, dict[str, int]] = {"combination": {}, "value": {}}
    for r in spark.read.parquet(f"{path}/model").collect():  # as bounded as the vocabularies
        counts[r["kind"]][r["key"]] = r["n"]
    return Baseline(sum(counts["combination"].values()), counts["combination"], counts["value"], threshold), status, None
