"""Session profiles of captures, their vectors, and judgements against a stored baseline."""

import pytest

from mailstrata.__main__ import main
from mailstrata.operators import classifier, forest, learning, profiles
from mailstrata.sources import sessions, synth

C, S = ("10.0.0.1", 40000), ("192.0.2.1", 25)


def _profile(spark, tmp_path, frames):
    (tmp_path / "a.pcap").write_bytes(synth.pcap(frames))
    return profiles.profile(sessions.analyse_captures(spark, str(tmp_path / "a.pcap")))


def test_the_vector_has_93_places():
    assert len(profiles.PLACES) == len(profiles.SLOTS) == 93 == len(set(profiles.PLACES))


def test_a_captured_session_becomes_words_and_numbers(spark, tmp_path):
    rows = _profile(spark, tmp_path, synth.conversation(C, S, synth.smtp_starttls(0x0303, 0xC02F)))
    r = rows.withColumn("v", profiles.vector()).first()
    assert (r.tls_version, r.cipher_encryption, r.cipher_key_exchange, r.cipher_authentication, r.cipher_mac) == ("TLS 1.2", "AES_128_GCM", "ECDHE", "RSA", "SHA256")
    assert (r.entry_point, r.protocol_detection, r.eligibility) == ("STARTTLS", "CONFIRMED", "ELIGIBLE")
    assert r.cipher_is_aead and r.sni_present and r.offered_suite_count >= 1 and r.offered_version_count >= 1
    held = dict(zip(profiles.PLACES, r.v, strict=True))
    assert held["tls_version=TLS 1.2"] == held["cipher_mac=SHA256"] == held["sni_present"] == 1.0
    for feature, words in profiles.VOCABULARY.items():
        assert sum(held[f"{feature}={w}"] for w in words) == 1.0, feature
    assert held["offered_suite_count"] == r.offered_suite_count / 32 and held["offered_suite_count_missing"] == 0.0
    assert held["cert_key_bits_missing"] == float(r.cert_key_bits is None)


def test_without_tls_nothing_is_known(spark, tmp_path):
    rows = _profile(spark, tmp_path, synth.conversation(C, S, [("s", b"220 mail ready\r\n"), ("c", b"EHLO me\r\n"), ("s", b"250 mail\r\n"), ("c", b"QUIT\r\n"), ("s", b"221 bye\r\n")]))
    r = rows.withColumn("v", profiles.vector()).first()
    assert r.eligibility == "ML_NOT_EVALUABLE" and r.v is None and all(r[f] is None for f in [*profiles.VOCABULARY, *profiles.BOOLEANS, *profiles.SCALES])


def _facts(spark, rows):
    """Facts of (session, version, encryption, kex); all else is missing."""
    import mailstrata.plans.assessment as assessment

    kinds = spark.createDataFrame([(0, 0)], "o_orderkey long, o_custkey long").selectExpr(*[f"{e.format(text='string')} AS {n}" for n, e in assessment.FACTS.items()]).schema
    given = [{f.name: None for f in kinds.fields} | {"capture_id": "cap", "session_id": s, "has_tls": v is not None, "selected_version": v, "suite": v and 1, "encryption": e, "kex": k} for s, v, e, k in rows]
    for f in kinds.fields:
        f.nullable = True
    return spark.createDataFrame(given, kinds)


ROWS = [(f"a{i}", 0x0303, "AES_128_GCM", "ECDHE") for i in range(97)] + [("odd", 0x0301, "RC4_128", "RSA"), ("odd2", 0x0301, "RC4_128", "RSA"), ("new", 0x0304, "SOME_CIPHER", None), ("bare", None, None, None)]


def test_rare_combinations_are_anomalous(spark):
    rows = profiles.profile(_facts(spark, ROWS))
    baseline = profiles.fit(rows.where("session_id <> 'new'"), 0.021)
    assert baseline.total == 99 and baseline.combinations == {"TLS 1.2|AES_128_GCM|ECDHE": 97, "TLS 1.0|RC4_128|RSA": 2}
    got = {r["session_id"]: r for r in profiles.judged(rows, baseline).collect()}
    assert [got[s]["status"] for s in ("a0", "odd", "new", "bare")] == ["NOT_ANOMALOUS", "ANOMALOUS", "ANOMALOUS", "NOT_EVALUABLE"]
    assert got["odd"]["raw_score"] == 2 / 99 and got["new"]["raw_score"] == 0.0 and got["bare"]["raw_score"] is None and got["bare"]["explanations"] is None
    told = [(e["feature"], e["value"], e["reference_frequency"]) for e in got["new"]["explanations"]]
    want = [(0.0, "certificate_absence_reason", "NOT_AVAILABLE"), (0.0, "cipher_encryption", "OTHER"), (0.0, "cipher_key_exchange", "MISSING"), (0.0, "tls_version", "TLS 1.3"), (1.0, "cert_key_algorithm", "MISSING"), (1.0, "cert_signature_hash", "MISSING")]
    assert told == [(f, v, n) for n, f, v in want]
    counts = profiles.summary(profiles.judged(rows, baseline), ["capture_id"]).first()
    assert (counts.sessions, counts.evaluated, counts.anomalous, counts.not_evaluable, counts.without_model) == (101, 100, 3, 1, 0)


def test_no_baseline_and_an_empty_one(spark):
    rows = profiles.profile(_facts(spark, ROWS[-3:]))
    assert {r["status"] for r in profiles.judged(rows, None).collect()} == {"MODEL_UNAVAILABLE"}
    empty = profiles.fit(rows.where("false"), 0.02)
    got = {r["session_id"]: r for r in profiles.judged(rows, empty).collect()}
    assert empty.total == 0 and got["new"]["status"] == "ANOMALOUS" and got["bare"]["status"] == "NOT_EVALUABLE"
    assert [e["feature"] for e in got["new"]["explanations"]] == sorted(profiles.EXPLAINED)[:6] and {e["reference_frequency"] for e in got["new"]["explanations"]} == {None}
    assert profiles.profile(_facts(spark, ROWS[:1]).where("false")).count() == 0


def test_a_changed_baseline_is_rejected(spark, tmp_path):
    baseline = profiles.fit(profiles.profile(_facts(spark, ROWS)), 0.02)
    path = str(tmp_path / "rarity")
    profiles.save(spark, baseline, path)
    assert profiles.load(spark, path) == (baseline, "COMPLETED", None)
    assert profiles.load(spark, path, enabled=False)[:2] == (None, "DISABLED") and profiles.load(spark, None)[:2] == (None, "MODEL_UNAVAILABLE")
    part = next((tmp_path / "rarity" / "model").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert profiles.load(spark, path) == (None, "MODEL_REJECTED", "a file was changed, added or lost")


def test_models_take_the_places_of_a_vector(spark):
    facts = _facts(spark, ROWS[:-1])
    rows = profiles.expanded(profiles.profile(facts)).fillna(0.0, profiles.SLOTS)
    grown = forest.fit(rows, ["session_id"], profiles.SLOTS, seed=5, trees=50, sample=64)
    scores = {r["session_id"]: r["s"] for r in rows.select("session_id", forest.score(grown).alias("s")).collect()}
    assert min(scores["odd"], scores["new"]) > max(s for n, s in scores.items() if n.startswith("a"))
    labelled = learning.split(rows.withColumn("label", learning.F.when(learning.F.col("tls_version") == "TLS 1.2", "LOW").otherwise("HIGH")), "session_id", "p")
    best, figures = classifier.choose(labelled, profiles.SLOTS, "label")
    assert len(figures) == 3 and classifier.predict(labelled, best).count() == 100
    counts = profiles.label_counts(labelled, "label", ["HIGH", "LOW", "CRITICAL"], "part", ["TRAIN", "TEST"])
    want = {(r["label"], r["part"]): r["count"] for r in labelled.groupBy("label", "part").count().collect()}
    assert {(r["label"], r["part"]): r["n"] for r in counts.collect()} == {(x, y): want.get((x, y), 0) for x in ("HIGH", "LOW", "CRITICAL") for y in ("TRAIN", "TEST")}


def test_learn_and_analyze_by_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.pcap").write_bytes(synth.mail_capture(6))
    out, model = str(tmp_path / "out"), str(tmp_path / "model")
    assert main(["analyze", str(tmp_path / "a.pcap"), out]) == 0
    assert "model: MODEL_UNAVAILABLE" in capsys.readouterr().err
    assert main(["learn", out, model, "--threshold", "0.5"]) == 0
    assert main(["analyze", str(tmp_path / "a.pcap"), out, "--model", model]) == 0
    assert "model: COMPLETED" in capsys.readouterr().err
    got = spark.read.parquet(f"{out}/profiles")
    assert got.where("status IN ('ANOMALOUS', 'NOT_ANOMALOUS')").count() == got.where("eligibility = 'ELIGIBLE'").count() > 0


@pytest.mark.parametrize("threshold", [0.0, 1.0])
def test_thresholds_at_the_ends(spark, threshold):
    rows = profiles.profile(_facts(spark, ROWS[:-1]))
    got = profiles.judged(rows, profiles.fit(rows, threshold))
    assert got.where("status = 'ANOMALOUS'").count() == (100 if threshold else 0)
