"""Inventories, events, features and checks over session facts: every one a projection, a group or a join on keys."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import correlation_id, event_id

# The pattern that a repeated failure of a rule stands for, and the versions' names.
PATTERNS = {
    "TLS-PROTO-001": "REPEATED_OBSOLETE_TLS",
    "TLS-CIPHER-003": "REPEATED_WEAK_CIPHER",
    "TLS-CIPHER-001": "REPEATED_WEAK_CIPHER",
    "MAIL-001": "AUTHENTICATION_EXPOSURE",
    "MAIL-002": "AUTHENTICATION_EXPOSURE",
}
VERSION_NAMES = {0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
OFFERED = ("UPGRADE_ACCEPTED", "TLS_BYTES_OBSERVED")


def _count(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def protocol_inventory(facts: DataFrame, key: list[str]) -> DataFrame:
    """Counts of detections, upgrades and authentications for each key; tls_handshakes_analysed is always 0, since protocols are counted before TLS is looked at."""
    state, detection = F.col("upgrade_state"), F.col("detection")
    counts = {f"confirmed_{p.lower()}_count": _count((detection == "CONFIRMED") & (F.col("protocol") == p)) for p in ("SMTP", "IMAP", "POP3")}
    counts |= {
        "analysed_session_count": F.count(F.lit(1)),
        "probable_count": _count(detection == "PROBABLE"),
        "port_hint_only_count": _count(detection == "PORT_HINT"),
        "unknown_count": _count(detection == "NOT_IDENTIFIED"),
        "upgrade_advertised_count": _count(F.col("upgrade_advertised")),
        "upgrade_requested_count": _count(F.col("upgrade_requested")),
        "upgrade_accepted_count": _count(state.isin(*OFFERED)),
        "upgrade_rejected_count": _count(state == "UPGRADE_REJECTED"),
        "upgrade_incomplete_count": _count(state.isin("INCOMPLETE", "UPGRADE_REQUESTED")),
        "tls_bytes_observed_count": _count(state == "TLS_BYTES_OBSERVED"),
        "implicit_tls_session_count": _count(F.col("implicit_tls")),
        "authentication_observation_count": F.coalesce(F.sum("auth_count"), F.lit(0)).cast("long"),
        "authentication_before_upgrade_count": F.coalesce(F.sum("auth_before_upgrade"), F.lit(0)).cast("long"),
        "tls_handshakes_analysed": F.lit(0).cast("long"),
    }
    return facts.groupBy(*key).agg(*[c.alias(n) for n, c in counts.items()])


def tls_inventory(facts: DataFrame, key: list[str]) -> DataFrame:
    """Counts over the sessions with TLS for each key; nothing is verified cryptographically and no revocation is checked, so these two are 0."""
    version, state = F.col("selected_version"), F.coalesce("handshake_state", F.lit("NOT_OBSERVED"))
    counts = {
        "tls_session_count": F.count(F.lit(1)),
        "implicit_tls_count": _count(F.col("implicit_tls")),
        "starttls_upgrade_count": _count(~F.coalesce("implicit_tls", F.lit(False))),
        "negotiated_count": _count(~state.isin("NOT_OBSERVED", "CLIENT_HELLO_ONLY", "INDETERMINATE")),
        "tls13_count": _count(version == 0x0304),
        "tls12_count": _count(version == 0x0303),
        "legacy_version_count": _count(version.between(0x0300, 0x0302)),
        "certificates_observed_count": _count(F.col("cert_visibility") == "OBSERVED"),
        "certificates_encrypted_count": _count(F.col("cert_visibility") == "ENCRYPTED_TLS13"),
        "chain_verified_count": _count(F.col("chain_status") == "PASSED"),
        "hostname_verified_count": _count(F.col("hostname_status") == "PASSED"),
        "forward_secret_count": _count(F.col("fs_status").isin("EPHEMERAL_OBSERVED", "CAPABLE")),
        "static_rsa_count": _count(F.col("fs_status") == "STATIC_RSA"),
        "alert_count": _count(F.col("fatal_alert")),
        "handshakes_cryptographically_verified": F.lit(0).cast("long"),
        "revocation_checks_performed": F.lit(0).cast("long"),
    }
    return facts.where("has_tls").groupBy(*key).agg(*[c.alias(n) for n, c in counts.items()])


def session_events(facts: DataFrame, at: str) -> DataFrame:
    """capture_id, session_id, kind, at, anchor, event_id: the observable events of every session, picked from an array of candidates on its row.

    An upgrade's reply is one event, UPGRADE_ACCEPTED or UPGRADE_REJECTED by what followed.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit(False))
    tls, text = some("has_tls"), lambda c: F.col(c).cast("string")
    answered = F.coalesce(F.col("upgrade_state").isin(*OFFERED, "UPGRADE_REJECTED"), F.lit(False))
    accepted = F.col("upgrade_state").isin(*OFFERED)
    candidates = [
        (F.lit(True), F.lit("SESSION_FIRST_PACKET"), F.lit("first-packet")),
        (F.coalesce(F.col("detection").isin("CONFIRMED", "PROBABLE"), F.lit(False)), F.lit("PROTOCOL_IDENTIFIED"), F.concat(F.lit("detect:"), F.coalesce(text("protocol"), F.lit("UNKNOWN")), F.lit(":"), text("detection"))),
        (some("upgrade_advertised"), F.lit("UPGRADE_ADVERTISED"), F.lit("upgrade-advertised")),
        (some("upgrade_requested"), F.lit("UPGRADE_REQUESTED"), F.lit("upgrade-requested")),
        (answered, F.when(accepted, "UPGRADE_ACCEPTED").otherwise("UPGRADE_REJECTED"), F.concat(F.lit("upgrade-response:"), text("upgrade_state"))),
        (F.coalesce(F.col("auth_count") > 0, F.lit(False)), F.lit("AUTHENTICATION_OBSERVED"), F.concat(F.lit("auth:"), text("auth_count"))),
        (tls & some("client_hello"), F.lit("CLIENT_HELLO"), F.lit("msg:client_hello")),
        (tls & F.col("selected_version").isNotNull(), F.lit("SERVER_HELLO"), F.lit("msg:server_hello")),
        (tls & F.coalesce(F.col("cert_visibility") == "OBSERVED", F.lit(False)), F.lit("CERTIFICATE_OBSERVED"), F.lit("msg:certificate")),
        (tls & F.col("selected_version").isNotNull() & F.col("suite").isNotNull(), F.lit("CRYPTO_PARAMETERS_SELECTED"), F.concat(F.lit("negotiated:"), text("selected_version"), F.lit(":"), text("suite"))),
        (tls & some("fatal_alert"), F.lit("TLS_ALERT"), F.lit("alert")),
    ]
    entries = F.array(*[F.struct(test.alias("there"), kind.alias("kind"), anchor.alias("anchor")) for test, kind, anchor in candidates])
    rows = facts.select("capture_id", "session_id", F.col(at).alias("at"), F.explode(F.filter(entries, lambda e: e["there"])).alias("e"))
    rows = rows.select("capture_id", "session_id", "at", "e.kind", "e.anchor")
    return rows.withColumn("event_id", event_id(F.col("capture_id"), F.col("session_id"), F.col("kind"), F.col("anchor")))


def finding_events(found: DataFrame, times: DataFrame, at: str) -> DataFrame:
    """SECURITY_FINDING events of findings, dated by their session's row of times (capture_id, session_id, at)."""
    dated = found.join(times.select("capture_id", "session_id", F.col(at).alias("at")), ["capture_id", "session_id"])
    rows = dated.select("capture_id", "session_id", "at", F.lit("SECURITY_FINDING").alias("kind"), F.concat(F.lit("finding:"), "finding_id").alias("anchor"))
    return rows.withColumn("event_id", event_id(F.col("capture_id"), F.col("session_id"), F.col("kind"), F.col("anchor")))


def drift_events(drift: DataFrame) -> DataFrame:
    """CONFIGURATION_DRIFT events, of observed changes only: drift with capture_id, session_id and at of the later session, in the columns of session_events."""
    rows = drift.where("status = 'OBSERVED_CHANGE'").select("capture_id", "session_id", "at", F.lit("CONFIGURATION_DRIFT").alias("kind"), F.concat(F.lit("drift:"), "drift_id").alias("anchor"))
    return rows.withColumn("event_id", event_id(F.col("capture_id"), F.col("session_id"), F.col("kind"), F.col("anchor")))


def patterns(found: DataFrame) -> DataFrame:
    """Pattern correlations: kind, basis (the rule), sessions and captures for every rule with a pattern that fails in two sessions or more."""
    kind = reduce(lambda out, x: F.when(F.col("rule_id") == x[0], x[1]).otherwise(out), PATTERNS.items(), F.lit(None).cast("string"))
    rows = found.where(F.col("rule_id").isin(*PATTERNS)).groupBy("rule_id").agg(F.count_distinct("capture_id", "session_id").alias("sessions"), F.count_distinct("capture_id").alias("captures"))
    return rows.where("sessions >= 2").select(kind.alias("kind"), F.col("rule_id").alias("basis"), "sessions", "captures")


def pattern_members(found: DataFrame) -> DataFrame:
    """kind, basis (the rule), session_id, capture_id: a member of a group for every finding of a rule with a pattern."""
    kind = reduce(lambda out, x: F.when(F.col("rule_id") == x[0], x[1]).otherwise(out), PATTERNS.items(), F.lit(None).cast("string"))
    return found.where(F.col("rule_id").isin(*PATTERNS)).select(kind.alias("kind"), F.col("rule_id").alias("basis"), "session_id", "capture_id")


def shared_material(facts: DataFrame, columns: dict[str, str], capture: str, session: str) -> DataFrame:
    """kind, basis, session_id, capture_id: a member of a group for every value of columns (kind: column); an array of values, such as a whole chain, has one for each."""

    def entries_of(kind: str, column: str) -> Column:
        each = F.col(column) if facts.schema[column].dataType.typeName() == "array" else F.array(column)
        there = F.filter(each, lambda v: v.isNotNull())
        return F.transform(there, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("basis")))

    entries = F.flatten(F.array(*[entries_of(k, c) for k, c in columns.items()]))
    return facts.select(F.col(capture).alias("capture_id"), F.col(session).cast("string").alias("session_id"), F.explode(entries).alias("e")).select("e.kind", "e.basis", "session_id", "capture_id")


def correlated(members: DataFrame) -> DataFrame:
    """kind, basis, sessions, captures, correlation_id of every group of two sessions or more. The id hashes the sorted members, as it is defined, so the list of a group is held in one row."""
    lists = [F.sort_array(F.collect_set(c)).alias(c) for c in ("session_id", "capture_id")]
    groups = members.groupBy("kind", "basis").agg(*lists).where(F.size("session_id") >= 2)
    made = correlation_id(F.col("kind"), F.col("basis"), F.array_join("session_id", ","), F.array_join("capture_id", ","))
    return groups.select("kind", "basis", F.size("session_id").cast("long").alias("sessions"), F.size("capture_id").cast("long").alias("captures"), made.alias("correlation_id"))


def routed(warnings: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """sessions with n_warnings and their distinct codes in order; warnings without a session stay with the capture and are not counted here."""
    own = warnings.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_warnings"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))
    return sessions.join(own, key, "left").withColumns({"n_warnings": F.coalesce("n_warnings", F.lit(0)), "codes": F.coalesce("codes", F.lit(""))})


def gap_warnings(gaps: DataFrame) -> DataFrame:
    """One SEQUENCE_GAP warning for each gap (session_id, direction, offset, length)."""
    message = F.concat_ws(" ", F.col("length").cast("string"), F.lit("bytes missing at"), F.col("offset").cast("string"), F.lit("of"), "direction")
    return gaps.select("session_id", F.lit("SEQUENCE_GAP").alias("code"), message.alias("message"))


def merged_spans(lines: DataFrame, span: list[str]) -> DataFrame:
    """Each span's first start, last end, lines, distinct packets, whether all its lines are whole and whether any is ambiguous."""
    return lines.groupBy(*span).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("lines"),
        F.count_distinct("packet").alias("packets"), F.bool_and("whole").alias("whole"), F.bool_or("ambiguous").alias("ambiguous"),
    )


def holdout(samples: DataFrame, family: str, heldout: list[str]) -> tuple[DataFrame, DataFrame]:
    """samples of the families that stay, and of those withheld; a row without a family stays."""
    out = F.coalesce(F.col(family).isin(*heldout), F.lit(False))
    return samples.where(~out), samples.where(out)


def overlap(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys on both sides; an honest split has none."""
    return left.select(*key).intersect(right.select(*key))


def admitted(sessions: DataFrame, capture: str, order: list[str], most: int) -> DataFrame:
    """sessions with admitted: false beyond the first `most` of a capture by order."""
    w = Window.partitionBy(capture).orderBy(*order)
    return sessions.withColumn("admitted", F.row_number().over(w) <= most)


def admission(sessions: DataFrame, key: str, most_open: int, most_total: int) -> DataFrame:
    """capture_id, key, start, end, admitted: which sessions a sensor with room for most_open at once and most_total in all would have taken.

    sessions: capture_id, key (a flow), start, end (packet numbers; a session is open from its first packet to its last). A refused key stays refused, so
    later sessions of a flow that was once turned away are turned away as well. A capture's sessions are walked in order, by one task that holds the open ends and the refused keys.
    """
    fields = ["capture_id", key, "start", "end"]
    rows = sessions.select(*fields).repartition("capture_id").sortWithinPartitions("capture_id", "start", key)

    def walked(batches):
        capture, total, ends, refused = None, 0, [], set()
        for b in batches:
            out = []
            for c, k, start, end in zip(*(b[f] for f in fields), strict=True):
                if c != capture:
                    capture, total, ends, refused = c, 0, [], set()
                while ends and ends[0] < start:
                    heapq.heappop(ends)
                taken = k not in refused and len(ends) < most_open and total < most_total
                if taken:
                    heapq.heappush(ends, end)
                    total += 1
                else:
                    refused.add(k)
                out.append(taken)
            yield b.assign(admitted=out)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(walked, ", ".join(f"`{f}` {kinds[f]}" for f in fields) + ", admitted boolean")


def chains(certificates: DataFrame, anchors: DataFrame, at: str, depth: int = 8) -> DataFrame:
    """leaf, status of every leaf certificate: its issuers are followed by name until an anchor, each valid at the time.

    certificates: session_id, position (0: the leaf), subject, issuer, not_before_us, not_after_us and the time at. anchors: subject.
    PASSED if an anchor is reached, FAILED if a certificate on the way isn't valid or issues itself without being one, NOT_AVAILABLE if an issuer
    is missing or there are no anchors at all. Signatures are not verified here.
    """
    trusted = anchors.select(F.col("subject").alias("_anchor")).distinct()
    valid = (F.col(at) >= F.col("not_before_us")) & (F.col(at) <= F.col("not_after_us"))
    held = certificates.select("session_id", "position", "subject", "issuer", valid.alias("valid"))
    parents = held.select(F.col("session_id").alias("_session"), F.col("subject").alias("_subject"), F.col("issuer").alias("_issuer"), F.col("valid").alias("_valid")).dropDuplicates(["_session", "_subject"])
    walk = held.where("position = 0").select("session_id", F.col("subject").alias("leaf"), F.col("issuer").alias("next"), F.col("subject").alias("here"), F.when(~F.col("valid"), "FAILED").alias("status"))
    for _ in range(depth):
        stepped = walk.join(F.broadcast(trusted), F.col("next") == F.col("_anchor"), "left")
        stepped = stepped.join(parents, (F.col("session_id") == F.col("_session")) & (F.col("next") == F.col("_subject")), "left")
        status = (
            F.when(F.col("status").isNotNull(), F.col("status"))
            .when(F.col("_anchor").isNotNull(), "PASSED")
            .when(F.col("next") == F.col("here"), "FAILED")
            .when(F.col("_subject").isNull(), "NOT_AVAILABLE")
            .when(~F.col("_valid"), "FAILED")
        )
        walk = stepped.select("session_id", "leaf", F.coalesce("_issuer", "next").alias("next"), F.coalesce("_subject", "here").alias("here"), status.alias("status"))
    return walk.select("session_id", "leaf", F.coalesce("status", F.lit("NOT_AVAILABLE")).alias("status"))


def anchor_digest(anchors: DataFrame, fingerprint: str) -> DataFrame:
    """One row: the number of distinct anchors and the SHA-256 of their sorted fingerprints, one to a line. A trust store is small by its nature."""
    every = F.sort_array(F.collect_set(fingerprint))
    return anchors.agg(F.size(every).cast("long").alias("anchors"), F.sha2(F.array_join(every, "\n").cast("binary"), 256).alias("digest"))


def policy_notes(facts: DataFrame) -> DataFrame:
    """capture_id, session_id, notes: what a leaf's signature and key call for, joined; empty for sound ones."""
    hashed, kind, bits = F.lower("signature_hash"), F.col("key_algorithm"), F.col("key_bits")
    tests = {
        "MD5_SIGNATURE": hashed == "md5",
        "SHA1_SIGNATURE": hashed == "sha1",
        "SHORT_RSA_OR_DSA_KEY": kind.isin("RSA", "DSA") & (bits < 2048),
        "SHORT_EC_KEY": (kind == "EC") & (bits < 224),
        "EDWARDS_KEY": kind.isin("ED25519", "ED448"),
    }
    notes = F.concat_ws(",", *[F.when(test, name) for name, test in tests.items()])
    return facts.select("capture_id", "session_id", notes.alias("notes"))
