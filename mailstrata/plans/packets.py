"""The packet path over generated captures; its input has no tables, so only rows are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intel, rules
from ..sources import sessions
from ..sources.capture import dissect
from ..sources.synth import generated
from .registry import query


@query()
def pcap_sessions(t):
    """Sessions of a thousand generated conversations in eight captures."""
    x = sessions.assemble(dissect(generated(t.spark, 8, 125)))
    return x.select("capture_id", "session_id", "server_port", "completeness", "protocol", "upgrade_state", "suite", "client_bytes", "server_bytes", "packets")


@query()
def pcap_findings(t):
    """Findings of those sessions with priority and rank."""
    facts = sessions.facts(sessions.assemble(dissect(generated(t.spark, 8, 125))))
    return rules.prioritised(rules.findings(rules.failures(facts)))


@query()
def pcap_scores(t):
    """Posture of each generated capture."""
    facts = sessions.facts(sessions.assemble(dissect(generated(t.spark, 8, 125))))
    return rules.posture(facts, ["capture_id"])


@query()
def pcap_entities(t):
    """Servers of the generated captures and the configurations they were seen with."""
    facts = sessions.assemble(dissect(generated(t.spark, 8, 125)))
    hexed = lambda c: F.lower(F.hex(c))
    shown = facts.select("capture_id", "session_id", F.concat_ws(":", "server_ip", F.col("server_port").cast("string")).alias("entity"), hexed("selected_version").alias("version"), hexed("suite").alias("suite"), hexed("tls_group").alias("group"), "alpn", "leaf_sha256", "spki_sha256", "issuer", "sni", "first_ns")
    return intel.entities(intel.fingerprints(shown), ["entity"], ["session_id", "capture_id", "sni", "config_fingerprint"], "first_ns")
