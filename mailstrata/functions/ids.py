"""Deterministic ids: prefixes of SHA-256 digests of canonical material."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(material: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(material.cast("binary"), 256), 1, length)


def short_id(prefix: str, material: Column, length: int) -> Column:
    return F.concat(F.lit(prefix), digest(material, length))


def text(c, missing: str = "") -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(missing))


def flow_material(ip_a, port_a, ip_b, port_b, transport: str = "TCP") -> Column:
    """The endpoints in order of (ip, port), so both directions give one key."""
    a, b = F.struct(ip_a.alias("ip"), port_a.alias("port")), F.struct(ip_b.alias("ip"), port_b.alias("port"))
    first, second = F.least(a, b), F.greatest(a, b)
    return F.concat_ws("|", F.lit(transport), F.concat_ws(":", first["ip"], first["port"].cast("string")), F.concat_ws(":", second["ip"], second["port"].cast("string")))


def flow_id(ip_a, port_a, ip_b, port_b) -> Column:
    return short_id("flow-", flow_material(ip_a, port_a, ip_b, port_b), 16)


def endpoint(ip, port) -> Column:
    """ip:port, null if either is."""
    return F.concat(ip, F.lit(":"), port.cast("string"))


def flow_of(first, second) -> Column:
    """flow_id of two endpoint()s that stand in order of (ip, port): where endpoints are in many pairs they are made once. Null if either is."""
    return short_id("flow-", F.concat(F.lit("TCP|"), first, F.lit("|"), second), 16)


def first_session_id(capture_id: str, flow) -> Column:
    """session_id of a flow's first session, null if the flow is."""
    return short_id("sess-", F.concat(F.lit(f"{capture_id}|"), flow, F.lit("|1")), 16)


def session_id(capture_id, flow, instance) -> Column:
    return short_id("sess-", F.concat_ws("|", capture_id, flow, instance.cast("string")), 16)


def entity_id(ip, port) -> Column:
    return short_id("entity-", F.concat_ws("|", ip, port.cast("string")), 12)


def finding_id(policy_id, fingerprint, rule, capture, session, offsets, packets) -> Column:
    """offsets, packets: comma-joined strings."""
    return short_id("find-", F.concat_ws("|", policy_id, fingerprint, rule, capture, session, offsets, packets), 16)


def event_id(capture, session, kind, anchor) -> Column:
    return short_id("evt-", F.concat_ws("|", capture, text(session), kind, anchor), 12)


def drift_id(entity, kind, before, after, first_session, second_session) -> Column:
    return short_id("drift-", F.concat_ws("|", entity, kind, text(before, "None"), text(after, "None"), first_session, second_session), 12)


def correlation_id(kind, basis, sessions, captures) -> Column:
    """sessions, captures: sorted, comma-joined."""
    return short_id("corr-", F.concat_ws("|", kind, basis, F.concat(F.lit("sessions="), sessions), F.concat(F.lit("captures="), captures)), 12)
