"""From frames to a wide table of session facts, on which everything else is DataFrame functions.

Packets are grouped by capture and flow: what a session is depends on the packets before, so a flow is walked in order, by
one task. A flow's kept bytes are bounded by the session budget.
"""

from __future__ import annotations

import hashlib
import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import flow_id, session_id
from ..operators.dialogue import forward_secrecy, handshake_state
from . import mail, tcp, tls, x509
from .capture import dissect

RUN = "array<struct<direction:string,offset:long,length:long,sha256:string>>"
GAP = "array<struct<direction:string,offset:long,length:long,reason:string>>"
EVENT = "array<struct<kind:string,direction:string,offset:long,end:long,verb:string,code:string,packets:array<long>,ambiguous:boolean>>"
CONFLICT = "array<struct<direction:string,offset:long,length:long,accepted_packet:long,conflicting_packet:long,accepted_sha256:string,conflicting_sha256:string>>"
WARNING = "array<struct<code:string,severity:string,direction:string,offset:long,length:long,reason:string,packets:array<long>>>"
ALERT = "array<struct<direction:string,offset:long,encrypted:boolean,level:string,description:string>>"
PACKETS = "array<long>"
SESSION = (
    "capture_id string, flow_id string, instance int, client_ip string, client_port int, server_ip string, server_port int, role_basis string, packets int, first_packet long, last_packet long, first_ns long, last_ns long,"
    f"completeness string, termination string, handshake_complete boolean, runs {RUN}, gaps {GAP}, client_bytes long, server_bytes long, conflicts int, retransmissions int, duplicates int, out_of_order int,"
    f"protocol string, detection string, parse_state string, events {EVENT}, capabilities_seen boolean, upgrade_advertised boolean, upgrade_requested boolean, upgrade_state string, auth_count int, auth_before_upgrade int, commands_after_refusal int, evidence_score int, implicit_tls boolean,"
    "has_tls boolean, client_hello boolean, server_hello boolean, hrr boolean, fatal_alert boolean, degraded boolean, hello_done boolean, cipher_changed boolean, selected_version int, lowest_offered int, offer string, suite int, kex string, authentication string, encryption string, suite_known boolean, tls13_suite boolean, tls_group int, share boolean, alpn string, sni string, resumed boolean,"
    "subject string, issuer string, not_before_us long, not_after_us long, key_algorithm string, key_bits int, signature_hash string, eku_count int, eku_server_auth boolean, leaf_sha256 string, spki_sha256 string, hostname_status string,"
    f"conflict_records {CONFLICT}, client_acked_missing long, server_acked_missing long, warnings {WARNING}, events_suppressed int, mail_packets {PACKETS}, mail_offsets {PACKETS}, tls_packets {PACKETS}, certificate_packets {PACKETS},"
    f"tls_alerts {ALERT}, client_framing string, server_framing string, client_boundary long, client_boundary_reason string, server_boundary long, server_boundary_reason string, ambiguous_records int, compatibility_change boolean, dh_bits int, offered_suites int, offered_versions int, offered_tls13 boolean, chain_der array<binary>"
)
NESTED = (RUN, GAP, EVENT, CONFLICT, WARNING, ALERT)


def _column_names(schema: str) -> list[str]:
    for kind in NESTED:
        schema = schema.replace(kind, "x")
    return [part.split()[0] for part in schema.split(",")]


COLUMNS = _column_names(SESSION)


def _merged_lines(runs: dict, session: tcp.Session):
    """Lines of both directions in the order in which their last byte was captured."""
    arrived = {}
    for who, stream in session.streams.items():
        origin = min([stream.base or 0, *stream.starts[:1]])
        arrived[who] = [(s - origin + len(d), n) for s in stream.starts for d, n in [stream.parts[s]]]
    out = []
    for who in ("c", "s"):
        ends = arrived[who]
        i = 0
        for line in mail.lines_of(who, runs[who], 0):
            while i < len(ends) - 1 and ends[i][0] < line[3]:
                i += 1
            out.append((*line[:5], ends[i][1] if ends else 0))
    return sorted(out, key=lambda x: (x[5], x[0] == "s", x[2]))


def _warnings(session: tcp.Session, gaps: dict, d: mail.Dialogue) -> list[dict]:
    """A record for each hole, each disagreement of segments, bytes that were acknowledged and not captured, and events beyond the limit."""
    out = []
    for w, stream in session.streams.items():
        made = lambda code, severity, offset, length, reason, packets: {"code": code, "severity": severity, "direction": w, "offset": offset, "length": length, "reason": reason, "packets": packets}  # noqa: B023, E731
        for offset, length, reason in gaps[w]:
            beside = [*stream.carriers(offset - 1, offset), *stream.carriers(offset + length, offset + length + 1)]
            out.append(made("SEQUENCE_GAP", "WARNING", offset, length, reason, sorted(set(beside))))
        for x in stream.conflict_records():
            out.append(made("OVERLAP_CONFLICT", "ERROR", x["offset"], x["length"], "FIRST_OBSERVED_WINS", sorted({x["accepted_packet"], x["conflicting_packet"]})))
        if missing := stream.acked_missing():
            out.append(made("ACKED_DATA_NOT_CAPTURED", "WARNING", stream.high - stream.origin(), missing, None, []))
    if d.suppressed:
        out.append({"code": "EVENTS_SUPPRESSED", "severity": "WARNING", "direction": None, "offset": None, "length": d.suppressed, "reason": None, "packets": []})
    return out


def _row(session: tcp.Session) -> dict:
    facts = session.facts()
    runs, gaps, c, s = facts["runs"], facts["gaps"], session.streams["c"], session.streams["s"]
    total = lambda k: c.counts[k] + s.counts[k]
    row = {
        "instance": session.instance, "client_ip": session.client[0], "client_port": session.client[1], "server_ip": session.server[0], "server_port": session.server[1], "role_basis": session.basis, "packets": session.packets,
        "first_packet": session.first["packet_number"], "last_packet": session.last["packet_number"], "first_ns": session.first["ts_ns"], "last_ns": session.last["ts_ns"], "completeness": facts["completeness"], "termination": facts["termination"], "handshake_complete": session.handshake,
        "runs": [{"direction": w, "offset": o, "length": len(d), "sha256": hashlib.sha256(d).hexdigest()} for w in "cs" for o, d in runs[w]], "gaps": [{"direction": w, "offset": o, "length": n, "reason": r} for w in "cs" for o, n, r in gaps[w]],
        "client_bytes": sum(len(d) for _, d in runs["c"]), "server_bytes": sum(len(d) for _, d in runs["s"]), "conflicts": total("CONFLICTING_OVERLAP"), "retransmissions": total("RETRANSMISSION"), "duplicates": total("DUPLICATE"), "out_of_order": total("out_of_order"),
    }
    carriers, ambiguous = (lambda w, a, z: session.streams[w].carriers(a, z)), (lambda w, a, z: session.streams[w].ambiguous(a, z))
    head = runs["c"][0][1][:3] if runs["c"] and runs["c"][0][0] == 0 else b""
    implicit = len(head) == 3 and head[0] == 22 and head[1] == 3 and head[2] <= 4
    d = mail.Dialogue(mail.PORTS.get(session.server[1], "UNKNOWN")) if implicit else mail.parse(_merged_lines(runs, session), session.server[1])
    t = None
    if implicit:
        t = tls.analyse(runs["c"], runs["s"], 0, 0, carriers, ambiguous)
    elif d.boundary is not None:
        request = next((e["offset"] for e in reversed(d.events) if e["kind"] == "COMMAND" and e["verb"] in mail.UPGRADES), None)
        run = next((x for x in runs["c"] if request is not None and x[0] <= request < x[0] + len(x[1])), None)
        client_at = run[0] + run[1].find(b"\n", request - run[0]) + 1 if run else 0
        t = tls.analyse(runs["c"], runs["s"], client_at, d.boundary, carriers, ambiguous)
        if t:
            d.state = "TLS_BYTES_OBSERVED"
    events = [e | {"packets": carriers(e["direction"], e["offset"], e["end"]), "ambiguous": ambiguous(e["direction"], e["offset"], e["end"])} for e in d.events]
    auths = [(a["offset"], a["end"]) for a in d.auths] or [(e["offset"], e["end"]) for e in d.events if e["kind"] == "COMMAND" and e["verb"] in mail.UPGRADES]
    row |= {
        "conflict_records": [{"direction": w} | x for w in "cs" for x in session.streams[w].conflict_records()], "client_acked_missing": c.acked_missing(), "server_acked_missing": s.acked_missing(), "warnings": _warnings(session, gaps, d),
        "events_suppressed": d.suppressed, "mail_offsets": sorted({a for a, _ in auths}), "mail_packets": sorted({p for a, z in auths for p in carriers("c", a, z)}), "tls_packets": [], "certificate_packets": [], "chain_der": [],
    }
    complete = "HANDED_OFF" if t else "COMPLETE" if d.quit or session.closed() and not any(gaps.values()) else "TRUNCATED"
    row |= {
        "protocol": d.protocol, "detection": "IMPLICIT_TLS" if implicit else d.detection(), "parse_state": complete, "events": events, "capabilities_seen": d.seen_capabilities, "upgrade_advertised": bool(d.capabilities & mail.UPGRADES), "upgrade_requested": d.requested, "upgrade_state": d.state,
        "auth_count": len(d.auths), "auth_before_upgrade": sum(a["before_upgrade"] for a in d.auths) if d.state in ("UPGRADE_ACCEPTED", "TLS_BYTES_OBSERVED") else 0, "commands_after_refusal": d.after_refusal, "evidence_score": d.score(), "implicit_tls": implicit, "has_tls": t is not None,
    }
    if t:
        suite = tls.SUITES.get(t.get("suite", -1))
        known = [v for v in t["offered_versions"] if v in tls.VERSIONS]
        row |= {
            "client_hello": t["client_hello"], "server_hello": t["server_hello"], "hrr": t["hrr"], "fatal_alert": t["fatal_alert"], "degraded": t["degraded"], "hello_done": t["done"], "cipher_changed": t["change"], "selected_version": t.get("version"), "lowest_offered": min(known, default=None),
            "offer": ",".join(f"{x:04x}" for x in sorted(t["offered_versions"]) + sorted(t["offered"])) or None, "suite": t.get("suite"), "kex": suite and suite[0], "authentication": suite and suite[1], "encryption": suite and suite[2], "suite_known": suite is not None, "tls13_suite": bool(suite and suite[0] == "TLS13"),
            "offered_suites": len(t["offered"]), "offered_versions": len(t["offered_versions"]), "offered_tls13": 0x0304 in t["offered_versions"],
            "tls_group": t.get("group"), "share": t.get("share", False), "alpn": t.get("alpn"), "sni": t.get("sni"), "resumed": t.get("resumed"),
            "tls_packets": sorted({p for w, a, z in t["hello_ranges"] for p in carriers(w, a, z)}), "certificate_packets": sorted({p for w, a, z in t["certificate_ranges"] for p in carriers(w, a, z)}),
            "tls_alerts": t["alerts"], "ambiguous_records": t["ambiguous_records"], "compatibility_change": t["compatibility_change"], "dh_bits": t.get("dh_bits"), "chain_der": t["certificates"],
        }
        for who, side in (("c", "client"), ("s", "server")):
            offset, reason = t["boundaries"].get(who, (None, "NOT_ENCRYPTED"))
            row |= {f"{side}_framing": t["grades"].get(who), f"{side}_boundary": offset, f"{side}_boundary_reason": reason}
        if t["certificates"]:
            try:
                leaf = x509.parse(t["certificates"][0])
                good = x509.matches(leaf["names"], t.get("sni"))
                row |= {k: leaf[k] for k in ("subject", "issuer", "not_before_us", "not_after_us", "key_algorithm", "key_bits", "signature_hash", "eku_count", "eku_server_auth", "spki_sha256")}
                row |= {"leaf_sha256": leaf["sha256"], "hostname_status": None if good is None else "PASSED" if good else "FAILED"}
            except ValueError:
                row["degraded"] = True
    return row


def _walked(batches, budget: int):
    """Frames of session rows. Flows follow one another and may go on in the next batch; a packet is dropped once its session has taken its bytes."""
    packets = (p for b in batches for p in b.to_dict("records"))
    out = []
    for flow, own in itertools.groupby(packets, lambda p: (p["capture_id"], p["flow_id"])):
        for s in tcp.walked(own, budget):
            out.append({"capture_id": flow[0], "flow_id": flow[1]} | _row(s))
            if len(out) >= 500:
                yield _frame(out)
                out = []
    yield _frame(out)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS, dtype=object).where(lambda x: x.notna(), None)


def assemble(packets: DataFrame, budget: int = 16 << 20) -> DataFrame:
    """Sessions of dissected packets: one row each, with ids."""

    keyed = packets.where("outcome = 'TCP'").withColumn("flow_id", flow_id(F.col("src"), F.col("src_port"), F.col("dst"), F.col("dst_port")))
    need = ["capture_id", "flow_id", "packet_number", "ts_ns", "src", "src_port", "dst", "dst_port", "seq", "ack", "flags", "payload", "payload_len"]
    dealt = keyed.select(*need).repartition("capture_id", "flow_id").sortWithinPartitions("capture_id", "flow_id", "packet_number")
    made = dealt.mapInPandas(lambda batches: _walked(batches, budget), SESSION)
    return made.withColumn("session_id", session_id(F.col("capture_id"), F.col("flow_id"), F.col("instance")))


def facts(sessions: DataFrame) -> DataFrame:
    """sessions with the derived columns that rules look at."""
    c = lambda n: F.coalesce(F.col(n), F.lit(False))
    tls13 = F.coalesce(F.col("selected_version") == 0x0304, F.lit(False))
    state = handshake_state(c("fatal_alert"), c("degraded"), c("hrr"), c("server_hello"), c("client_hello"), tls13, c("hello_done"), c("cipher_changed"))
    secrecy = forward_secrecy(c("server_hello"), c("suite_known"), tls13, F.coalesce("kex", F.lit("")), c("share"))
    cert = F.when(F.col("leaf_sha256").isNotNull(), "OBSERVED").when(F.col("authentication") == "ANONYMOUS", "NOT_APPLICABLE_ANONYMOUS").when(tls13, "ENCRYPTED_TLS13").otherwise("NOT_OBSERVED")
    from .tls import HYBRID

    return sessions.withColumns({
        "handshake_state": state, "fs_status": secrecy, "cert_visibility": cert, "capture_us": F.expr("first_ns div 1000"), "analysis_us": F.lit(None).cast("long"), "chain_status": F.col("chain_status") if "chain_status" in sessions.columns else F.lit("NOT_AVAILABLE"),
        "group_family": F.when(F.col("tls_group").isin(sorted(HYBRID)), "HYBRID").when(F.col("tls_group").isNotNull(), "CLASSIC"),
    })


def analyse_captures(spark, glob: str, max_packets: int = 1 << 40, trust_store: str | None = None) -> DataFrame:
    """Session facts of all captures that match; trust_store: a PEM file of anchors that chains are verified against."""
    from ..operators import chains
    from .capture import read_captures

    anchors, store = chains.trust_store(spark, trust_store)
    sessions = assemble(dissect(read_captures(spark, glob, max_packets)))
    return facts(chains.with_chain_status(sessions, anchors, store["configured"]))
