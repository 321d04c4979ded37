"""Captures end to end: formats, dissection, sessions, dialogues, TLS, rules."""

import struct

import pytest

from mailstrata.operators import rules
from mailstrata.sources import capture, mail, sessions, synth, tcp, tls, x509

C, S = ("10.0.0.1", 40000), ("192.0.2.1", 25)


def _analysed(spark, tmp_path, data, name="a.pcap"):
    (tmp_path / name).write_bytes(data)
    return sessions.analyse_captures(spark, str(tmp_path / name)).cache()


def _packets(turns, **kw):
    """Dissected packets as dicts, without Spark."""
    out = []
    for i, frame in enumerate(synth.conversation(C, S, turns, **kw), 1):
        ip, t = frame[14:], frame[34:]
        total = struct.unpack(">H", ip[2:4])[0]
        sp, dp, seq, ack = struct.unpack(">HHII", t[:12])
        dot = lambda b: ".".join(map(str, b))
        out.append({"packet_number": i, "ts_ns": i, "src": dot(ip[12:16]), "dst": dot(ip[16:20]), "src_port": sp, "dst_port": dp, "seq": seq, "ack": ack, "flags": t[13], "payload": t[20 : total - 20], "payload_len": total - 40})
    return out


def test_formats_agree(spark, tmp_path):
    frames = synth.conversation(C, S, synth.smtp_starttls())
    a = [r[:4] for r in capture.frames(__import__("io").BytesIO(synth.pcap(frames)))]
    b = [r[:4] for r in capture.frames(__import__("io").BytesIO(synth.pcapng(frames)))]
    assert a == b and len(a) == len(frames) and a[0][1] == 1_700_000_000_000_000_000


def test_damage_ends_a_scan(tmp_path):
    import io

    data = synth.pcap(synth.conversation(C, S, [("c", b"x")]))
    rows = list(capture.frames(io.BytesIO(data[:-7])))
    assert rows[-1][-1] is True and rows[-2][0] == len(rows) - 1
    assert list(capture.frames(io.BytesIO(data), max_packets=2))[-1][-1] is True
    for bad in (b"", b"plain text file"):
        with pytest.raises(capture.NotACapture):
            list(capture.frames(io.BytesIO(bad)))


def test_starttls_session(spark, tmp_path):
    row = _analysed(spark, tmp_path, synth.pcap(synth.conversation(C, S, synth.smtp_starttls(0x0303, 0xC02F)))).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.client_ip, r.server_port, r.role_basis, r.completeness, r.termination) == ("10.0.0.1", 25, "SYN", "COMPLETE", "FIN_BOTH")
    assert (r.protocol, r.detection, r.upgrade_state, r.upgrade_advertised) == ("SMTP", "CONFIRMED", "TLS_BYTES_OBSERVED", True)
    assert (r.selected_version, r.suite, r.encryption, r.sni, r.fs_status) == (0x0303, 0xC02F, "AES_128_GCM", "mail.example", "CAPABLE")
    assert r.session_id.startswith("sess-") and len(r.session_id) == 21


def test_rules_over_captures(spark, tmp_path):
    facts = _analysed(spark, tmp_path, synth.mail_capture(10))
    out = {(r.server_port, r.rule_id): r.outcome for r in rules.evaluate(facts).join(facts.select("session_id", "server_port", "upgrade_state", "auth_count"), "session_id").where("rule_id LIKE 'MAIL%'").collect()}
    assert out[143, "MAIL-001"] == "FAIL" and out[110, "MAIL-001"] == "FAIL"
    states = {r.upgrade_state for r in facts.collect()}
    assert states == {"TLS_BYTES_OBSERVED", "UPGRADE_REJECTED", "NOT_OBSERVED"}
    refused = facts.where("upgrade_state = 'UPGRADE_REJECTED'")
    assert {r.outcome for r in rules.evaluate(refused).where("rule_id IN ('MAIL-003', 'MAIL-005')").collect()} == {"FAIL"}
    weak = facts.where("encryption = '3DES_EDE_CBC'")
    got = {r.rule_id: r.outcome for r in rules.evaluate(weak).collect()}
    assert (got["TLS-CIPHER-004"], got["TLS-CIPHER-003"], got["TLS-PROTO-001"], got["TLS-KEX-001"], got["MAIL-002"]) == ("FAIL", "PASS", "FAIL", "FAIL", "FAIL")
    score = rules.score(rules.units(rules.evaluate(weak)), ["session_id"]).first()
    assert score.status == "SCORED" and score.score < 70


def test_order_of_files_and_partitions_changes_nothing(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(synth.mail_capture(12))
    rows = capture.read_captures(spark, str(tmp_path / "x.pcap"))
    a = sessions.assemble(capture.dissect(rows)).select("session_id", "completeness", "evidence_score", "suite").collect()
    b = sessions.assemble(capture.dissect(rows.repartition(7).orderBy("packet_number", ascending=False))).select("session_id", "completeness", "evidence_score", "suite").collect()
    assert sorted(a, key=lambda r: r[0]) == sorted(b, key=lambda r: r[0])


def test_bad_files_stay_visible(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(synth.mail_capture(2))
    (tmp_path / "b.pcap").write_bytes(b"nothing")
    rows = capture.read_captures(spark, str(tmp_path / "*.pcap"))
    assert rows.where("error IS NOT NULL").count() == 1 and rows.where("error IS NULL").count() > 10


def test_data_source(spark, tmp_path):
    p = tmp_path / "a.pcap"
    p.write_bytes(synth.mail_capture(3))
    capture.register(spark)
    assert spark.read.format("capture").load(str(p)).count() == capture.read_captures(spark, str(p)).count()


def test_gap_is_reported_and_never_crossed():
    p = _packets([("c", b"HELLO"), ("c", b"missing"), ("c", b"AND AFTER")])
    p = [x for x in p if x["payload"] != b"missing"]
    s = tcp.sessions_of(p)[0].facts()
    assert s["runs"]["c"] == [(0, b"HELLO"), (12, b"AND AFTER")]
    assert s["gaps"]["c"] == [(5, 7, "MISSING_SEGMENT")] and s["completeness"] == "PARTIAL"


def test_overlaps_first_wins():
    st = tcp.Stream()
    st.syn(99)
    free = lambda n: n
    st.add(100, b"abcdef", 6, 1, free)
    st.add(103, b"DEFGHI", 6, 2, free)
    st.add(100, b"abcdef", 6, 3, free)
    st.add(101, b"bcd", 3, 4, free)
    assert st.runs() == [(0, b"abcdefGHI")]
    assert (st.counts["CONFLICTING_OVERLAP"], st.counts["DUPLICATE"], st.counts["RETRANSMISSION"]) == (1, 1, 1)


def test_sequence_wraps_and_budget():
    st = tcp.Stream()
    st.syn(2**32 - 3)
    st.add(2**32 - 2, b"abcd", 4, 1, lambda n: n)
    st.add(2, b"ef", 2, 2, lambda n: 1)
    assert st.runs() == [(0, b"abcde")] and st.gaps() == [(5, 1, "LIMIT_EXCEEDED")]


def test_tuple_reuse_starts_a_session():
    p = _packets([("c", b"a")]) + _packets([("c", b"b")], isn=5000)
    for i, x in enumerate(p, 1):
        x["packet_number"] = i
    assert [s.instance for s in tcp.sessions_of(p)] == [1, 2]


def _lines(*turns):
    at, out = {"c": 0, "s": 0}, []
    for i, (who, text) in enumerate(turns):
        out.append((who, text, at[who], at[who] + len(text) + 2, False, i))
        at[who] += len(text) + 2
    return out


def test_imap_tags_match_and_drop_what_is_ahead():
    d = mail.parse(_lines(("s", b"* OK hi"), ("c", b"a STARTTLS"), ("c", b"b NOOP"), ("s", b"b OK"), ("s", b"a OK go")), 143)
    assert (d.protocol, d.matched, d.foreign, d.state) == ("IMAP", 1, 1, "UPGRADE_REQUESTED")


def test_pop3_single_line_list_opens_no_body():
    d = mail.parse(_lines(("s", b"+OK"), ("c", b"LIST 1"), ("s", b"+OK 1 10"), ("c", b"QUIT"), ("s", b"+OK bye")), 110)
    assert d.matched == 2 and d.quit


def test_fake_command_in_a_body_is_no_command():
    d = mail.parse(_lines(("s", b"220 m"), ("c", b"DATA"), ("s", b"354 go"), ("c", b"STARTTLS"), ("c", b"."), ("s", b"250 ok")), 25)
    assert not d.requested and d.state == "NOT_OBSERVED"


def test_nothing_secret_in_events():
    d = mail.parse(_lines(("s", b"220 m"), ("c", b"AUTH PLAIN c2VjcmV0"), ("s", b"235 ok"), ("c", b"hunter2 now"), ("s", b"500 what")), 25)
    assert d.auths[0]["mechanism"] == "PLAIN" and "c2VjcmV0" not in str(d.events) + str(d.auths) and "hunter2" not in str(d.events)


def test_tls13_and_retry():
    hello, answer = synth.client_hello([0x0304, 0x0303, 0x0A0A], [0x1301, 0x2A2A]), synth.server_hello(0x0303, 0x1301, 0x0304)
    f = tls.analyse([(0, hello)], [(0, answer)], 0, 0)
    assert (f["version"], f["suite"], f["offered"], f["offered_versions"]) == (0x0304, 0x1301, [0x1301], [0x0304, 0x0303])
    assert tls.analyse([(0, b"EHLO x")], [(0, b"250 ok")], 0, 0) is None


def _der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82, len(body) >> 8, len(body) & 255])
    return bytes([tag]) + size + body


def test_certificate_walk():
    oid = lambda hexed: _der(6, bytes.fromhex(hexed))
    alg = _der(0x30, oid("2a864886f70d010105"), _der(5))
    name = _der(0x30, _der(0x31, _der(0x30, oid("550403"), _der(12, b"a,b"))))
    times = _der(0x30, _der(0x17, b"200101000000Z"), _der(0x18, b"20300101000000Z"))
    key = _der(0x30, _der(0x30, oid("2a864886f70d010101"), _der(5)), _der(3, b"\0", _der(0x30, _der(2, b"\0" + b"\xff" * 128), _der(2, b"\1\0\1"))))
    eku = _der(0x30, oid("551d25"), _der(4, _der(0x30, oid("2b06010505070301"))))
    san = _der(0x30, oid("551d11"), _der(4, _der(0x30, _der(0x82, b"*.example.org"))))
    cert = _der(0x30, _der(0x30, _der(0xA0, _der(2, b"\2")), _der(2, b"\1"), alg, name, times, name, key, _der(0xA3, _der(0x30, eku, san))), alg, _der(3, b"\0x"))
    c = x509.parse(cert)
    assert (c["subject"], c["key_algorithm"], c["key_bits"], c["signature_hash"], c["eku_server_auth"]) == ("CN=a\\,b", "RSA", 1024, "sha1", True)
    assert c["not_before_us"] == 1577836800 * 10**6
    assert x509.matches(c["names"], "mail.example.org") and not x509.matches(c["names"], "a.b.example.org")
    with pytest.raises(ValueError):
        x509.parse(cert[:40])


def test_a_hot_flow_is_held_only_to_its_budget():
    import tracemalloc

    import pandas as pd

    def batches():
        for i in range(0, 10_000, 500):
            rows = [("c", "f", n, n, "10.0.0.1", 4000, "10.0.0.2", 25, 1 + n * 10_000, 1, 16, bytes([n % 251]) * 10_000, 10_000) for n in range(i, i + 500)]
            yield pd.DataFrame(rows, columns=["capture_id", "flow_id", "packet_number", "ts_ns", "src", "src_port", "dst", "dst_port", "seq", "ack", "flags", "payload", "payload_len"])

    packets = (p for b in batches() for p in b.to_dict("records"))
    tracemalloc.start()
    try:
        s = tcp.sessions_of(packets, 1 << 20)[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        got = pd.concat(sessions._walked(batches(), 1 << 20))
        peak = max(peak, tracemalloc.get_traced_memory()[1])
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20  # 100 MB of payload, 5 MB of a batch
    assert s.facts()["gaps"]["c"] == [(1 << 20, 100_000_000 - (1 << 20), "LIMIT_EXCEEDED")] and s.streams["c"].counts["DROPPED_LIMIT"] == 10_000 - 105
    assert len(got) == 1 and got["packets"].iloc[0] == 10_000 and got["client_bytes"].iloc[0] == 1 << 20
