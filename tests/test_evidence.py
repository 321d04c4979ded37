"""Packet evidence, record walks and certificate paths on captures whose facts are known."""

import hashlib
import struct
import subprocess

import pytest

from mailstrata.operators import chains, evidence, intervals, rules
from mailstrata.sources import mail, sessions, synth, tcp, tls, x509
from mailstrata.sources.signatures import signed_by

C, S = ("10.0.0.1", 40000), ("192.0.2.1", 25)


def _analysed(spark, tmp_path, frames, trust_store=None):
    (tmp_path / "a.pcap").write_bytes(synth.pcap(frames))
    return sessions.analyse_captures(spark, str(tmp_path / "a.pcap"), trust_store=trust_store)


def _stream(*segments):
    """A stream from (offset, bytes), packets numbered from 1."""
    s = tcp.Stream()
    s.syn(99)
    for n, (offset, data) in enumerate(segments, 1):
        s.add(100 + offset, data, len(data), n, lambda k: k)
    return s


def test_carriers_are_the_packets_of_a_range():
    s = _stream((0, b"abcde"), (5, b"fghij"), (0, b"abcdefghij"), (12, b"xyz"))
    assert s.carriers(0, 5) == [1] and s.carriers(4, 6) == [1, 2] and s.carriers(0, 15) == [1, 2, 4]
    assert s.carriers(7, 7) == [2] and s.carriers(10, 12) == [] and s.carriers(40, 50) == []


def test_conflicts_keep_both_digests():
    s = _stream((0, b"abcdef"), (3, b"XYZghi"), (3, b"def"))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert s.conflict_records() == [{"offset": 3, "length": 3, "accepted_packet": 1, "conflicting_packet": 2, "accepted_sha256": digest(b"def"), "conflicting_sha256": digest(b"XYZ")}]
    assert s.ambiguous(5, 6) and not s.ambiguous(6, 9) and not s.ambiguous(0, 3)


def test_relational_conflicts_equal_the_walk(spark):
    import random

    rng = random.Random(3)
    rows, want = [], set()
    for key in range(25):
        segments = []
        for _ in range(6):
            start = rng.randrange(40)
            segments.append((start, "".join(rng.choice("ab") if rng.random() < 0.1 else "a" for _ in range(rng.randrange(1, 25)))))
        s = _stream(*[(o, d.encode()) for o, d in segments])
        rows += [(key, n, o, o + len(d), d) for n, (o, d) in enumerate(segments, 1)]
        want |= {(key, x["accepted_packet"], x["conflicting_packet"], i) for x in s.conflict_records() for i in range(x["offset"] - min(0, s.origin() - 100), x["offset"] + x["length"])}
    table = spark.createDataFrame(rows, "k int, packet int, start int, end int, payload string")
    found = evidence.disagreements(table, ["k"]).collect()
    origin = {k: min(r[2] for r in rows if r[0] == k) for k in range(25)}
    got = {(r["k"], r["accepted_packet"], r["conflicting_packet"]) for r in found}
    assert got == {w[:3] for w in want} and len(got) > 5 and origin
    text = {(r[0], r[1]): (r[2], r[4]) for r in rows}
    for r in found:
        for who in ("accepted", "conflicting"):
            start, payload = text[r["k"], r[f"{who}_packet"]]
            assert r[f"{who}_sha256"] == hashlib.sha256(payload[r["start"] - start : r["end"] - start].encode()).hexdigest()


def test_overlaps_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(8)
    make = lambda n: [(i % 3, i, s := rng.randrange(5000), s + rng.choice([0, 1, 2, 3, 17, 64, 900, 4000])) for i in range(n)]
    a, b = make(150), make(120)
    schema = "k int, id int, s long, e long"
    got = {tuple(r) for r in intervals.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], "id", "s", "e").collect()}
    assert got == {(k, i, j, max(s, s2), min(e, e2)) for k, i, s, e in a for k2, j, s2, e2 in b if k == k2 and max(s, s2) < min(e, e2)}
    assert intervals.overlaps(spark.createDataFrame([], schema), spark.createDataFrame(b, schema), ["k"], "id", "s", "e").count() == 0


def test_events_hellos_and_findings_name_their_packets(spark, tmp_path):
    frames = synth.conversation(C, S, synth.smtp_starttls(0x0301, 0x000A, auth_first=True))
    facts = _analysed(spark, tmp_path, frames)
    r = facts.first()
    where = {(e["verb"], e["kind"]): e["packets"] for e in r["events"]}
    assert where["EHLO", "COMMAND"] == [5] and where["AUTH", "COMMAND"] == [7] and where["AUTH", "REPLY"] == [8] and where["STARTTLS", "COMMAND"] == [9]
    assert r["tls_packets"] == [11, 12] and r["mail_packets"] == [7] and r["mail_offsets"] == [8]
    found = {x["rule_id"]: x for x in rules.findings(rules.evaluate(facts)).collect()}
    early = found["MAIL-001"]
    assert early["packets"] == [7] and early["offsets"] == [8] and found["TLS-PROTO-001"]["packets"] == [11, 12] and found["TLS-PROTO-001"]["offsets"] == []
    material = f"default|{rules.Policy().fingerprint()}|MAIL-001|{r['capture_id']}|{r['session_id']}|8|7"
    assert early["finding_id"] == "find-" + hashlib.sha256(material.encode()).hexdigest()[:16]


def test_a_command_over_several_packets_names_them_all(spark, tmp_path):
    turns = [("s", b"220 mail\r\n"), ("c", b"EH"), ("c", b"LO"), ("c", b" x\r\n"), ("s", b"250 mail\r\n"), ("c", b"QUIT\r\n"), ("s", b"221 bye\r\n")]
    r = _analysed(spark, tmp_path, synth.conversation(C, S, turns)).first()
    assert [e["packets"] for e in r["events"] if e["verb"] == "EHLO"] == [[5, 6, 7], [8]]


def test_warnings_of_a_capture(spark, tmp_path):
    frames = synth.conversation(C, S, [("s", b"220 mail\r\n"), ("c", b"EHLO x\r\n"), ("s", b"250 mail\r\n"), ("c", b"NOOP\r\n"), ("s", b"250 ok\r\n"), ("c", b"QUIT\r\n"), ("s", b"221 bye\r\n")])
    other = synth.packet(C, S, 1001, 7011, 24, b"HELO y\r\n")  # the bytes of the first command once more, but others
    r = _analysed(spark, tmp_path, [*frames[:5], other, *frames[5:6], *frames[7:]]).first()  # NOOP isn't captured
    found = {w["code"]: w for w in r["warnings"]}
    assert found["OVERLAP_CONFLICT"]["packets"] == [5, 6] and found["OVERLAP_CONFLICT"]["offset"] == 0
    assert found["SEQUENCE_GAP"]["offset"] == 8 and found["SEQUENCE_GAP"]["length"] == 6 and found["SEQUENCE_GAP"]["packets"] == [5, 9]
    assert r["conflict_records"][0]["accepted_sha256"] == hashlib.sha256(b"EHLO x\r\n").hexdigest()
    assert [e["ambiguous"] for e in r["events"] if e["verb"] == "EHLO" and e["kind"] == "COMMAND"] == [True]


def test_acknowledged_bytes_that_are_missing():
    s = _stream((0, b"abc"))
    s.acked = 110
    assert s.acked_missing() == 7
    s.fin = True
    assert s.acked_missing() == 6 and tcp.Stream().acked_missing() == 0


def test_events_beyond_the_limit_are_counted():
    lines = [("c", b"NOOP", i * 6, i * 6 + 6, False, i) for i in range(mail.EVENTS + 30)]
    d = mail.parse([("s", b"220 x", 0, 5, False, 0), *lines], 25)
    assert len(d.events) == mail.EVENTS and d.suppressed == 30


def _record(kind, body, version=0x0303):
    return struct.pack(">BHH", kind, version, len(body)) + body


def _message(kind, body):
    return bytes([kind]) + len(body).to_bytes(3, "big") + body


def test_boundaries_up_to_tls12_and_in_13():
    hello, server = synth.client_hello([0x0303], [0xC02F]), synth.server_hello(0x0303, 0xC02F)
    change, data = _record(20, b"\1"), _record(23, b"x" * 20)
    f = tls.analyse([(0, hello + change + _record(22, b"\xff" * 16) + data)], [(0, server + change + data)], 0, 0)
    assert f["boundaries"] == {"c": (len(hello) + 6, "TLS12_CHANGE_CIPHER_SPEC"), "s": (len(server) + 6, "TLS12_CHANGE_CIPHER_SPEC")} and f["change"]
    server13 = synth.server_hello(0x0303, 0x1301, 0x0304)
    f = tls.analyse([(0, synth.client_hello([0x0304], [0x1301]) + change + data)], [(0, server13 + change + data)], 0, 0)
    assert f["boundaries"]["s"] == (len(server13), "TLS13_AFTER_SERVER_HELLO") and f["boundaries"]["c"][1] == "TLS13_AFTER_SERVER_HELLO"
    assert f["compatibility_change"] and not f["change"]
    f = tls.analyse([(0, hello)], [(0, data)], 0, 0)
    assert f["boundaries"] == {"s": (0, "APPLICATION_DATA_OBSERVED")} and f["grades"] == {"c": "HANDSHAKE_CLIENT_HELLO", "s": "SINGLE_RECORD_HEADER"}


def test_records_are_merged_in_capture_order():
    hello, server = synth.client_hello([0x0304], [0x1301]), synth.server_hello(0x0303, 0x1301, 0x0304)
    late = {"c": [9], "s": [2]}  # the server's records were captured first
    order = [r[2] for r in tls.merged(tls.records([(0, hello)], 0)[0], tls.records([(0, server)], 0)[0], lambda w, a, z: late[w])]
    assert order == ["s", "c"]


def test_ambiguous_records_are_not_read():
    hello, server = synth.client_hello([0x0303], [0xC02F]), synth.server_hello(0x0303, 0xC02F)
    f = tls.analyse([(0, hello)], [(0, server)], 0, 0, ambiguous=lambda w, a, z: w == "s")
    assert f["client_hello"] and not f["server_hello"] and f["ambiguous_records"] == 1 and f["degraded"]


def test_a_message_over_two_records_knows_its_ranges():
    whole = synth.client_hello([0x0303], [0xC02F])[5:]
    f = tls.analyse([(0, _record(22, whole[:20]) + _record(22, whole[20:]))], [(0, synth.server_hello(0x0303, 0xC02F))], 0, 0)
    assert f["client_hello"] and [r for r in f["hello_ranges"] if r[0] == "c"] == [("c", 5, 25), ("c", 30, 30 + len(whole) - 20)]


def test_key_exchange_parameters():
    vector = lambda n, b: len(b).to_bytes(n, "big") + b
    for suite, body, want in ((0x0033, vector(2, b"\xff" * 96) + vector(2, b"\2") + vector(2, b"\3" * 96), {"dh_bits": 768, "share": True}), (0xC02F, b"\3\0\x17" + vector(1, b"\4" * 65), {"group": 23, "share": True}), (0x002F, b"\3\0\x17", {})):
        f = tls.analyse([(0, synth.client_hello([0x0303], [suite]))], [(0, synth.server_hello(0x0303, suite) + _record(22, _message(12, body)))], 0, 0)
        assert {k: f[k] for k in ("dh_bits", "group", "share") if k in f} == want and not f["degraded"]


def test_alerts():
    f = tls.analyse([(0, synth.client_hello([0x0303], [0xC02F]))], [(0, _record(21, b"\2\x28"))], 0, 0)
    assert f["alerts"] == [{"direction": "s", "offset": 0, "encrypted": False, "level": "FATAL", "description": "handshake_failure"}] and f["fatal_alert"]
    assert tls.alert(b"\x09\xfe") == (None, None) and tls.alert(b"x") == (None, None)


@pytest.fixture(scope="module")
def authority(tmp_path_factory):
    """A root, an intermediate and leaves signed by openssl, as DER; rsa and ec."""
    home = tmp_path_factory.mktemp("ca")
    run = lambda *a: subprocess.run(["openssl", *a], cwd=home, check=True, capture_output=True)  # noqa: S603, S607
    try:
        run("version")
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("openssl isn't there to sign certificates")
    (home / "ca.ext").write_text("basicConstraints=critical,CA:TRUE\nkeyUsage=keyCertSign\n")
    (home / "leaf.ext").write_text("subjectAltName=DNS:mail.example\nextendedKeyUsage=serverAuth\n")
    (home / "plain.ext").write_text("basicConstraints=CA:FALSE\nsubjectAltName=DNS:mail.example\n")

    def key(name, kind):
        run(*(["genrsa", "-out", f"{name}.key", "2048"] if kind == "rsa" else ["ecparam", "-name", "prime256v1" if kind == "ec" else "secp384r1", "-genkey", "-noout", "-out", f"{name}.key"]))

    def made(name, kind, issuer, ext, days=20_000):
        key(name, kind)
        run("req", "-new", "-key", f"{name}.key", "-subj", f"/CN={name}", "-out", f"{name}.csr")
        by = ["-signkey", f"{name}.key"] if issuer is None else ["-CA", f"{issuer}.pem", "-CAkey", f"{issuer}.key", "-set_serial", "7"]
        run("x509", "-req", "-in", f"{name}.csr", *by, "-days", str(days), "-sha256", "-extfile", ext, "-out", f"{name}.pem")
        run("x509", "-in", f"{name}.pem", "-outform", "DER", "-out", f"{name}.der")
        return (home / f"{name}.der").read_bytes()

    ders = {"root": made("root", "rsa", None, "ca.ext"), "middle": made("middle", "ec", "root", "ca.ext"), "leaf": made("leaf", "ec384", "middle", "leaf.ext"), "other": made("other", "rsa", None, "ca.ext"), "plain": made("plain", "rsa", "root", "plain.ext"), "below": made("below", "rsa", "plain", "leaf.ext")}
    return home, ders


def test_signatures(authority):
    _, d = authority
    assert signed_by(d["middle"], d["root"]) is True and signed_by(d["leaf"], d["middle"]) is True and signed_by(d["root"], d["root"]) is True
    assert signed_by(d["middle"], d["other"]) is False and signed_by(d["leaf"], d["leaf"]) is False
    broken = bytearray(d["leaf"])
    broken[-1] ^= 1
    assert signed_by(bytes(broken), d["middle"]) in (False, None) and signed_by(d["leaf"][:50], d["middle"]) is None
    assert x509.parse(d["root"])["is_ca"] and x509.parse(d["root"])["may_sign"] and not x509.parse(d["plain"])["is_ca"] and x509.parse(d["leaf"])["names"] == ["mail.example"]


def _with_chain(ders):
    body = b"".join(len(x).to_bytes(3, "big") + x for x in ders)
    turns = synth.smtp_starttls(0x0303, 0xC02B)
    who, hello = turns[-1]
    message = _message(11, len(body).to_bytes(3, "big") + body)
    parts = [hello, *[_record(22, message[i : i + 1400]) for i in range(0, len(message), 1400)]]
    return [*turns[:-1], *[(who, p) for p in parts]]


def test_chains_of_captures(spark, tmp_path, authority):
    home, d = authority
    status = {}
    late = 1_900_000_000 * 10**9
    for name, shown in {"whole": ["leaf", "middle"], "alone": ["leaf"], "unsigned": ["leaf", "middle"], "notca": ["below", "plain"], "double": ["leaf", "other", "middle", "root"]}.items():
        frames = synth.conversation(C, S, _with_chain([d[x] for x in shown]))
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.pcap").write_bytes(synth.pcap(frames, start_ns=late))
        store = str(home / ("other.pem" if name == "unsigned" else "root.pem"))
        r = sessions.analyse_captures(spark, str(folder / "a.pcap"), trust_store=store)
        x = r.first()
        status[name] = (x["chain_status"], x["chain_reason"])
        outcome = {y["rule_id"]: y["outcome"] for y in rules.evaluate(r).collect()}["CERT-005"]
        assert outcome == {"PASSED": "PASS", "FAILED": "FAIL"}[x["chain_status"]] and len(x["certificate_packets"]) >= 1
        rows = chains.inventory(r).orderBy("position").collect()
        assert [c["subject"] for c in rows] == [f"CN={s}" for s in shown] and {c["at_capture"] for c in rows} == {"VALID"} and rows[0]["packets"] == x["certificate_packets"]
    assert status == {"whole": ("PASSED", None), "alone": ("FAILED", "INCOMPLETE"), "unsigned": ("FAILED", "INCOMPLETE"), "notca": ("FAILED", "INVALID"), "double": ("PASSED", None)}
    early = sessions.analyse_captures(spark, str(tmp_path / "whole" / "a.pcap"), trust_store=str(home / "root.pem"))
    moved = early.withColumn("first_ns", chains.F.lit(10**18).cast("long")).drop("chain_status", "chain_reason")
    anchors, info = chains.trust_store(spark, str(home / "root.pem"))
    assert chains.with_chain_status(moved, anchors, True).first()["chain_reason"] == "EXPIRED"  # before all windows
    assert info["configured"] and info["anchor_count"] == 1 and info["anchor_set_digest"] == hashlib.sha256(hashlib.sha256(d["root"]).hexdigest().encode()).hexdigest()[:32]


def test_a_missing_store_is_none_with_a_reason(spark, tmp_path):
    (tmp_path / "broken.pem").write_text("-----BEGIN CERTIFICATE-----\nAAAA\n-----END CERTIFICATE-----\n")
    (tmp_path / "empty.pem").write_text("nothing")
    for path in ("missing.pem", "broken.pem", "empty.pem"):
        anchors, info = chains.trust_store(spark, str(tmp_path / path))
        assert not info["configured"] and info["error"] and anchors.count() == 0
    assert chains.trust_store(spark, None)[1]["error"] is None
