"""Deterministic captures for tests and measurements: mail sessions with known facts, as pcap or pcapng bytes."""

from __future__ import annotations

import random
import struct

FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16


def packet(src: tuple[str, int], dst: tuple[str, int], seq: int, ack: int, flags: int, payload: bytes = b"") -> bytes:
    """An Ethernet frame with IPv4 and TCP."""
    tcp = struct.pack(">HHIIBBHHH", src[1], dst[1], seq % 2**32, ack % 2**32, 5 << 4, flags, 65535, 0, 0) + payload
    address = lambda ip: bytes(int(x) for x in ip.split("."))
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0) + address(src[0]) + address(dst[0])
    frame = b"\x02\0\0\0\0\1\x02\0\0\0\0\2\x08\x00" + ip + tcp
    return frame + b"\0" * max(0, 60 - len(frame))


def conversation(client: tuple[str, int], server: tuple[str, int], turns: list[tuple[str, bytes]], close: bool = True, isn: int = 1000) -> list[bytes]:
    """Handshake, turns ("c" or "s", bytes) and a close."""
    seq = {"c": isn, "s": isn * 7}
    out = []

    def send(who, flags, payload=b""):
        a, b = (client, server) if who == "c" else (server, client)
        other = "s" if who == "c" else "c"
        out.append(packet(a, b, seq[who], seq[other] if flags & ACK else 0, flags, payload))
        seq[who] += len(payload) + bool(flags & (SYN | FIN))

    send("c", SYN)
    send("s", SYN | ACK)
    send("c", ACK)
    for who, payload in turns:
        send(who, PSH | ACK, payload)
    if close:
        send("c", FIN | ACK)
        send("s", FIN | ACK)
    return out


def pcap(packets: list[bytes], start_ns: int = 1_700_000_000_000_000_000, step_ns: int = 1_000_000, link: int = 1) -> bytes:
    out = [struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 262144, link)]
    for i, p in enumerate(packets):
        t = start_ns + i * step_ns
        out.append(struct.pack("<IIII", t // 10**9, t % 10**9, len(p), len(p)) + p)
    return b"".join(out)


def pcapng(packets: list[bytes], start_ns: int = 1_700_000_000_000_000_000, step_ns: int = 1_000_000) -> bytes:
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    out = [block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)), block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3xHH", 9, 1, 9, 0, 0))]
    for i, p in enumerate(packets):
        t = start_ns + i * step_ns
        out.append(block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(p), len(p)) + p + b"\0" * (-len(p) % 4)))
    return b"".join(out)


def client_hello(versions: list[int], suites: list[int], name: str | None = "mail.example") -> bytes:
    ext = b""
    if name:
        raw = name.encode()
        ext += struct.pack(">HHHBH", 0, len(raw) + 5, len(raw) + 3, 0, len(raw)) + raw
    if versions:
        v = b"".join(struct.pack(">H", x) for x in versions)
        ext += struct.pack(">HHB", 43, len(v) + 1, len(v)) + v
    s = b"".join(struct.pack(">H", x) for x in suites)
    body = b"\x03\x03" + b"\x11" * 32 + b"\0" + struct.pack(">H", len(s)) + s + b"\1\0" + struct.pack(">H", len(ext)) + ext
    return _handshake(1, body)


def server_hello(version: int, suite: int, selected: int | None = None) -> bytes:
    ext = struct.pack(">HHH", 43, 2, selected) if selected else b""
    return _handshake(2, struct.pack(">H", version) + b"\x22" * 32 + b"\0" + struct.pack(">HB", suite, 0) + struct.pack(">H", len(ext)) + ext)


def _handshake(kind: int, body: bytes) -> bytes:
    message = bytes([kind]) + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(message)) + message


def smtp_starttls(version: int = 0x0303, suite: int = 0xC02F, auth_first: bool = False) -> list[tuple[str, bytes]]:
    turns = [("s", b"220 mail ready\r\n"), ("c", b"EHLO x\r\n"), ("s", b"250-mail\r\n250-STARTTLS\r\n250 AUTH PLAIN\r\n")]
    if auth_first:
        turns += [("c", b"AUTH PLAIN AGEAYg==\r\n"), ("s", b"235 ok\r\n")]
    turns += [("c", b"STARTTLS\r\n"), ("s", b"220 go\r\n"), ("c", client_hello([version], [suite, 0x002F])), ("s", server_hello(0x0303 if version > 0x0303 else version, suite, version if version > 0x0303 else None))]
    return turns


def mail_capture(sessions: int, seed: int = 1) -> bytes:
    """A capture of interleaved sessions: STARTTLS with several versions, refusals, plaintext logins, IMAP and POP3."""
    rng = random.Random(seed)
    lanes = []
    for i in range(sessions):
        client, port, kind = (f"10.{i >> 16 & 255}.{i >> 8 & 255}.{i & 255}", 40000 + i % 20000), 25, i % 5
        server = (f"192.0.2.{1 + i % 40}", port)
        if kind == 0:
            turns = smtp_starttls(0x0303, 0xC02F)
        elif kind == 1:
            turns = smtp_starttls(0x0301, 0x000A, auth_first=True)
        elif kind == 2:
            turns = [("s", b"220 mail\r\n"), ("c", b"EHLO x\r\n"), ("s", b"250-mail\r\n250 STARTTLS\r\n"), ("c", b"STARTTLS\r\n"), ("s", b"502 no\r\n"), ("c", b"MAIL FROM:<a@b>\r\n"), ("s", b"250 ok\r\n"), ("c", b"QUIT\r\n"), ("s", b"221 bye\r\n")]
        elif kind == 3:
            server = (server[0], 143)
            turns = [("s", b"* OK ready\r\n"), ("c", b"a1 CAPABILITY\r\n"), ("s", b"* CAPABILITY IMAP4rev1 STARTTLS\r\na1 OK done\r\n"), ("c", b"a2 LOGIN bob secret\r\n"), ("s", b"a2 OK in\r\n"), ("c", b"a3 LOGOUT\r\n"), ("s", b"* BYE\r\na3 OK bye\r\n")]
        else:
            server = (server[0], 110)
            turns = [("s", b"+OK pop\r\n"), ("c", b"CAPA\r\n"), ("s", b"+OK\r\nSTLS\r\nUSER\r\n.\r\n"), ("c", b"USER bob\r\n"), ("s", b"+OK\r\n"), ("c", b"PASS x\r\n"), ("s", b"+OK\r\n"), ("c", b"QUIT\r\n"), ("s", b"+OK bye\r\n")]
        lanes.append(conversation(client, server, turns, isn=1000 + i))
    out = []
    while lanes:
        lane = rng.randrange(len(lanes))
        out.append(lanes[lane].pop(0))
        if not lanes[lane]:
            lanes[lane] = lanes[-1]
            lanes.pop()
    return pcap(out)


def generated(spark, captures: int, sessions: int):
    """Frames of generated captures as read_captures gives them, made by the executors; no file is written."""
    import hashlib
    import io

    from .capture import COLUMNS, FRAMES, frames

    def make(batches):
        import pandas as pd

        for b in batches:
            for seed in b["id"]:
                data = mail_capture(sessions, int(seed))
                digest = "sha256:" + hashlib.sha256(data).hexdigest()
                yield pd.DataFrame([(digest, f"generated-{seed}", *row, None) for row in frames(io.BytesIO(data))], columns=COLUMNS)

    return spark.range(captures).repartition(min(captures, 64)).mapInPandas(make, "capture_id string, " + FRAMES + ", error string")
