"""TCP sessions of one flow: split at new connections, bytes put together where the first observed wins, holes reported.

A flow's packets come sorted by number. Nothing here crosses a hole: runs are separate byte strings.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

FIN, SYN, RST, ACK = 1, 2, 4, 16
SERVICES = {25: "SMTP", 465: "SMTPS", 587: "SMTP", 143: "IMAP", 993: "IMAPS", 110: "POP3", 995: "POP3S"}
HALF = 1 << 31
#: Records of disagreeing segments that a direction keeps; their number is counted without a limit.
CONFLICTS = 1000


def _join(spans: list[tuple[int, int]], a: int, b: int) -> None:
    """Add a span, to the last one where they touch, so a long row of packets stays one span."""
    if spans and spans[-1][0] <= a <= spans[-1][1]:
        spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
    else:
        spans.append((a, b))


@dataclass
class Stream:
    """One direction. offsets count from the first byte after SYN, or from the first byte seen."""

    base: int | None = None
    high: int = 0
    starts: list[int] = field(default_factory=list)
    parts: dict[int, tuple[bytes, int]] = field(default_factory=dict)  # start: bytes, packet
    seen: set = field(default_factory=set)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("segments", "ACCEPTED", "PARTIAL_OVERLAP", "CONFLICTING_OVERLAP", "DUPLICATE", "RETRANSMISSION", "DROPPED_LIMIT", "out_of_order"), 0))
    uncaptured: list[tuple[int, int]] = field(default_factory=list)
    refused: list[tuple[int, int]] = field(default_factory=list)
    disagreed: list[tuple[int, int]] = field(default_factory=list)
    conflicts: list[dict] = field(default_factory=list)
    acked: int | None = None
    fin: bool = False

    def extend(self, seq: int) -> int:
        """A 32-bit number as the nearest one to the highest so far."""
        if self.base is None:
            self.base = self.high = seq
        step = (seq - self.high) % (1 << 32)
        return self.high + (step - (1 << 32) if step >= HALF else step)

    def syn(self, seq: int) -> None:
        if self.base is None:
            self.base = self.high = seq + 1

    def add(self, seq: int, payload: bytes, declared: int, packet: int, grant) -> None:
        start = self.extend(seq)
        end = start + len(payload)
        if declared > len(payload):
            _join(self.uncaptured, end, start + declared)
        if not declared:
            return
        self.counts["segments"] += 1
        behind = start + declared <= self.high and self.high > self.base
        self.high = max(self.high, start + declared)
        new, conflict, covered, at = [], False, 0, start
        i = max(0, bisect.bisect_right(self.starts, start) - 1)
        for s in self.starts[i:]:
            if s >= end:
                break
            held = self.parts[s][0]
            a, b = max(start, s), min(end, s + len(held))
            if a >= b:
                continue
            kept, came = held[a - s : b - s], payload[a - start : b - start]
            if kept != came:
                conflict = True
                _join(self.disagreed, a, b)
                if len(self.conflicts) < CONFLICTS:
                    digests = {"accepted_sha256": hashlib.sha256(kept).hexdigest(), "conflicting_sha256": hashlib.sha256(came).hexdigest()}
                    self.conflicts.append({"offset": a, "length": b - a, "accepted_packet": self.parts[s][1], "conflicting_packet": packet} | digests)
            covered += b - a
            if at < a:
                new.append((at, a))
            at = max(at, b)
        if at < end:
            new.append((at, end))
        stored = 0
        for a, b in new:
            size = grant(b - a)
            if size < b - a:
                _join(self.refused, a + size, b)
            if size:
                bisect.insort(self.starts, a)
                self.parts[a] = (payload[a - start : a - start + size], packet)
                stored += size
        key = (start, len(payload))  # what doesn't conflict and is covered has the stored bytes
        if conflict:
            kind = "CONFLICTING_OVERLAP"
        elif not new:
            kind = "DUPLICATE" if key in self.seen else "RETRANSMISSION"
        elif not stored:
            kind = "DROPPED_LIMIT"
        else:
            kind = "PARTIAL_OVERLAP" if covered else "ACCEPTED"
        if kind not in ("CONFLICTING_OVERLAP", "DROPPED_LIMIT"):  # these can never be covered without conflict later
            self.seen.add(key)
        self.counts[kind] += 1
        self.counts["out_of_order"] += bool(behind and stored)

    def origin(self) -> int:
        """The number at which offsets begin."""
        return min([self.base or 0, *self.starts[:1]])

    def carriers(self, start: int, end: int) -> list[int]:
        """Sorted numbers of the packets that brought the bytes from offset start to end; an empty range stands for its first byte."""
        start, end = start + self.origin(), max(end, start + 1) + self.origin()
        found = set()
        for s in self.starts[max(0, bisect.bisect_right(self.starts, start) - 1) :]:
            if s >= end:
                break
            data, packet = self.parts[s]
            if s + len(data) > start:
                found.add(packet)
        return sorted(found)

    def ambiguous(self, start: int, end: int) -> bool:
        """Whether segments disagreed on a byte from offset start to end."""
        origin = self.origin()
        return any(a < end + origin and start + origin < b for a, b in self.disagreed)

    def conflict_records(self) -> list[dict]:
        return [x | {"offset": x["offset"] - self.origin()} for x in self.conflicts]

    def acked_missing(self) -> int:
        """Bytes that the peer acknowledged beyond the last one captured."""
        if self.acked is None or not (self.starts or self.uncaptured):
            return 0
        return max(0, self.acked - self.fin - self.high)

    def runs(self) -> list[tuple[int, bytes]]:
        """(offset, bytes) of every stretch without a hole."""
        out: list[tuple[int, list[bytes], int]] = []
        for s in self.starts:
            data = self.parts[s][0]
            if out and out[-1][2] == s:
                out[-1] = (out[-1][0], [*out[-1][1], data], s + len(data))
            else:
                out.append((s, [data], s + len(data)))
        origin = self.origin()
        return [(s - origin, b"".join(p)) for s, p, _ in out]

    def gaps(self) -> list[tuple[int, int, str]]:
        """(offset, length, reason): NOT_CAPTURED before LIMIT_EXCEEDED before MISSING_SEGMENT."""
        origin = self.origin()
        at, holes = origin, []
        for o, data in self.runs():
            if o + origin > at:
                holes.append((at, o + origin))
            at = o + origin + len(data)
        last = max([self.high, *(b for _, b in self.uncaptured)], default=at)
        if last > at and (self.starts or self.uncaptured):
            holes.append((at, last))
        meets = lambda xs, a, b: any(x < b and a < y for x, y in xs)
        return [(a - origin, b - a, "NOT_CAPTURED" if meets(self.uncaptured, a, b) else "LIMIT_EXCEEDED" if meets(self.refused, a, b) else "MISSING_SEGMENT") for a, b in holes]


@dataclass
class Session:
    instance: int
    first: dict
    last: dict
    client: tuple[str, int]
    server: tuple[str, int]
    basis: str
    packets: int = 0
    syn: int | None = None
    syn_ack: bool = False
    handshake: bool = False
    rst: bool = False
    fins: set = field(default_factory=set)
    payload: bool = False
    streams: dict[str, Stream] = field(default_factory=lambda: {"c": Stream(), "s": Stream()})

    def closed(self) -> bool:
        return self.rst or len(self.fins) == 2

    def facts(self) -> dict:
        gaps = {w: s.gaps() for w, s in self.streams.items()}
        cut = any(s.uncaptured for s in self.streams.values())
        notes = sum(len(g) for g in gaps.values()) + sum(s.counts["CONFLICTING_OVERLAP"] for s in self.streams.values()) + (not self.handshake) + (not self.closed())
        complete = "TRUNCATED" if cut else "MIDSTREAM" if self.syn is None and not self.syn_ack else "PARTIAL" if notes else "COMPLETE"
        ended = "RESET" if self.rst else {2: "FIN_BOTH", 1: "FIN_ONE", 0: "NOT_OBSERVED"}[len(self.fins)]
        return {"completeness": complete, "termination": ended, "gaps": gaps, "runs": {w: s.runs() for w, s in self.streams.items()}}


def sessions_of(packets, budget: int = 16 << 20) -> list[Session]:
    """packets: dicts of one flow, by packet_number. budget: bytes kept for a session, the rest becomes LIMIT_EXCEEDED."""
    return list(walked(packets, budget))


def walked(packets, budget: int = 16 << 20) -> Iterator[Session]:
    """The sessions of sessions_of, each as soon as the next one begins; packets are read once and not kept."""
    s: Session | None = None
    left = 0
    for p in packets:
        flags, src, dst = p["flags"], (p["src"], p["src_port"]), (p["dst"], p["dst_port"])
        bare = flags & SYN and not flags & ACK
        if s is None or bare and (s.syn is None or s.syn != p["seq"] or s.payload or s.closed() or s.fins):
            if bare:
                client, server, basis = src, dst, "SYN"
            elif flags & SYN:
                client, server, basis = dst, src, "SYN_ACK"
            elif (src[1] in SERVICES) != (dst[1] in SERVICES):
                client, server, basis = (dst, src, "SERVICE_PORT") if src[1] in SERVICES else (src, dst, "SERVICE_PORT")
            else:
                client, server, basis = src, dst, "FIRST_SENDER"
            if s is not None:
                yield s
            s = Session(s.instance + 1 if s else 1, p, p, client, server, basis)
            left = budget
        who = "c" if src == s.client else "s"
        stream, other = s.streams[who], s.streams["s" if who == "c" else "c"]
        s.packets += 1
        s.last = p
        if flags & SYN:
            stream.syn(p["seq"])
            if who == "c":
                s.syn = p["seq"] if s.syn is None else s.syn
            else:
                s.syn_ack = True
        elif flags & ACK and who == "c" and s.syn_ack:
            s.handshake = True
        if flags & ACK and other.base is not None:
            other.acked = max(other.acked or 0, other.extend(p["ack"]))

        def grant(n: int) -> int:
            nonlocal left
            got = max(0, min(n, left))
            left -= got
            return got

        if p["payload_len"]:
            s.payload = True
            stream.add(p["seq"] + bool(flags & SYN), p["payload"], p["payload_len"], p["packet_number"], grant)
        if flags & FIN:
            s.fins.add(who)
            stream.fin = True
        s.rst |= bool(flags & RST)
    if s is not None:
        yield s
