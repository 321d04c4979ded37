"""pcap and pcapng as a Spark data source, and frames as TCP packets.

Frames are yielded one at a time, so memory is that of one frame whatever the
file's size. Damage ends a scan with truncated set, it never raises; a file that is no capture raises at open.
A file that all executors can open is split: one pass finds where records begin and what a reader must know there, and ranges of it are
read by tasks of their own. From stores that only Spark reads a file comes whole, as one row of at most 2 GiB.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAMES = "path string, packet_number long, ts_ns long, data binary, orig_len long, link_type int, iface int, truncated boolean"
#: Fixed values of the two file formats.
PCAP = {b"\xa1\xb2\xc3\xd4": (">", 1000), b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1)}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6


class NotACapture(ValueError):
    """The bytes are empty or begin like no capture format."""


def format_of(head: bytes) -> str:
    """pcap or pcapng by the first bytes; names aren't looked at."""
    if not head:
        raise NotACapture("empty file")
    if head[:4] in PCAP:
        return "pcap"
    if head[:4] == b"\x0a\x0d\x0d\x0a" and head[8:12] in (b"\x1a\x2b\x3c\x4d", b"\x4d\x3c\x2b\x1a"):
        return "pcapng"
    raise NotACapture(f"unknown magic {head[:4].hex()}")


def opened(stream) -> tuple:
    """(scan, offset of the first record, what a scan must know there): scan(stream, offset, known, most) yields (offset, packet) for every packet, and a packet None where the file ends in the middle of one.

    known is None if even the header is cut.
    """
    head = stream.read(24)
    if format_of(head) == "pcapng":
        stream.seek(0)
        return _pcapng, 0, ("<", ())
    order, tick = PCAP[head[:4]]
    known = (order, tick, struct.unpack(order + "I", head[20:24])[0] & 0x0FFFFFFF) if len(head) == 24 else None
    return _pcap, 24, known


def frames(stream, max_packets: int = 1 << 40, max_packet_bytes: int = 262_144) -> Iterator[tuple]:
    """(packet_number, ts_ns, data, orig_len, link_type, iface, truncated); a last row without number and data says that the scan ended early."""
    scan, at, known = opened(stream)
    yield from _numbered(scan(stream, at, known, max_packet_bytes) if known else iter([(at, None, None)]), 0, max_packets, None)


def _numbered(found: Iterator[tuple], number: int, max_packets: int, stop: int | None) -> Iterator[tuple]:
    """Rows of frames() for the packets that begin before the offset stop; number: packets before them."""
    if number > max_packets:
        return
    for offset, item, _ in found:
        if stop is not None and offset >= stop:
            return
        if item is None or number == max_packets:
            yield None, None, None, None, None, None, True
            return
        number += 1
        yield number, *item, False


def _pcap(stream, at, known, most):
    order, tick, link = known
    while record := stream.read(16):
        start = at
        if len(record) < 16:
            yield start, None, known
            return
        sec, frac, size, original = struct.unpack(order + "IIII", record)
        data = stream.read(size) if size <= most else b""
        if len(data) < size:
            yield start, None, known
            return
        at += 16 + size
        yield start, (sec * 1_000_000_000 + frac * tick, data, original, link, 0), known


def _pcapng(stream, at, known, most):
    order, links = known
    while begin := stream.read(8):
        start = at
        if len(begin) < 8:
            yield start, None, (order, links)
            return
        extra = b""
        kind = struct.unpack(order + "I", begin[:4])[0]
        if begin[:4] == b"\x0a\x0d\x0d\x0a":
            extra = stream.read(4)
            order, kind, links = ("<" if extra == b"\x4d\x3c\x2b\x1a" else ">"), SECTION, ()
        size = struct.unpack(order + "I", begin[4:8])[0]
        if size < 12 or size % 4 or size > most + 4096:
            yield start, None, (order, links)
            return
        body = extra + stream.read(size - 8 - len(extra))
        if len(body) < size - 8:
            yield start, None, (order, links)
            return
        at += size
        body = body[:-4]
        before = order, links
        if kind == INTERFACE and len(body) >= 8:
            links = (*links, (struct.unpack(order + "H", body[:2])[0], struct.unpack(order + "I", body[4:8])[0], _resolution(body[8:], order)))
        elif kind == ENHANCED and len(body) >= 20:
            iface, high, low, size, original = struct.unpack(order + "IIIII", body[:20])
            if iface < len(links) and size <= len(body) - 20:  # a bad block is skipped and takes no number
                per_second = links[iface][2]
                ticks = high << 32 | low
                yield start, (ticks * 1_000_000_000 // per_second, body[20 : 20 + size], original, links[iface][0], iface), before
        elif kind == SIMPLE and len(body) >= 4 and links:
            original = struct.unpack(order + "I", body[:4])[0]
            size = min(original, links[0][1] or original, len(body) - 4)
            yield start, (0, body[4 : 4 + size], original, links[0][0], 0), before


def _resolution(options: bytes, order: str) -> int:
    """Ticks a second from if_tsresol, or a million."""
    while len(options) >= 4:
        code, size = struct.unpack(order + "HH", options[:4])
        if code == 9 and size >= 1:
            v = options[4]
            return 1 << (v & 0x7F) if v & 0x80 else 10**v
        if code == 0:
            break
        options = options[4 + (size + 3) // 4 * 4 :]
    return 1_000_000


#: Bytes of a file that one task reads.
SPLIT = 128 << 20


def ranges(stream, split: int = SPLIT, max_packet_bytes: int = 262_144) -> tuple[list[tuple], dict]:
    """(start, stop, packets before, what a scan must know) of stretches of about split bytes that cut no record, and how the file ended: packets, ended (COMPLETE or TRUNCATED), offset.

    The file is read once, record by record; only the stretches are kept.
    """
    scan, at, known = opened(stream)
    cuts, number, last = [(at, 0, known)], 0, at
    if known is None:
        return [], {"packets": 0, "ended": "TRUNCATED", "offset": 0}
    ended, end = "COMPLETE", at
    for offset, item, now in scan(stream, at, known, max_packet_bytes):
        if item is None:
            ended, end = "TRUNCATED", offset
            break
        if offset - last >= split:
            cuts.append((offset, number, now))
            last = offset
        number += 1
    stops = [c[0] for c in cuts[1:]] + [None]
    return [(start, stop, before, now) for (start, before, now), stop in zip(cuts, stops, strict=True)], {"packets": number, "ended": ended, "offset": end if ended == "TRUNCATED" else None}


def frames_of(stream, start: int, stop: int | None, before: int, known, max_packets: int = 1 << 40, max_packet_bytes: int = 262_144) -> Iterator[tuple]:
    """What frames() gives for one of ranges()."""
    scan, _, _ = opened(stream)
    stream.seek(start)
    yield from _numbered(scan(stream, start, known, max_packet_bytes), before, max_packets, stop)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None, before: int, known):
        self.path, self.start, self.stop, self.before, self.known = path, start, stop, before, known


class CaptureReader(DataSourceReader):
    """Options: paths, max_packets and split (bytes of a task)."""

    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.most = int(options.get("max_packets", 1 << 40))
        self.split = int(options.get("split", SPLIT))

    def partitions(self):
        found = []
        for p in self.paths:
            with open(p, "rb") as stream:
                cut, _ = ranges(stream, self.split)
            found += [_Range(p, *x) for x in cut] or [_Range(p, 0, None, 0, None)]
        return found

    def read(self, partition):
        with open(partition.path, "rb") as stream:
            x = partition
            rows = frames(stream, self.most) if x.known is None else frames_of(stream, x.start, x.stop, x.before, x.known, self.most)
            for row in rows:
                yield (partition.path, *row)


INDEXED = "path string, capture_id string, start long, stop long, before long, known string, packets long, ended string, ended_at long, error string"


def index_captures(spark, paths: list[str], split: int = SPLIT) -> DataFrame:
    """A row for every range of every file, in tasks of their own for each file: what read_ranges needs, the digest of the whole file, and how it ended.

    A file that can't be opened or is no capture is one row with error set, so others go on.
    """
    import hashlib
    import json

    def indexed(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    with open(path, "rb") as stream:
                        digest = "sha256:" + hashlib.file_digest(stream, "sha256").hexdigest()
                        stream.seek(0)
                        cut, end = ranges(stream, split)
                    rows += [(path, digest, *x[:3], json.dumps(x[3]), end["packets"], end["ended"], end["offset"], None) for x in cut or [(0, None, 0, None)]]
                except (OSError, NotACapture) as e:
                    rows.append((path, None, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEXED.split(", ")], dtype=object)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInPandas(indexed, INDEXED)


def read_ranges(index: DataFrame, max_packets: int = 1 << 40) -> DataFrame:
    """Frames of all ranges of index (see index_captures; written or cached), each read by itself: the columns of read_captures."""
    import json

    schema = "capture_id string, " + FRAMES + ", error string"

    def scan(batches):
        import pandas as pd

        for b in batches:
            for x in b.to_dict("records"):
                rows = []
                if x["error"] is not None:
                    rows.append((None, x["path"], *[None] * 6, False, x["error"]))
                else:
                    with open(x["path"], "rb") as stream:
                        known = json.loads(x["known"])
                        stop = None if pd.isna(x["stop"]) else int(x["stop"])
                        found = frames(stream, max_packets) if known is None else frames_of(stream, int(x["start"]), stop, int(x["before"]), known, max_packets)
                        for row in found:
                            rows.append((x["capture_id"], x["path"], *row, None))
                            if len(rows) == 2000:
                                yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)
                                rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)

    # by path and place, so that the ranges of one large file go to many tasks
    return index.repartition("path", "start").mapInPandas(scan, schema)


class CaptureSource(DataSource):
    """spark.read.format("capture").load("a.pcap") or option("paths", "a.pcap,b.pcapng"): for files that every executor can open."""

    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return CaptureReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(CaptureSource)


def read_captures(spark, glob: str, max_packets: int = 1 << 40) -> DataFrame:
    """Frames of all files that match, from any store that Spark reads: capture_id (SHA-256 of the file), path and the columns of FRAMES.

    A file that is no capture gives one row with error set and nothing else, so others go on.
    """
    import io

    schema = "capture_id string, " + FRAMES + ", error string"

    def scan(batches):
        import pandas as pd

        for b in batches:
            for path, content, digest in zip(b["path"], b["content"], b["capture_id"], strict=True):
                rows = []
                try:
                    for row in frames(io.BytesIO(content), max_packets):
                        rows.append((digest, path, *row, None))
                        if len(rows) == 2000:
                            yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)
                            rows = []
                except NotACapture as e:
                    rows.append((digest, path, *[None] * 6, False, str(e)))
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)

    files = spark.read.format("binaryFile").load(glob)
    return files.select("path", "content", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("capture_id")).mapInPandas(scan, schema)


COLUMNS = ["capture_id", "path", "packet_number", "ts_ns", "data", "orig_len", "link_type", "iface", "truncated", "error"]


EXTENSIONS = (0, 43, 60)
DISSECTED = "outcome string, src string, dst string, src_port int, dst_port int, seq long, ack long, flags int, payload binary, payload_len long, cut boolean"


def strip_link(data: bytes, link: int) -> int | None:
    """Where the IP header begins, or null for a link type that isn't known."""
    if link == 1:
        at = 12
        while data[at : at + 2] in (b"\x81\x00", b"\x88\xa8"):
            at += 4
        return at + 2
    return {0: 4, 108: 4, 113: 16, 276: 20, 12: 0, 101: 0, 228: 0, 229: 0}.get(link)


def dissect_frame(data: bytes, link: int) -> tuple:
    """(outcome, src, dst, src_port, dst_port, seq, ack, flags, payload, payload_len, cut): nulls unless the outcome is TCP.

    Fragments are refused, and the IP length bounds the payload, so Ethernet padding never enters it.
    """
    none = (None,) * 10
    at = strip_link(data, link)
    if at is None:
        return ("UNSUPPORTED_LINK_TYPE", *none)
    ip = data[at:]
    version = ip[0] >> 4 if ip else 0
    if version == 4:
        if len(ip) < 20 or (head := (ip[0] & 15) * 4) < 20:
            return ("MALFORMED", *none)
        total, proto, fragment = int.from_bytes(ip[2:4], "big"), ip[9], int.from_bytes(ip[6:8], "big") & 0x3FFF
        src, dst = (".".join(map(str, x)) for x in (ip[12:16], ip[16:20]))
    elif version == 6:
        if len(ip) < 40:
            return ("MALFORMED", *none)
        total, proto, head, fragment = 40 + int.from_bytes(ip[4:6], "big"), ip[6], 40, 0
        while proto in EXTENSIONS and len(ip) >= head + 2:
            proto, head = ip[head], head + (ip[head + 1] + 1) * 8
        fragment = proto == 44
        src, dst = (":".join(x[i : i + 2].hex() for i in range(0, 16, 2)) for x in (ip[8:24], ip[24:40]))
    else:
        return ("NOT_IP", *none)
    if fragment:
        return ("IP_FRAGMENT", *none)
    if proto != 6:
        return ("NOT_TCP", *none)
    t = ip[head:]
    if len(t) < 20 or (size := (t[12] >> 4) * 4) < 20 or (declared := total - head - size) < 0:
        return ("MALFORMED", *none)
    sp, dp, seq, ack = struct.unpack(">HHII", t[:12])
    payload = t[size : size + declared]
    return "TCP", src, dst, sp, dp, seq, ack, t[13], payload, declared, len(payload) < declared


def dissect(rows: DataFrame) -> DataFrame:
    """rows of frames with the columns of DISSECTED; data itself is left out. The row that ends a scan has the outcome END."""
    import pandas as pd

    keep = [f for f in rows.schema.fields if f.name != "data"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", " + DISSECTED

    def cut(batches):
        for b in batches:
            made = [dissect_frame(d, k) if d is not None else ("END", *(None,) * 10) for d, k in zip(b["data"], b["link_type"], strict=True)]
            new = pd.DataFrame(made, columns=[x.split()[0] for x in DISSECTED.split(", ")], dtype=object)
            yield pd.concat([b.drop(columns="data").reset_index(drop=True), new], axis=1)

    return rows.mapInPandas(cut, schema)
