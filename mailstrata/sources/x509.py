"""The parts of an X.509 certificate that assessments look at, by a walk over its DER."""

from __future__ import annotations

import hashlib
from datetime import UTC, datetime

# Object identifiers.
KEYS = {"1.2.840.113549.1.1.1": "RSA", "1.2.840.10045.2.1": "EC", "1.2.840.10040.4.1": "DSA", "1.3.101.112": "ED25519", "1.3.101.113": "ED448"}
CURVES = {"1.2.840.10045.3.1.7": 256, "1.3.132.0.34": 384, "1.3.132.0.35": 521, "1.3.132.0.33": 224, "1.2.840.10045.3.1.1": 192}
SIGNATURES = {"1.2.840.113549.1.1.4": "md5", "1.2.840.113549.1.1.5": "sha1", "1.2.840.113549.1.1.11": "sha256", "1.2.840.113549.1.1.12": "sha384", "1.2.840.113549.1.1.13": "sha512", "1.2.840.10045.4.1": "sha1", "1.2.840.10045.4.3.2": "sha256", "1.2.840.10045.4.3.3": "sha384", "1.2.840.10045.4.3.4": "sha512"}
NAMES = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU"}
SERVER_AUTH, EKU, SAN, BASIC, USAGE = "1.3.6.1.5.5.7.3.1", "2.5.29.37", "2.5.29.17", "2.5.29.19", "2.5.29.15"


def items(data: bytes):
    """(tag, content, whole) of each element; what overruns raises ValueError."""
    at = 0
    while at < len(data):
        start, tag = at, data[at]
        if at + 2 > len(data):
            raise ValueError("DER overrun")
        size, at = data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            raise ValueError("DER overrun")
        yield tag, data[at : at + size], data[start : at + size]
        at += size


def oid(raw: bytes) -> str:
    out, value = [], 0
    for b in raw:
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            out.append(value)
            value = 0
    first = min(out[0] // 40, 2)
    return ".".join(map(str, [first, out[0] - 40 * first, *out[1:]]))


def _time(tag: int, raw: bytes) -> int:
    text = raw.decode("ascii")
    if tag == 0x17:
        text = ("20" if int(text[:2]) < 50 else "19") + text
    return int(datetime.strptime(text, "%Y%m%d%H%M%SZ").replace(tzinfo=UTC).timestamp()) * 1_000_000


def _name(raw: bytes) -> str:
    parts = []
    for _, rdn, _ in items(raw):
        for _, pair, _ in items(rdn):
            (_, key, _), (_, value, _) = list(items(pair))[:2]
            text = value.decode("utf-8", "replace")
            escaped = "".join("\\" + c if c in ',+"\\<>;=' else c for c in text)
            parts.append(f"{NAMES.get(oid(key), oid(key))}={escaped}")
    return ",".join(reversed(parts))


def parse(der: bytes) -> dict:
    """subject, issuer, validity, key, signature hash, names, usages and digests; broken DER raises ValueError."""
    try:
        (_, outer, _), *_ = items(der)
        (_, tbs, _), (_, algorithm, _), *_ = items(outer)
        fields = [x for x in items(tbs)]
        fields = fields[1:] if fields[0][0] == 0xA0 else fields
        _, _, issuer, validity, subject, spki, *rest = fields
        begin, end = [_time(t, v) for t, v, _ in items(validity[1])][:2]
        (_, key_algorithm, _), (_, key_bits, _) = list(items(spki[1]))[:2]
        ids = list(items(key_algorithm))
        kind = KEYS.get(oid(ids[0][1]))
        key_size = None
        if kind == "RSA":
            modulus = next(items(next(items(key_bits[1:]))[1]))[1]
            key_size = int.from_bytes(modulus, "big").bit_length()
        elif kind == "EC" and len(ids) > 1:
            key_size = CURVES.get(oid(ids[1][1]))
        usages, names = [], []
        is_ca, path_len, may_sign = False, None, True
        for tag, content, _ in rest:
            if tag == 0xA3:
                for _, ext, _ in items(next(items(content))[1]):
                    parts = list(items(ext))
                    what = oid(parts[0][1])
                    if what == EKU:
                        usages = [oid(v) for _, v, _ in items(next(items(parts[-1][1]))[1])]
                    elif what == BASIC:
                        held = list(items(next(items(parts[-1][1]))[1]))
                        is_ca = any(t == 1 and v != b"\0" for t, v, _ in held)
                        path_len = next((int.from_bytes(v, "big") for t, v, _ in held if t == 2), None)
                    elif what == USAGE:
                        bits = next(items(parts[-1][1]))[1]
                        may_sign = len(bits) > 1 and bool(bits[1] & 4)
                    elif what == SAN:
                        names = [v.decode("ascii", "replace") for t, v, _ in items(next(items(parts[-1][1]))[1]) if t == 0x82]
        return {"subject": _name(subject[1]), "issuer": _name(issuer[1]), "not_before_us": begin, "not_after_us": end, "key_algorithm": kind, "key_bits": key_size, "signature_hash": SIGNATURES.get(oid(next(items(algorithm))[1])), "names": names, "is_ca": is_ca, "path_len": path_len, "may_sign": may_sign, "eku_count": len(usages), "eku_server_auth": SERVER_AUTH in usages, "sha256": hashlib.sha256(der).hexdigest(), "spki_sha256": hashlib.sha256(spki[2]).hexdigest()}
    except (StopIteration, IndexError, UnicodeDecodeError, ValueError) as e:
        raise ValueError(f"not a certificate: {e}") from e


def matches(names: list[str], host: str | None) -> bool | None:
    """Does a DNS name cover the host, with a wildcard for its first label only; null without either."""
    if not names or not host:
        return None
    host = host.lower()
    return any(n.lower() == host or n.startswith("*.") and "." in host and n[2:].lower() == host.split(".", 1)[1] for n in names)


def anchor_digest(fingerprints) -> str:
    """One digest for a set of certificates, by their SHA-256 in order."""
    return hashlib.sha256("".join(sorted(fingerprints)).encode()).hexdigest()[:32]
