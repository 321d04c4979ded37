"""Whether one certificate signed another: RSA with PKCS #1 v1.5 padding and ECDSA over the curves of mail servers. Runs once for each distinct pair."""

from __future__ import annotations

import hashlib

from .x509 import items, oid

# Signature algorithms, DER prefixes of digests, curves (p, b, n, generator; a is p - 3).
RSA = {"1.2.840.113549.1.1.5": "sha1", "1.2.840.113549.1.1.11": "sha256", "1.2.840.113549.1.1.12": "sha384", "1.2.840.113549.1.1.13": "sha512"}
ECDSA = {"1.2.840.10045.4.1": "sha1", "1.2.840.10045.4.3.2": "sha256", "1.2.840.10045.4.3.3": "sha384", "1.2.840.10045.4.3.4": "sha512"}
DIGEST_INFO = {
    "sha1": "3021300906052b0e03021a05000414",
    "sha256": "3031300d060960864801650304020105000420",
    "sha384": "3041300d060960864801650304020205000430",
    "sha512": "3051300d060960864801650304020305000440",
}
CURVES = {
    "1.2.840.10045.3.1.7": (
        0xFFFFFFFF00000001000000000000000000000000FFFFFFFFFFFFFFFFFFFFFFFF, 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B, 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551,
        (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5),
    ),
    "1.3.132.0.34": (
        0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEFFFFFFFF0000000000000000FFFFFFFF,
        0xB3312FA7E23EE7E4988E056BE3F82D19181D9C6EFE8141120314088F5013875AC656398D8A2ED19D2A85C8EDD3EC2AEF,
        0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFC7634D81F4372DDF581A0DB248B0A77AECEC196ACCC52973,
        (0xAA87CA22BE8B05378EB1C71EF320AD746E1D3B628BA79B9859F741E082542A385502F25DBF55296C3A545E3872760AB7, 0x3617DE4A96262C6F5D9E98BF9292DC29F8F41DBD289A147CE9DA3113B5F0B8C00A60B1CE1D7E819D7A431D7C90EA0E5F),
    ),
}


def _parts(der: bytes) -> tuple[bytes, str, bytes]:
    """The signed bytes, the signature's algorithm and its bits."""
    signed, algorithm, bits = list(items(next(items(der))[1]))[:3]
    return signed[2], oid(next(items(algorithm[1]))[1]), bits[1][1:]


def _public_key(der: bytes) -> tuple[str, str | None, bytes]:
    """Algorithm, curve and bits of the key that a certificate carries."""
    fields = list(items(next(items(next(items(der))[1]))[1]))
    fields = fields[1:] if fields[0][0] == 0xA0 else fields
    algorithm, bits = list(items(fields[5][1]))[:2]
    ids = list(items(algorithm[1]))
    return oid(ids[0][1]), oid(ids[1][1]) if len(ids) > 1 and ids[1][0] == 6 else None, bits[1][1:]


def signed_by(child: bytes, parent: bytes) -> bool | None:
    """Whether parent's key made child's signature; null for algorithms that aren't built, and for broken DER."""
    try:
        signed, algorithm, signature = _parts(child)
        kind, curve, key = _public_key(parent)
        if algorithm in RSA and kind == "1.2.840.113549.1.1.1":
            n, e = (int.from_bytes(x[1], "big") for x in items(next(items(key))[1]))
            return _rsa(signed, RSA[algorithm], signature, n, e)
        if algorithm in ECDSA and curve in CURVES:
            return _ecdsa(signed, ECDSA[algorithm], signature, CURVES[curve], key)
    except (StopIteration, IndexError, ValueError):
        pass
    return None


def _rsa(signed: bytes, name: str, signature: bytes, n: int, e: int) -> bool:
    size = (n.bit_length() + 7) // 8
    tail = bytes.fromhex(DIGEST_INFO[name]) + hashlib.new(name, signed).digest()
    wanted = b"\0\1" + b"\xff" * (size - len(tail) - 3) + b"\0" + tail
    return len(signature) == size and pow(int.from_bytes(signature, "big"), e, n).to_bytes(size, "big") == wanted


def _sum(p: int, a, b):
    """The sum of two points; None is the point at infinity."""
    if a is None or b is None:
        return a or b
    if a[0] == b[0]:
        if (a[1] + b[1]) % p == 0:
            return None
        slope = 3 * (a[0] * a[0] - 1) * pow(2 * a[1], -1, p)
    else:
        slope = (b[1] - a[1]) * pow(b[0] - a[0], -1, p)
    x = (slope * slope - a[0] - b[0]) % p
    return x, (slope * (a[0] - x) - a[1]) % p


def _times(p: int, k: int, point):
    out = None
    for bit in bin(k)[2:]:
        out = _sum(p, out, out)
        out = _sum(p, out, point) if bit == "1" else out
    return out


def _ecdsa(signed: bytes, name: str, signature: bytes, curve: tuple, key: bytes) -> bool:
    p, b, n, generator = curve
    size = (p.bit_length() + 7) // 8
    if len(key) != 2 * size + 1 or key[0] != 4:
        raise ValueError("not an uncompressed point")
    point = int.from_bytes(key[1 : size + 1], "big"), int.from_bytes(key[size + 1 :], "big")
    r, s = (int.from_bytes(x[1], "big") for x in items(next(items(signature))[1]))
    if (point[1] ** 2 - point[0] ** 3 + 3 * point[0] - b) % p or not (0 < r < n and 0 < s < n):
        return False
    digest = hashlib.new(name, signed).digest()
    z = int.from_bytes(digest, "big") >> max(0, 8 * len(digest) - n.bit_length())
    w = pow(s, -1, n)
    met = _sum(p, _times(p, z * w % n, generator), _times(p, r * w % n, point))
    return met is not None and met[0] % n == r
