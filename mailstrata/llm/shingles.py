"""Word shingles as 64-bit hashes, vectorised: texts become byte arrays, never lists of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed at once: what a worker holds for them is some fifty times as much.
BUFFER = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _keys(n: int, seed: int) -> np.ndarray:
    """Random numbers from a seed, one for each place."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE_KEYS = _keys(256, 1)


def _hash_buffer(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word: a sum of byte key times place key, mixed."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lengths = ends - starts
    at = np.flatnonzero(~space)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    terms = _BYTE_KEYS[_LOWER[data[at]]] * (_keys(int(lengths.max()), 2) | _U(1))[place]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), starts, ends


def _spaced(raw: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of stretches of raw of about BUFFER bytes that cut no word."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BUFFER)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield at, end
        at = end


def located_words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, hash, start, end in code points) of all words, some texts at a time; a text is never split over two."""
    buffer: list[bytes] = []
    held, first = 0, 0

    def flush():
        raw = b" ".join(buffer)
        offsets = np.cumsum([0] + [len(b) + 1 for b in buffer[:-1]])
        found = [(h, a + s, a + e) for a, z in _spaced(raw) for h, s, e in [_hash_buffer(raw[a:z])]]
        hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        before = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
        owner = np.searchsorted(offsets, starts, "right") - 1
        base = before[offsets][owner]
        return first + owner, hashes, before[starts] - base, before[ends] - base

    for i, t in enumerate(texts):
        raw = (t or "").encode(errors="replace")
        if buffer and held + len(raw) > BUFFER:
            yield flush()
            buffer, held, first = [], 0, i
        buffer.append(raw)
        held += len(raw)
    if buffer:
        yield flush()


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, hashes of its words) of every text, in order."""
    buffer: list[bytes] = []
    held, first = 0, 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        hashes, starts, _ = _hash_buffer(b" ".join(buffer))
        cuts = np.searchsorted(starts, np.cumsum([len(b) + 1 for b in buffer]))
        for i, part in enumerate(np.split(hashes, cuts[:-1])):
            yield first + i, part

    for i, t in enumerate(texts):
        raw = (t or "").encode(errors="replace")
        if buffer and held + len(raw) > BUFFER:
            yield from flush()
            buffer, held, first = [], 0, i
        if len(raw) > BUFFER:
            yield i, np.concatenate([_hash_buffer(raw[a:z])[0] for a, z in _spaced(raw)])
            first = i + 1
            continue
        buffer.append(raw)
        held += len(raw)
    if buffer:
        yield from flush()


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words that of the whole sequence, of none an empty array."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(n, k)
    total = np.full(n - size + 1, _U(size))
    for j in range(size):
        total = mix(total * _U(0x9E3779B97F4A7C15) + words[j : n - size + 1 + j])
    return np.unique(total)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    return [shingle_set(w, k) for _, w in word_hashes(texts)]


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """Two sums over a set: sets with equal sizes and sums count as equal."""
    if not len(tokens):
        return 0, 0
    a, b = mix(tokens ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64), mix(tokens + _U(0x0123456789ABCDEF)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
