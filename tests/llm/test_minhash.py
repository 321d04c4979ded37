"""Densified one-permutation hashing and star edges against plain Python."""

import random

import numpy as np
import pytest
from test_brute import _components

from mailstrata.llm import minhash, shingles


def _documents(seed, groups=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 300))]
        for _ in range(rng.randrange(1, 7)):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    return rows


def _got(table):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in table.collect()}


def test_links_are_those_of_brute_force(spark):
    rows = _documents(3)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = _components(rows, 5, 85)
    assert _got(found) == want and len({c for _, c in want.values()}) < len(rows) - 15
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def test_chains_of_near_copies_are_followed(spark):
    """Each text differs from the next by a few words and from the last by most of them: one star per bucket doesn't link them all."""
    rng = random.Random(4)
    text = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(text)))
        at = rng.randrange(197)
        text[at : at + 2] = [f"n{i}a", f"n{i}b"]
    assert _got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == _components(rows, 5, 85)


def test_stars_settle_buckets_of_unlinked_members(spark):
    """Members of one bucket that are linked in pairs only, and not with its least member."""
    rng = np.random.RandomState(1)
    sets = []
    for _ in range(12):
        base = rng.randint(0, 1 << 60, 40).astype(np.uint64)
        sets += [np.sort(base), np.sort(base[1:])]
    table = minhash.saved(spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in enumerate(sets)], "cid long, n long, tokens binary"))
    rows = [(band, at, i, len(s), len(s)) for at, band in enumerate((7, 8)) for i, s in enumerate(sets)]
    members = minhash.saved(spark.createDataFrame(rows, "band long, at int, cid long, n long, shared long"))
    classes = spark.createDataFrame([(i, [7, 8]) for i in range(len(sets))], "cid long, bands array<long>")
    found = {r["node"]: r["component"] for r in minhash.star_components(members, classes, table, 85).collect()}
    assert found == {i: i - i % 2 for i in range(24)}


@pytest.mark.parametrize("size", [1, 2, 7, 30, 400, 5000])
def test_bands_meet_as_often_as_they_should(size):
    """Share of bands in which two sets of a known Jaccard index agree, over many pairs: its eighth power."""
    rng = np.random.RandomState(size)
    agree, expected = [], []
    for _ in range(60):
        extra = max(1, size // 10)
        x = rng.randint(0, 1 << 62, size + extra).astype(np.uint64)
        a, b = minhash.band_keys([np.sort(x), np.sort(x[:size])])
        agree.append((a == b).mean())
        expected.append((size / (size + extra)) ** minhash.ROWS)
    assert abs(np.mean(agree) - np.mean(expected)) < 0.12
    same = minhash.band_keys([np.sort(x), np.sort(x)])
    assert (same[0] == same[1]).all() and same.shape == (2, minhash.BINS // minhash.ROWS)


def test_borrowing_falls_back_to_the_next_filled_bin(monkeypatch):
    monkeypatch.setattr(minhash, "TRIES", 1)
    sets = shingles.shingle_sets(["a b c d e f g h", "a b c d e f g h i"], 5)
    out = minhash.signatures(sets)
    assert (out != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and set(out[0].tolist()) <= set(minhash.mix(sets[0] ^ np.uint64(0x9E3779B97F4A7C15)).tolist())


def test_edges(spark):
    long = "lorem ipsum dolor " * 20_000
    rows = [(1, "one two"), (2, None), (3, ""), (None, "one two"), (1, "one two"), (5, long), (6, long), (7, " \n\t "), (None, "alone among all these rows here")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, n string, component_id string, kept string")
    got = sorted(map(str, minhash.near_duplicates(docs).collect()))
    want = [(1, 1, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 1, 1, False), (1, 1, 1, True), (5, 3, 5, True), (6, 3, 5, False), (7, 0, 7, True), (None, 2, None, True)]
    assert got == sorted(f"Row(doc_id={d}, n_shingles={n}, component_id={c}, kept={k})" for d, n, c, k in want)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
