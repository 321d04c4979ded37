"""The bit-sliced impact index against plain Python."""

import collections
import math
import random
import re

import numpy as np
import pytest

from mailstrata.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _expected(docs, items, k=50):
    tfs = [(d, collections.Counter(_terms(t))) for d, t in docs]
    tfs = [(d, c) for d, c in tfs if c]
    total, n = sum(c.total() for _, c in tfs), len(tfs)
    df = collections.Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c in tfs:
            m = 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(_terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def _corpus(seed, n):
    rng = random.Random(seed)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(3000)] + ["Été", "été", "ÜBER", "x1"]
    docs = [(i * 3 % n, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    items = [(i, "-".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("block,asked,open_,added", [(2048, 8 << 20, 4096, 16 << 20), (70, 300, 10, 1 << 12)])
def test_scores_and_ranks_are_those_of_brute_force(spark, monkeypatch, block, asked, open_, added):
    """With the production sizes, and with small blocks, several parts of the queries and few terms open at once."""
    for name, x in (("BLOCK", block), ("ASKED_BYTES", asked), ("OPEN", open_), ("ADDED_BYTES", added)):
        monkeypatch.setattr(lexical, name, x)
    docs, items = _corpus(block, 400)
    got = lexical.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=20)
    assert sorted(map(tuple, got.collect()), key=str) == _expected(docs, items, 20)


def test_sums_and_best_of_slices():
    rng = np.random.RandomState(3)
    for addends in (1, 2, 3, 4, 7, 30):
        x = rng.randint(0, 1 << 20, (5, addends, 150)) * (rng.rand(5, addends, 150) < 0.3)
        rows = [lexical.open_slices(*(lambda r, p: (r, p, x[i][r, p]))(*np.nonzero(x[i])), addends, 150, 26) for i in range(5)]
        total = lexical.add_all(np.stack(rows))
        for k in (1, 10, 149, 500):
            item, place, score = lexical.scores_of(total, lexical.best_bits(total, k))
            for i in range(5):
                want = x[i].sum(0)
                least = np.sort(want)[::-1][min(k, 150) - 1]
                mine = item == i
                assert (score[mine] == want[place[mine]]).all() and set(place[mine]) == set(np.flatnonzero((want >= max(least, 1))))


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "apple pie"), (None, "apple"), (3, "apple pie"), (4, "pear " * 30_000), (5, ", -!"), (6, "Apple PIE apple")]
    items = [(1, "apple"), (1, "apple"), (None, "pie"), (2, None), (3, "nothing here"), (4, "PEAR pear"), (1, "pie")]
    left = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, item_id string, term string")
    right = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, doc_id string, rank string")
    assert sorted(map(tuple, lexical.rank_documents(left, right).collect()), key=str) == _expected(docs, items)
    assert lexical.rank_documents(left.limit(0), right).count() == 0 and lexical.rank_documents(left, right.limit(0)).count() == 0
