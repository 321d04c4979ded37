"""Spelling variants against plain Python."""

import collections
import random
import re
import zlib

import numpy as np

from mailstrata.llm import variants

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def _expected(rows):
    n = _words(rows)
    out = {}
    for w in n:
        near = [x for x in n if _near(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 10 * n[w] else None
        out[w] = (form, n[w], len(near), n[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (f, root(w), k, m, fn) for w, (f, k, m, fn) in out.items()}


def _got(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows.collect()}


def _rows(seed, chain=True):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 12))) for _ in range(60)]
    if chain:  # forms that have forms: 2, 20, 200 and 2000 occurrences, one letter apart each time
        base += ["zzzzzzzz"]
    rows = []
    for i in range(250):
        words = []
        for _ in range(30):
            w = rng.choice(base)
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdefÀ") + w[at:], w[:at] + rng.choice("xyz") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.05 else w)
        rows.append((i if i % 50 else None, " ".join(words) + ", x-" + rng.choice(base)))
    for word, times in (("qqqqqqqqq", 2), ("qqqqqqqq", 40), ("qqqqqqqr", 700)) if chain else ():
        rows += [(10_000 + i, word) for i in range(times)]
    return rows


def test_variants_are_those_of_brute_force(spark):
    rows = _rows(1)
    want = _expected(rows)
    got = _got(variants.variant_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == want and len(want) > 200
    assert any(f and want[f][0] for f, *_ in want.values())  # a form of a form was followed


def test_a_half_that_many_words_share_is_dealt_to_several_tasks(spark):
    rng = random.Random(5)
    words = sorted({"commonst" + "".join(rng.choice("abc") for _ in range(rng.randrange(6, 9))) for _ in range(700)})
    n = {w: rng.choice([2, 3, 50, 800]) for w in words}
    table = variants.saved(spark.createDataFrame(list(n.items()), "word string, n long"))
    got = {r["word"]: (r["n_near"], r["near"], r["near_n"]) for r in variants.near_words(table, shared=40).collect()}
    for w in words:
        near = [x for x in words if _near(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        assert got[w] == (len(near), best, n[best] if best else None)


def test_candidates_are_distinct_and_all():
    alphabet = np.array([ord(c) for c in "abé"], np.uint32)
    letters = "abé"
    for word in ("aabbaab", "aaaaaaa", "abéabéab"):
        n = len(word)
        longer = {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + c + word[i + 1 :] for i in range(n) for c in letters if c != word[i]}
        shorter = {word[:i] + c + word[i:] for i in range(n + 1) for c in letters}
        for want, is_longer, last in ((longer, True, n), (shorter, False, n + 1)):
            hashes = [h for _, hs in variants.candidates([word], n, alphabet, is_longer, 0, last) for h in hs.tolist()]
            spelled = {int(variants._sums(variants._spelled([w], len(w)), 0)[0, -1]) for w in want}
            assert len(hashes) == len(set(hashes)) and set(hashes) == spelled and len(want) == len(spelled)


def test_edges(spark):
    long = "wordword" * 3000
    rows = [(1, None), (2, ""), (3, "short words"), (4, long), (4, long), (5, long + "x"), (5, long + "x"), (None, "Échelles Échelles échelles échelles")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, word string, n string")
    assert _got(variants.variant_groups(docs)) == _expected(rows)
    assert variants.variant_groups(docs.limit(0)).count() == 0
