"""Spelling variants by full neighbourhood generation.

Every word emits all distinct deletions, replacements and insertions over the alphabet that the vocabulary shows, and a
candidate that is a word of the vocabulary is a near word: no distance is ever computed.

A million words have some billion candidates, so these aren't moved. The one edit that parts two near words lies in the
first or in the second half of the longer one, and the other half they share; words are dealt by halves, and
each meets all its candidates with edits outside the shared half in the task that holds it. A candidate is a
64-bit sum of keys of (place, letter), so all candidates of many words are a few array operations; it is looked up in a table of
the task's words by its leading bits, then by all bits. A half that very many words share is dealt to several tasks:
each of its words is vocabulary in one of them and generates in all.
Among 10^10 candidates a false match has a probability of about 10^-5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved, small
from .shingles import mix

#: Letters of a run, and the ones that are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in DROP loses a code point; code points and occurrences of a word; times as many occurrences as a form needs.
DROP, LENGTH, TIMES, RATIO = 31, 7, 2, 10
#: Code points of words that one task holds, words of a half beyond which it is dealt to several, candidates held at once.
TASK_POINTS, SHARED, HELD = 1 << 20, 20_000, 1 << 20
#: Slots of the first table for each word.
SLOTS = 32
FOUND = "word string, n_near long, near_n long, near string"


def lowered(run):
    """Only A-Z lower-cased; plain ASCII has a faster way."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """word, n of all words with length code points and times occurrences, after the dropped code points. A null id counts as an empty one."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", lowered(F.col("run")).alias("run")).where(F.length("run") >= length)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    cut = F.expr("overlay(run PLACING '' FROM cast(h % length(run) AS int) + 1 FOR 1)")
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DROP == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def _shared_halves(words: DataFrame) -> DataFrame:
    """key, second (whether the second half is shared), size (code points of the longer word of a pair), word, n: every word under the halves that it can share with a near one.

    A word is the longer one of a pair, or as long as the other (size is its own length), or the shorter one (size is one more).
    """
    size = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size")
    sides = words.select("word", "n", size).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("second"))
    half = F.floor(F.col("size") / 2).cast("int")
    part = F.when(F.col("second"), F.substring("word", F.length("word") - (F.col("size") - half) + 1, F.col("size") - half)).otherwise(F.substring("word", F.lit(1), half))
    return sides.select(F.xxhash64("size", "second", part).alias("key"), "second", "size", "word", "n")


def _letter_keys(place: int, letters: np.ndarray) -> np.ndarray:
    return mix(letters.astype(np.uint64) + np.uint64((place + 1) << 32))


def _spelled(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _sums(letters: np.ndarray, shift: int) -> np.ndarray:
    """Sums of the keys of the first 0, 1, ... letters, each taken shift places further on."""
    out = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
    for j in range(letters.shape[1]):
        out[:, j + 1] = out[:, j] + _letter_keys(j + shift, letters[:, j])
    return out


def candidates(words: list[str], length: int, alphabet: np.ndarray, longer: bool, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hashes) of all distinct candidates of words of one length whose edit is at the places first to last - 1 of the longer word.

    longer: replacements and deletions; otherwise insertions. Deleting any of several equal letters in a row, or inserting one more, gives one string: the first place counts.
    """
    letters = _spelled(words, length)
    rows = np.arange(len(words))
    here = _sums(letters, 0)
    other = _sums(letters, -1 if longer else 1)
    whole, moved = here[:, -1], other[:, -1]
    for i in range(first, last):
        keys = _letter_keys(i, alphabet)
        before = letters[:, i - 1] if i else np.full(len(words), np.uint32(0))
        if longer:
            rest = whole - (here[:, i + 1] - here[:, i])
            fits = alphabet[None] != letters[:, i, None]
            once = before != letters[:, i]
            yield rows[once], (here[:, i] + (moved - other[:, i + 1]))[once]
        else:
            rest = here[:, i] + (moved - other[:, i])
            fits = alphabet[None] != before[:, None]
        yield np.repeat(rows, fits.sum(1)), (rest[:, None] + keys[None])[fits]


def near_in_task(rows: pd.DataFrame, alphabet: np.ndarray) -> pd.DataFrame:
    """word, n_near, near_n, near: for every word of rows (key, second, size, word, n, known, asks) how many of its candidates are known under its key, and the most frequent of them."""
    known = rows[rows["known"]].drop_duplicates(["key", "word"]).sort_values(["n", "word"], ascending=[False, True], kind="stable")
    asks = rows[rows["asks"]].drop_duplicates(["key", "word"]).reset_index(drop=True)
    if not len(known) or not len(asks):
        return pd.DataFrame({"word": [], "n_near": [], "near_n": [], "near": []})
    lengths = known["word"].str.len().to_numpy()
    hashes = np.zeros(len(known), np.uint64)
    for x in np.unique(lengths):
        at = np.flatnonzero(lengths == x)
        hashes[at] = _sums(_spelled(known["word"].iloc[at].tolist(), x), 0)[:, -1]
    hashes += known["key"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(hashes, kind="stable")
    by_hash = hashes[order]
    shift = np.uint64(64 - max(10, math.ceil(math.log2(SLOTS * len(known)))))
    table = np.zeros(1 << (64 - int(shift)), bool)
    table[by_hash >> shift] = True
    count, best = np.zeros(len(asks), np.int64), np.full(len(asks), len(known), np.int64)
    keys = asks["key"].to_numpy(np.int64).astype(np.uint64)
    lengths = asks["word"].str.len().to_numpy()
    for (size, second), part in asks.groupby(["size", "second"]).indices.items():
        first, last = (0, size // 2) if second else (size // 2, size)
        for x in np.unique(lengths[part]):
            at = part[lengths[part] == x]
            step = max(1, HELD // len(alphabet))
            for at in (at[i : i + step] for i in range(0, len(at), step)):
                for row, h in candidates(asks["word"].iloc[at].tolist(), x, alphabet, x == size, first, last):
                    h = h + keys[at[row]]
                    maybe = np.flatnonzero(table[h >> shift])
                    row, h = row[maybe], h[maybe]
                    place = np.minimum(np.searchsorted(by_hash, h), len(by_hash) - 1)
                    hit = by_hash[place] == h
                    mine = at[row[hit]]
                    np.add.at(count, mine, 1)
                    np.minimum.at(best, mine, order[place[hit]])
    some = np.flatnonzero(count)
    top = known.iloc[best[some]]
    return pd.DataFrame({"word": asks["word"].to_numpy()[some], "n_near": count[some], "near_n": top["n"].to_numpy(), "near": top["word"].to_numpy()})


def near_words(words: DataFrame, shared: int = SHARED) -> DataFrame:
    """word, n, n_near, near_n, near (the most frequent near word, of several the least) for every row of words (word, n; saved)."""
    # at most the 26 + 64 letters that RUN lets through
    letters = words.select(F.explode(F.split("word", "")).alias("x")).where("x != ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["x"]) for r in letters), np.uint32)
    halves = _shared_halves(words)
    points = words.agg(F.sum(F.length("word"))).first()[0] or 0
    buckets = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(4 * points / TASK_POINTS))
    crowded = saved(halves.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_words")).where(F.col("_words") > shared), "variant-halves")
    parts = F.ceil(F.coalesce("_words", F.lit(1)) / shared).cast("int")
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    dealt = halves.join(small(crowded), F.col("key") == F.col("_key"), "left").select("key", "second", "size", "word", "n", own.alias("_own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    dealt = dealt.withColumns({"known": F.col("_part") == F.col("_own"), "asks": F.lit(True), "_bucket": F.pmod(F.xxhash64("key", "_part"), F.lit(buckets))})
    found = dealt.drop("_own", "_part").groupBy("_bucket").applyInPandas(lambda rows: near_in_task(rows, alphabet), FOUND)
    zero = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near"))
    both = zero.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best")
    out = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    out = saved(out.select("word", "n", "n_near", (-F.col("best.less")).alias("near_n"), "best.near"), "variant-near")
    dropped(crowded)
    return out


def roots(links: DataFrame) -> DataFrame:
    """_word, _root: where the forms of links (word, form; saved) end, for words whose form has a form itself. Saved; each round doubles the steps taken."""
    known = links.select(F.col("word").alias("_word"), F.col("form").alias("_root"))
    done = None
    while True:
        ends = known.select(F.col("_word").alias("_next"), F.col("_root").alias("_end"))
        onward = saved(known.join(ends, F.col("_root") == F.col("_next")).select("_word", F.col("_end").alias("_root")), "variant-roots")
        dropped(done)
        if onward.isEmpty():
            return onward if done is None else out
        further = onward.withColumnsRenamed({"_word": "_w", "_root": "_r"})
        out = saved(known.join(further, F.col("_word") == F.col("_w"), "left").select("_word", F.coalesce("_r", "_root").alias("_root")), "variant-roots")
        known = out
        done = onward


def variant_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of docs (see vocabulary).

    form is the near word of most occurrences (of several the least in code-point order) if it has ratio times as many as the word, root
    where forms lead to; a word without a form is its own root. Null and empty texts have no words, repeated rows count as often as they stand, an empty table gives no rows; other columns aren't looked at.
    """
    words = saved(vocabulary(docs, text, doc_id), "variant-words")
    near = near_words(words)
    dropped(words)
    is_form = F.col("near_n") >= ratio * F.col("n")
    rows = near.select("word", F.when(is_form, F.col("near")).alias("form"), "n", "n_near", F.when(is_form, F.col("near_n")).alias("form_n"))
    ends = roots(rows.where(F.col("form").isNotNull()).select("word", "form"))
    return rows.join(ends, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("_root", "form", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variant_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The table of CRC-32 with the reflected polynomial 0xEDB88320 is made in the query; two words are near if they agree after one letter of each, or of the longer one, is cut out at one place.
ORACLE = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents)),
each AS (SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY id, run),
crc AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST(('0x' || substr(x, CAST(2 * i + 1 AS INT), 2)) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS h FROM each, tab),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM crc),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
holes AS MATERIALIZED (SELECT word, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
pairs AS (SELECT x.word AS word, y.word AS near FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT h.word, v.word FROM holes h JOIN v ON v.word = h.a || h.b UNION SELECT v.word, h.word FROM holes h JOIN v ON v.word = h.a || h.b),
best AS (SELECT p.word, count(*) AS n_near, first(p.near ORDER BY w.n DESC, encode(p.near)) AS near, max(w.n) AS near_n FROM pairs p JOIN v w ON w.word = p.near GROUP BY p.word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS node, 0 AS step FROM f UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN f ON f.word = w.node WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, last(node ORDER BY step) AS root FROM walk GROUP BY word) r USING (word)
"""
