"""Near-duplicate removal by one-permutation hashing with optimal densification.

Every set of shingles is hashed once: the leading bits of a hash name one of BINS bins, and each bin keeps its least hash.
An empty bin borrows from the first filled one of a sequence of bins that is its own and the same for all sets, so borrowed bins
are independent of one another (optimal densification). ROWS bins make a band, a bucket is what agrees in a band.

A bucket emits a few stars, edges from a hub to all other members, never all pairs. Edges are confirmed on the full sets, and components tell which buckets
still hold unlinked members. What is then outside the largest component of a bucket is little: each such member
becomes the hub of one more star, over the members that it isn't connected with, so no link between members of a bucket is lost. Of the buckets that a
pair shares only the first one emits it then. Shingles that no other candidate holds count against every partner: an edge that they put below the threshold is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved, small
from .components import components
from .jaccard import _chunks, class_rows, named_rows, opened, row_key, sets_of
from .shingles import fingerprint, mix, shingle_sets

#: Bins of a signature and bins of a band: a pair of Jaccard index 0.85 meets in one of the 32 bands with a probability of 1 - 4 * 10^-5.
BINS, ROWS = 256, 8
#: Words of a shingle and percent of similarity.
WORDS, PERCENT = 5, 85
#: Stars of a bucket in each round before the last one; their hubs are the least members of as many parts.
STARS = (4,)
#: Bins of its own sequence that an empty bin tries before it takes the next filled one.
TRIES = 4096
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SIGNED = "doc_id long, key long, n long, f1 long, f2 long, bands array<long>"


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """(sets, bins) least hashes; every set has a member."""
    n = np.array([len(s) for s in sets], np.int64)
    shift = np.uint64(64 - (bins.bit_length() - 1))
    h = mix(np.concatenate(sets) ^ _GOLDEN)
    out = np.full((len(sets), bins), np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(out.reshape(-1), np.repeat(np.arange(len(sets)), n) * bins + (h >> shift).astype(np.int64), h)
    filled = out != np.uint64(0xFFFFFFFFFFFFFFFF)
    one = filled.sum(1) == 1
    out[one] = out[one].min(1)[:, None]
    row, empty = np.nonzero(~filled & ~one[:, None])
    for t in range(TRIES):
        if not len(row):
            return out
        other = (mix(np.arange(bins, dtype=np.uint64) * _GOLDEN + np.uint64(t + 1)) >> shift).astype(np.int64)[empty]
        there = filled[row, other]
        out[row[there], empty[there]] = out[row[there], other[there]]
        row, empty = row[~there], empty[~there]
    for r, e in zip(row, empty, strict=True):
        out[r, e] = out[r, np.roll(filled[r], -e).argmax() + e - bins]
    return out


def band_keys(sets: list[np.ndarray], bins: int = BINS, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) hashes of the bands."""
    bands = signatures(sets, bins).reshape(len(sets), -1, rows)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
    for r in range(rows):
        key = mix(key * _GOLDEN + bands[:, :, r])
    return key.astype(np.int64)


def signed_rows(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """doc_id, key (row_key), n (distinct shingles), fingerprints f1 and f2, bands (empty: no shingle) of every row."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (part for whole in batches for part in _chunks(whole, text)):
            sets = shingle_sets(list(b[text]), k)
            some = [i for i, s in enumerate(sets) if len(s)]
            bands = [np.zeros(0, np.int64)] * len(sets)
            if some:
                for i, x in zip(some, band_keys([sets[i] for i in some]), strict=True):
                    bands[i] = x
            prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "key": b["key"], "n": np.array([len(s) for s in sets], np.int64), "f1": prints[:, 0], "f2": prints[:, 1], "bands": bands})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(text).alias("key"), text).mapInPandas(signed, SIGNED)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with linked: whether the full sets of a and b reach the threshold."""
    left = sets.select(F.col("cid").alias("_a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("cid").alias("_b"), F.col("tokens").alias("y"))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            linked = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "linked": np.array(linked, bool)})

    joined = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).select("a", "b", "x", "y")
    return joined.mapInPandas(compared, "a long, b long, linked boolean")


def _may_link(n, shared, other_n, other_shared, percent: int):
    """Whether sets of n and other_n shingles can reach the threshold, when at most shared and other_shared of them are held by any other set."""
    both = F.least(shared, other_shared)
    return 100 * both >= percent * (n + other_n - both)


def with_shared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members (band, at, cid, n) with shared: shingles that another of sets holds, too. Counts are summed before they move."""
    lone = opened(sets).groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.min("cid").alias("_cid")).where("sets = 1").groupBy("_cid").agg(F.count(F.lit(1)).alias("_lone"))
    lone = saved(lone, "minhash-lone")
    return members.join(small(lone), F.col("cid") == F.col("_cid"), "left").select("band", "at", "cid", "n", (F.col("n") - F.coalesce("_lone", F.lit(0))).alias("shared"))


HUB = ["at", "cid", "n", "shared", "comp", "main", "bands"]


def _open_members(members: DataFrame, label: DataFrame | None, percent: int) -> DataFrame:
    """band, at, cid, n, shared, comp of the members of buckets that hold several components, less those that can have no partner there. Saved."""
    held = members.withColumn("comp", F.col("cid"))
    if label is not None:
        held = members.join(label, F.col("cid") == F.col("_node"), "left").select(*members.columns, F.coalesce("_comp", "cid").alias("comp"))
    ends = held.groupBy(F.col("band").alias("_band")).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"))
    open_ = saved(ends.where("low < high").select("_band", "least"), "minhash-open")
    # a partner has no fewer shingles than the least of the bucket, nor than the threshold asks for
    partner = F.greatest("least", F.ceil(F.col("n") * percent / 100).cast("long"))
    fits = _may_link(F.col("n"), F.col("shared"), partner, F.col("shared"), percent)
    out = saved(held.join(open_, F.col("band") == F.col("_band")).where(fits).drop("_band", "least"), "minhash-open-members")
    dropped(open_)
    return out


def _star_pairs(held: DataFrame, slots: int, percent: int) -> DataFrame:
    """a, b (a < b), once each: from the least member of each slot of a bucket to all members of other components."""
    dealt = held.withColumn("slot", F.pmod(F.xxhash64("cid", F.lit(slots)), F.lit(slots)))
    hubs = dealt.groupBy("band", "slot").agg(F.min(F.struct("cid", "n", "shared", "comp")).alias("hub"))
    hubs = hubs.select(F.col("band").alias("_band"), *[F.col(f"hub.{c}").alias(f"_{c}") for c in ("cid", "n", "shared", "comp")])
    fits = (F.col("comp") != F.col("_comp")) & _may_link(F.col("n"), F.col("shared"), F.col("_n"), F.col("_shared"), percent)
    return held.join(hubs, F.col("band") == F.col("_band")).where(fits).select(F.least("cid", "_cid").alias("a"), F.greatest("cid", "_cid").alias("b")).distinct()


def _last_pairs(held: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b (a < b), once each: from every member outside the largest component of its bucket to all members of other components there."""
    sizes = held.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("size")).groupBy(F.col("band").alias("_of")).agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"))
    keys = saved(classes.join(held.select(F.col("cid").alias("_held")).distinct(), F.col("cid") == F.col("_held"), "left_semi").select(F.col("cid").alias("_key"), "bands"), "minhash-bands")
    rows = saved(held.join(sizes, F.col("band") == F.col("_of")).join(keys, F.col("cid") == F.col("_key")).select("band", *HUB[:-2], (F.col("comp") == F.col("largest")).alias("main"), "bands"), "minhash-strays")
    dropped(keys)
    hubs = rows.where("NOT main").select(F.col("band").alias("_band"), *[F.col(c).alias(f"_{c}") for c in HUB])
    fits = (F.col("comp") != F.col("_comp")) & (F.col("main") | (F.col("cid") > F.col("_cid"))) & _may_link(F.col("n"), F.col("shared"), F.col("_n"), F.col("_shared"), percent)
    first = F.expr("array_position(zip_with(bands, _bands, (x, y) -> x = y), true) = at + 1")
    return rows.join(hubs, (F.col("band") == F.col("_band")) & fits & first).select(F.least("cid", "_cid").alias("a"), F.greatest("cid", "_cid").alias("b"))


def star_components(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, component of the classes that links connect with another one, over all linked members of each bucket of members (band, at, cid, n, shared; saved); classes: cid, bands. Saved."""
    tested, found = None, None
    for slots in (*STARS, None):
        label = found.select(F.col("node").alias("_node"), F.col("component").alias("_comp")) if found is not None else None
        held = _open_members(members, label, percent)
        if held.isEmpty():
            dropped(held)
            break
        pairs = _star_pairs(held, slots, percent) if slots else _last_pairs(held, classes, percent)
        if tested is not None:
            pairs = pairs.join(tested.select(F.col("a").alias("_ta"), F.col("b").alias("_tb")), (F.col("a") == F.col("_ta")) & (F.col("b") == F.col("_tb")), "left_anti")
        checked = saved(confirmed(pairs, sets, percent), "minhash-checked")
        dropped(held)
        tested = checked if tested is None else tested.unionByName(checked)
        links = checked.where("linked").select("a", "b")
        if found is not None:
            # what was connected before is one star for each component
            links = links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        before, found = found, components(links)
        dropped(before)
    none = sets.select(F.col("cid").alias("node"), F.col("cid").alias("component")).limit(0)
    return found if found is not None else none


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; documents link when their shingle sets' Jaccard index is percent / 100 or more.

    component_id is the smallest id reachable by links, kept whether that is the row's own. Null and empty texts and those without words are linked with nothing
    and kept. Rows of one set, repeated rows included, are one class; a null id belongs to its class, never names it and is kept only where no row of
    the group has an id. Texts under one id count each for themselves. An empty table gives no rows; other columns aren't looked at.
    """
    rows = saved(signed_rows(docs, k, text), "minhash-rows")
    classes = class_rows(rows, F.first("bands").alias("bands"))
    keys = saved(classes.select("cid", "n", F.posexplode("bands").alias("at", "band")), "minhash-keys")
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("_classes")).where(F.col("_classes") > 1).select(F.col("band").alias("_band"))
    members = saved(keys.join(shared, F.col("band") == F.col("_band"), "left_semi"), "minhash-members")
    dropped(keys)
    met = members.select(F.col("cid").alias("_cid")).distinct()
    wanted = saved(classes.join(met, F.col("cid") == F.col("_cid"), "left_semi").select("cid", "key", "n", "f1", "f2"), "minhash-wanted")
    sets = saved(sets_of(docs, wanted, k, text).dropDuplicates(["cid"]), "minhash-sets")
    candidates = saved(with_shared(members, sets), "minhash-candidates")
    dropped(members)
    found = star_components(candidates, classes, sets, percent)
    dropped(wanted, sets, candidates)
    out = named_rows(rows, classes, found)
    kept = F.when(F.col("component_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op12_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents)),
t AS (SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p) AS shingle, count(*) OVER (PARTITION BY doc_id) AS words
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, shingle FROM t WHERE i <= greatest(words - 4, 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.v FROM reach r JOIN (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
