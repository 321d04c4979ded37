"""Substring dedup by paragraph MinHash banding: repeated passages anywhere in texts.

Texts are cut into paragraphs where their own words say so: one begins at every word whose hash, taken with the words
beside it, is the least among the WINDOW words on both sides, so a passage is cut alike wherever it stands, sentence
ends or not, but for the few words next to its own ends. A paragraph has more than WINDOW words unless it begins a text, 2 * WINDOW + 1 on average.
Equal paragraphs are one class. Each class gets bands of its 5-word shingles. A larger set has min-hashes, tuned so that a pair at
the threshold meets with the wanted probability; a set of up to FEW shingles has its least ones instead, as many as
a partner may lack plus one, so a pair always meets. Sets that may have a partner beyond FEW, or below, have these too.
A paragraph of fewer than five words is one shingle, which only its equals hold. The classes of
a band are joined exactly (Jaccard 0.8), and components of the links are the clusters of repeated paragraphs.
A stretch of neighbouring repeated paragraphs with RUN words or more is a passage;
all its occurrences but the first are marked for removal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, saved, small
from .components import components
from .jaccard import cell_edges
from .shingles import located_words, mix, shingle_set

#: Words of a shingle, percent of Jaccard similarity, words on both sides that a cut looks at, shingles up to which the least ones are the bands.
WORDS, PERCENT, WINDOW, FEW = 5, 80, 4, 19
#: Words of a passage. One of over 50 words keeps some 34 of them in whole paragraphs, since its ends are cut otherwise in every text.
RUN = 20
#: Classes of a band that one task joins; their sets are small.
CELL = 4096
#: Rows of one number up to which the bands that meet are broadcast (some 20 MB); a larger one is joined by a shuffle.
NAMED = 500_000
#: Probability with which a pair at the threshold shall collide, and the least min-hashes of a band.
RECALL, ROWS = 0.995, 3
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def tuned_bands(similarity: float, recall: float = RECALL, rows: int = ROWS, most: int = 64) -> tuple[int, int]:
    """(bands, rows of a band): the fewest bands, then the most rows from `rows` on, that reach the recall with at most `most` hashes.

    Every band is a row that moves, so bands are what costs; bands of few rows let unlike sets meet.
    """
    fits = [(b, -r) for r in range(rows, most + 1) for b in range(1, most // r + 1) if 1 - (1 - similarity**r) ** b >= recall]
    b, r = min(fits)
    return b, -r


def paragraph_starts(owner: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which words begin a paragraph: the first of each text, and those whose hash is the least of WINDOW words on both sides, of equal ones the first.

    The hash is that of a word and its two neighbours, since a frequent word by itself would cut wherever it stands.
    """
    order = words.copy()
    order[1:] = mix(order[1:] * _GOLDEN + words[:-1])
    order[:-1] = mix(order[:-1] * _GOLDEN + words[1:])
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    least = np.ones(len(order), bool)
    for j in range(1, WINDOW + 1):
        same = owner[j:] == owner[:-j]
        least[j:] &= ~same | (order[j:] < order[:-j])
        least[:-j] &= ~same | (order[:-j] <= order[j:])
    return np.flatnonzero(first | least)


def _sequences(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the sequence of words of each paragraph, its class; h: hashes of all words, n: words of each paragraph."""
    unit = np.repeat(np.arange(len(n)), n)
    place = (np.arange(len(h)) - (np.cumsum(n) - n)[unit]).astype(np.uint64)
    whole = np.zeros(len(n), np.uint64)
    np.add.at(whole, unit, mix(h + (place + np.uint64(1)) * _GOLDEN))
    return mix(whole).astype(np.int64)


def _signatures(h: np.ndarray, n: np.ndarray, n_bands: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bands each paragraph has (none: fewer words than a shingle), and all bands in order."""
    unit = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - (np.cumsum(n) - n)[unit]
    at = np.flatnonzero(place <= n[unit] - WORDS)
    if not len(at):
        return np.zeros(len(n), np.int64), np.zeros(0, np.int64)
    shingle = np.full(len(at), np.uint64(WORDS))
    for j in range(WORDS):
        shingle = mix(shingle * _GOLDEN + h[at + j])
    owner, shingle = unit[at], mix(shingle ^ _GOLDEN)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    keep = np.r_[True, (np.diff(owner) != 0) | (shingle[1:] != shingle[:-1])]
    owner, shingle = owner[keep], shingle[keep]
    starts = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
    sizes = np.diff(np.r_[starts, len(owner)])
    rank = np.arange(len(owner)) - np.repeat(starts, sizes)
    # the least shingles: as many as a partner at the threshold may lack, plus one
    least = sizes - -(-PERCENT * sizes // 100) + 1
    least[100 * FEW < PERCENT * sizes] = 0
    pick = rank < np.repeat(least, sizes)
    out_owner, out_key = [owner[pick]], [mix(shingle[pick])]
    many = sizes > FEW
    if many.any():
        inside = np.repeat(many, sizes)
        large, large_starts = shingle[inside], (np.cumsum(sizes[many]) - sizes[many])
        for b in range(n_bands):
            key = np.full(many.sum(), np.uint64(b))
            for r in range(n_rows):
                lowest = np.minimum.reduceat(mix(large ^ mix(np.array([b * n_rows + r + 1], np.uint64))), large_starts)
                key = mix(key * _GOLDEN + lowest)
            out_owner.append(owner[starts[many]])
            out_key.append(key)
    out_owner, out_key = np.concatenate(out_owner), np.concatenate(out_key).astype(np.int64)
    return np.bincount(out_owner, minlength=len(n)), out_key[np.argsort(out_owner, kind="stable")]


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, at (number), start, end, words, class long, bands array<long> (empty: no shingle of five words) of every paragraph that has words."""
    n_bands, n_rows = tuned_bands(PERCENT / 100)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 500):  # a few hundred texts at a time bound the memory
                part = b.slice(i, 500)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                for owner, words, start, end in located_words(part.column(text).to_pylist()):
                    first = paragraph_starts(owner, words)
                    if not len(first):
                        continue
                    n = np.diff(np.r_[first, len(words)])
                    doc = owner[first]
                    key, (many, bands) = _sequences(words, n), _signatures(words, n, n_bands, n_rows)
                    number = np.arange(len(first)) - np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])[np.cumsum(np.r_[False, doc[1:] != doc[:-1]])]
                    last = end[np.r_[first[1:], len(words)] - 1]
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pa.array(bands))
                    columns = [pa.array(ids[doc]), *(pa.array(x.astype(np.int32)) for x in (number, start[first], last, n)), pa.array(key), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "start", "end", "words", "class", "bands"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return rows.mapInArrow(cut, "doc_id long, at int, start int, end int, words int, class long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """cid, n, tokens of wanted (cid, doc): shingles of one paragraph of each class, found by cutting that document's text again."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (whole.iloc[i : i + 200] for whole in batches for i in range(0, len(whole), 200)):
            sought = list(b["cids"])
            for owner, words, _, _ in located_words(list(b[text])):
                first = paragraph_starts(owner, words)
                if not len(first):
                    continue
                n = np.diff(np.r_[first, len(words)])
                key, doc = _sequences(words, n), owner[first]
                found = [i for d in np.unique(doc) for i in np.flatnonzero((doc == d) & np.isin(key, sought[d]))]
                sets = [shingle_set(words[first[i] : first[i] + n[i]], WORDS) for i in found]
                yield pd.DataFrame({"cid": key[found], "n": np.array([len(s) for s in sets], np.int64), "tokens": [s.tobytes() for s in sets]})

    of_doc = wanted.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("cid").alias("cids"))
    joined = docs.select(F.col("doc_id").cast("long").alias("_id"), text).join(of_doc, F.col("_id") == F.col("_doc")).select(text, "cids")
    return joined.mapInPandas(made, "cid long, n long, tokens binary").dropDuplicates(["cid"])


def collisions(classes: DataFrame) -> DataFrame:
    """class, doc, band: the bands of classes (class, doc, bands) that several of them hold. Saved."""
    across = F.col("least") != F.col("most")
    keys = classes.where(F.size("bands") > 0).select("class", "doc", F.explode("bands").alias("band"))
    met = saved(keys.groupBy("band").agg(F.min("class").alias("least"), F.max("class").alias("most")).where(across).select("band"), "passage-met")
    held = saved(keys.join(small(met, NAMED), "band").distinct(), "passage-bands")
    dropped(met)
    return held


def clusters(docs: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """_class, cluster (its smallest member) of every class of rows (paragraphs, saved) that stands in several documents or is near another class. Saved."""
    ends = rows.groupBy("class").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("_most"), F.first("bands").alias("bands"))
    classes = saved(ends.select("class", "doc", "bands", (F.col("doc") != F.col("_most")).alias("across")), "passage-classes")
    held = collisions(classes)
    exact = saved(classes.where("across").select("class"), "passage-exact")
    dropped(classes)
    sets = saved(_sets(docs, held.select(F.col("class").alias("cid"), "doc").distinct(), text), "passage-sets")
    work = saved(sets.join(held, F.col("cid") == F.col("class")).select(F.col("band").alias("cell"), "cid", "n", "tokens"), "passage-work")
    dropped(sets, held)
    edges = saved(cell_edges(work, PERCENT, CELL, block=CELL // 2), "passage-edges")
    dropped(work)
    near = components(edges)
    named = exact.join(near.withColumnRenamed("node", "class"), "class", "full").select(F.col("class").alias("_class"), F.coalesce("component", "class").alias("cluster"))
    named = saved(named, "passage-named")
    dropped(edges, near, exact)
    return named


def repeated_passages(docs: DataFrame, text: str = "text", run: int = RUN) -> DataFrame:
    """doc_id, start, end, words, cluster, first_doc_id, remove: a row for each paragraph of a passage that repeats across documents.

    A passage has run words or more in neighbouring repeated paragraphs; run=1 gives every paragraph that repeats, however short.
    Null and empty texts have no paragraphs, rows without an id take no part, and of rows that
    repeat with their id the paragraphs count as one document's. remove is false for a
    cluster's first paragraph, by doc_id and start, and true for all others. Columns of docs besides doc_id and the text aren't looked at.
    """
    rows = saved(paragraphs(docs, text), "paragraphs")
    named = clusters(docs, rows, text)
    # repeated classes grow with the corpus, so they meet the paragraphs in a shuffle whatever their number
    found = rows.drop("bands").join(named.hint("merge"), F.col("class") == F.col("_class"))
    # stretches of neighbouring repeated paragraphs
    inside = Window.partitionBy("doc_id").orderBy("at", "start")
    found = found.dropDuplicates(["doc_id", "at", "start", "class"]).withColumn("_run", F.col("at") - F.row_number().over(inside))
    found = found.withColumn("_words", F.sum("words").over(Window.partitionBy("doc_id", "_run"))).where(F.col("_words") >= run)
    found = saved(found.select("doc_id", "start", "end", "words", "cluster"), "passages")
    dropped(rows, named)
    firsts = found.groupBy("cluster").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last")).where(F.col("first.doc_id") != F.col("last"))
    out = found.join(firsts, "cluster")
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") == F.col("first.start"))
    return out.select("doc_id", "start", "end", "words", "cluster", F.col("first.doc_id").alias("first_doc_id"), (~is_first).alias("remove"))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
