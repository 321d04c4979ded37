"""Exact Jaccard join of word shingle sets as a metric-space join.

Jaccard distance is a metric, and the empty set is a point of it at distance 1 from all others. Pivots are
documents and the empty set; each makes a Voronoi region. With the radius r, x and y linked and x no
farther from its nearest pivot p than y from its own, the triangle inequality gives
d(y, p) <= d(y, nearest pivot of y) + r: a document is replicated into all regions within r of its nearest one.
One that shares nothing with a pivot is not sent there for that: its partners in that region are at least 1 - r from
the pivot, so they are in the region of the empty set too, as it is. A pivot's own links are known from its distances, so it leaves;
regions get pivots again until all their documents are connected or one is left. Every candidate comes to its links this way, in cells of two as in large ones.

Unrelated documents are at distance 1 from almost every pivot, so the region of the empty set would hold
nearly all of a large corpus for many rounds. Two bounds that lose no pair cut the corpus first. Shingles that only one
document holds count against every partner: a document with too many of them has none. To count them, each
shingle is sent once per chunk of documents as 32 bits within a bucket of a few MB of text, which can only take
a lone shingle for a shared one, never the reverse. The others are put into cells: a linked pair shares one of the
rarest shingles of each side, as many as a partner can lack plus one, and its sizes are within the window that the distance
to the empty set in the symmetric difference allows. Cells are the components of these ties; the first regions of a cell of more than CELL documents
are made by Spark, with a table for each round, those of all others in the task that holds the cell. What ROUNDS of pivots don't
separate, since all its documents are about as near to one another, is dealt to blocks, and every pair of blocks gets pivots of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, dropped, saved, small
from .components import components
from .shingles import fingerprint, mix, shingle_sets

#: Documents of a cell whose regions one task makes, most pivots of a region and documents for each of them, rounds of pivots by Spark, documents of a block after that.
CELL, PIVOTS, DOCUMENTS_OF_PIVOT, ROUNDS, BLOCK = 512, 8, 6, 4, 256
#: Pivots separate where no region keeps more than this share of the documents, and all regions together hold no more than this many times as many.
SHRUNK, SPREAD = 0.75, 2.0
#: Shingles that one task joins, bytes of text whose shingles one bucket counts, and those that one task reads.
TASK_SHINGLES, BUCKET_BYTES, TASK_BYTES = 1 << 20, 4 << 20, 32 << 20
#: Bytes of pivots that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Characters of text whose shingles a worker holds at once.
CHUNK = 2 << 20
SHARED = "doc_id long, key long, n long, f1 long, f2 long, shared long"


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _chunks(b: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    """b in parts of about CHUNK characters, one row at least."""
    upto = b[text].str.len().fillna(0).cumsum().to_numpy(np.int64)
    part = upto // CHUNK
    for i in np.unique(part):
        yield b[part == i].reset_index(drop=True)


def row_key(text: str):
    """A hash of a row's id and text: rows that agree in both are one."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col(text))


def tasks_for(docs: DataFrame, text: str) -> tuple[int, int]:
    """Buckets of BUCKET_BYTES of text and tasks of TASK_BYTES, no fewer than the session's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(64, math.ceil(size / BUCKET_BYTES)), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))


def shared_counts(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, key (row_key), n (distinct shingles), fingerprints f1 and f2, and how many of its shingles another row holds, or may hold."""
    buckets, tasks = tasks_for(docs, text)

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts = (part for b in batches for part in _chunks(b, text))
        for number, b in enumerate(parts):
            chunk = (TaskContext.get().partitionId() << 32) + number
            sets = shingle_sets(list(b[text]), k)
            n = np.array([len(s) for s in sets], np.int64)
            prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            tokens, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets), dtype=np.int32), n)
            del sets
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            first = np.r_[True, tokens[1:] != tokens[:-1]] if len(tokens) else np.zeros(0, bool)
            times = np.diff(np.r_[np.flatnonzero(first), len(tokens)])
            several = np.repeat(times > 1, times)
            here = np.bincount(owner[several], minlength=len(n))
            own, tokens = np.where(several, np.int32(len(n)), owner)[first], tokens[first]
            bucket = ((tokens >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((own, bucket))
            own, tokens, bucket = own[order], tokens[order].astype(np.uint32), bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [(int(i), chunk, _blob(tokens[a:z]), _blob(np.bincount(own[a:z], minlength=len(n) + 1).astype(np.uint32))) for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
            missing = b["doc_id"].isna().to_numpy()
            side = np.stack([b["doc_id"].fillna(0).to_numpy(np.int64), b["key"].to_numpy(np.int64), missing.astype(np.int64), n, prints[:, 0], prints[:, 1], here])
            rows.append((buckets + chunk % buckets, chunk, _blob(side), b""))
            yield pd.DataFrame(rows, columns=["bucket", "chunk", "tokens", "counts"])

    def counted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= buckets:
            return pd.DataFrame({"chunk": rows["chunk"], "side": True, "data": rows["tokens"]})
        parts = [np.frombuffer(t, np.uint32) for t in rows["tokens"]]
        values, times = np.unique(np.concatenate(parts), return_counts=True)
        often = values[times > 1]
        out = []
        for tokens, counts in zip(parts, rows["counts"], strict=True):
            owner = np.repeat(np.arange(len(counts) // 4), np.frombuffer(counts, np.uint32))
            at = np.searchsorted(often, tokens)
            hit = (at < len(often)) & (often[np.minimum(at, len(often) - 1)] == tokens) if len(often) else np.zeros(len(tokens), bool)
            out.append(_blob(np.bincount(owner[hit], minlength=len(counts) // 4)[:-1].astype(np.uint32)))
        return pd.DataFrame({"chunk": rows["chunk"], "side": False, "data": out})

    def summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        doc_id, keys, missing, n, f1, f2, here = np.frombuffer(rows.loc[rows["side"], "data"].iloc[0], np.int64).reshape(7, -1)
        shared = here.copy()
        for data in rows.loc[~rows["side"], "data"]:
            shared += np.frombuffer(data, np.uint32)
        ids = pd.array(doc_id, dtype="Int64")
        ids[missing == 1] = pd.NA
        return pd.DataFrame({"doc_id": ids, "key": keys, "n": n, "f1": f1, "f2": f2, "shared": shared})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(text).alias("key"), text)
    sent = rows.mapInPandas(mapped, "bucket long, chunk long, tokens binary, counts binary").repartition(tasks, "bucket")
    back = sent.groupBy("bucket").applyInPandas(counted, "chunk long, side boolean, data binary")
    return back.groupBy("chunk").applyInPandas(summed, SHARED)


def least_shared(n, percent: int):
    """Shingles of a set of n that a partner must hold."""
    return F.ceil(F.col(n) * percent / 100).cast("long") if isinstance(n, str) else F.ceil(n * percent / 100).cast("long")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int, text: str = "text") -> DataFrame:
    """cid, n, tokens binary of wanted (cid, key, n, f1, f2): the sorted shingles of the row of docs with that key and fingerprint."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (part for whole in batches for part in _chunks(whole, text)):
            sets = shingle_sets(list(b[text]), k)
            fits = [len(s) == n and fingerprint(s) == (f1, f2) for s, n, f1, f2 in zip(sets, b["n"], b["f1"], b["f2"], strict=True)]
            yield pd.DataFrame({"cid": b["cid"][fits], "n": b["n"][fits], "tokens": [_blob(s) for s, ok in zip(sets, fits, strict=True) if ok]})

    rows = docs.select(row_key(text).alias("_key"), text)
    # a table counted to be small is broadcast; beyond that keys and texts meet in a shuffle join
    joined = rows.join(small(wanted, 4 * BROADCAST_ROWS), F.col("_key") == F.col("key")).select("cid", "n", "f1", "f2", text)
    return joined.mapInPandas(made, "cid long, n long, tokens binary")


def opened(sets: DataFrame) -> DataFrame:
    """cid, n, token: a row for every shingle of sets (cid, n, tokens)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (whole.iloc[i : i + 250] for whole in batches for i in range(0, len(whole), 250)):
            tokens = np.frombuffer(b"".join(b["tokens"]), np.int64)
            yield pd.DataFrame({"cid": np.repeat(b["cid"].to_numpy(), b["n"]), "n": np.repeat(b["n"].to_numpy(), b["n"]), "token": tokens})

    return sets.mapInPandas(rows, "cid long, n long, token long")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """cid, n, token: of each set the rarest shingles that others hold, as many as a partner may lack plus one, less those no other holds."""
    # counts are summed before they move, and Spark splits a token of very many sets in the join
    tokens = opened(sets)
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    held = tokens.join(often, "token").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held"))
    room = F.col("n") - least_shared("n", percent) + 1 - (F.col("n") - F.size("held"))
    return held.where(room > 0).select("cid", "n", F.explode(F.slice("held", 1, F.least(room, F.size("held")).cast("int"))).alias("x")).select("cid", "n", F.col("x.token").alias("token"))


def within(d, nearest, percent: int):
    """Whether a document at distance d from a document pivot belongs to its region, by the distance to its nearest pivot; arrays or columns."""
    return (d < 1) & (d <= nearest + (1 - percent / 100) + 1e-9)


def beyond(nearest, percent: int):
    """Whether a document belongs to the region of the empty set."""
    return nearest + (1 - percent / 100) + 1e-9 >= 1


def pivot_overlaps(region: np.ndarray, doc: np.ndarray, rank: np.ndarray, wanted: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, hold: int = 1 << 22) -> np.ndarray:
    """(rows, PIVOTS): shingles that each row's document shares with each pivot of its region; a region's pivots are its first wanted rows.

    Rows lie by region; set j holds sizes[j] of tokens, one set after the other. The shingles of whole regions, about hold of them at a time, are sorted once for all pivots.
    """
    firsts = np.cumsum(sizes) - sizes
    out = np.zeros((len(doc), PIVOTS), np.int64)
    begins = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
    held = np.add.reduceat(sizes[doc], begins)
    part = np.cumsum(held) // hold
    cuts = np.r_[begins[np.flatnonzero(np.r_[True, part[1:] != part[:-1]])], len(doc)]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        n = sizes[doc[a:z]]
        row = np.repeat(np.arange(z - a), n)
        token = tokens[np.repeat(firsts[doc[a:z]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        place = np.unique(mix(token + region[a:z][row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)[1]
        own = rank[a:z] < wanted[region[a:z]]
        of_pivot = own[row]
        mask = np.zeros(place.max(initial=-1) + 1, np.uint8)
        np.bitwise_or.at(mask, place[of_pivot], (1 << rank[a:z][row[of_pivot]]).astype(np.uint8))
        met = mask[place]
        for j in range(int(wanted[region[a:z]].max())):
            out[a:z, j] = np.bincount(row[(met >> j) & 1 == 1], minlength=z - a)
    return out


def _joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (the least place of each component), with the components of a[i] and b[i] made one."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def _next_regions(region: np.ndarray, doc: np.ndarray, pair_row: np.ndarray, slot: np.ndarray, d: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(region, doc) of the regions that the pivots make of each region; d: distance of row pair_row to the pivot of that slot. A region that they don't separate stays whole."""
    nearest = np.full(len(doc), 1.0)
    np.minimum.at(nearest, pair_row, d)
    there = within(d, nearest[pair_row], percent)
    empty = np.flatnonzero(beyond(nearest, percent))
    rows, slots = np.r_[pair_row[there], empty], np.r_[slot[there], np.full(len(empty), -1)]
    made = region[rows] * (PIVOTS + 1) + slots + 1
    before = np.bincount(region)
    names, number = np.unique(made, return_inverse=True)
    held = np.bincount(number)
    parent = names // (PIVOTS + 1)
    most, total = np.zeros(len(before), np.int64), np.bincount(parent, held, len(before))
    np.maximum.at(most, parent, held)
    stuck = (most > SHRUNK * before) | (total > SPREAD * before)
    keep, whole = ~stuck[region[rows]], stuck[region]
    return np.unique(np.r_[made[keep], -1 - region[whole]], return_inverse=True)[1], np.r_[doc[rows[keep]], doc[whole]]


def region_edges(cells: np.ndarray, ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, met): edges (id, id) that connect all linked pairs of each cell, and for each row how many distances to pivots were taken.

    All cells go through the same rounds together. In a round every region chooses pivots, documents of its smaller components first; all its
    documents are measured against them, which finds every link of a pivot, and the others go on to the regions of the pivots within the
    windows. A region whose documents are connected already, or that has one, is done.
    """
    label = np.arange(len(ids))
    met = np.zeros(len(ids), np.int64)
    out = [np.zeros((0, 2), np.int64)]
    region, doc = np.unique(cells, return_inverse=True)[1], np.arange(len(ids))
    depth = 0
    while True:
        low, high = np.full(region.max(initial=-1) + 1, len(ids)), np.full(region.max(initial=-1) + 1, -1)
        np.minimum.at(low, region, label[doc])
        np.maximum.at(high, region, label[doc])
        open_ = low[region] < high[region]
        region, doc = np.unique(region[open_], return_inverse=True)[1], doc[open_]
        if not len(doc):
            return np.concatenate(out), met
        # pivots: the documents of the smaller components of a region first, then by a hash
        common = np.unique(np.stack([region, label[doc]], 1), axis=0, return_inverse=True, return_counts=True)
        order = np.lexsort((mix(ids[doc].astype(np.uint64) + np.uint64(depth)), common[2][common[1].ravel()], region))
        region, doc = region[order], doc[order]
        held = np.bincount(region)
        first = np.cumsum(held) - held
        rank = np.arange(len(doc)) - first[region]
        wanted = np.clip(held // DOCUMENTS_OF_PIVOT, 1, PIVOTS)
        pivot = rank < wanted[region]
        # every other document of the region against each of its pivots
        many = wanted[region]
        pair_row = np.repeat(np.arange(len(doc)), many)
        slot = np.arange(len(pair_row)) - np.repeat(np.cumsum(many) - many, many)
        pair_pivot = first[region[pair_row]] + slot
        other = pair_row != pair_pivot
        pair_row, slot, pair_pivot = pair_row[other], slot[other], pair_pivot[other]
        a, b = doc[pair_row], doc[pair_pivot]
        both = pivot_overlaps(region, doc, rank, wanted, sizes, tokens)[pair_row, slot]
        union = sizes[a] + sizes[b] - both
        np.add.at(met, a, 1)
        np.add.at(met, b, 1)
        linked = 100 * both >= percent * union
        new = label[a[linked]] != label[b[linked]]
        out.append(np.stack([ids[a[linked][new]], ids[b[linked][new]]], 1))
        label = _joined_labels(label, a[linked], b[linked])
        rest = ~pivot
        number = np.cumsum(rest) - 1
        left = rest[pair_row]
        region, doc = _next_regions(region[rest], doc[rest], number[pair_row[left]], slot[left], 1 - both[left] / union[left], percent)
        depth += 1


def _joined(work: DataFrame, key: str, percent: int, shingles: int) -> DataFrame:
    """Edges a, b that connect all linked pairs within each cell; cells of work are joined a bucket at a time."""
    buckets = max(int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(shingles / TASK_SHINGLES))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates([key, "cid"])
        edges, _ = region_edges(rows[key].to_numpy(np.int64), rows["cid"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), np.frombuffer(b"".join(rows["tokens"]), np.uint64), percent)
        return pd.DataFrame(edges, columns=["a", "b"])

    dealt = work.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).repartition(buckets, "_bucket")
    return dealt.groupBy("_bucket").applyInPandas(join, "a long, b long")


def _measured(large: DataFrame, depth: int) -> DataFrame:
    """cell, cid, slot, pivot, both, n, pivot_n for every document of large (cell, cid, n, tokens) and each of its cell's PIVOTS pivots. Saved."""
    order = Window.partitionBy("cell").orderBy(F.xxhash64("cid", F.lit(depth)), "cid")
    chosen = large.select("cell", "cid", "n", "tokens").withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= PIVOTS)
    chosen = saved(chosen.select(F.col("cell").alias("_cell"), F.col("cid").alias("pivot"), F.col("n").alias("pivot_n"), F.col("tokens").alias("pivot_tokens"), "slot"), "jaccard-pivots")
    size = chosen.agg(F.sum(F.length("pivot_tokens"))).first()[0] or 0
    rows = large.join(F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen, F.col("cell") == F.col("_cell"))

    def overlap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = zip(b["tokens"], b["pivot_tokens"], strict=True)
            both = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in pairs]
            yield b.drop(columns=["tokens", "pivot_tokens"]).assign(both=np.array(both, np.int64))

    rows = rows.select("cell", "cid", "n", "slot", "pivot", "pivot_n", "tokens", "pivot_tokens")
    out = saved(rows.mapInPandas(overlap, "cell long, cid long, n long, slot int, pivot long, pivot_n long, both long"), "jaccard-distances")
    dropped(chosen)
    return out


def _blocked(large: DataFrame, percent: int, block: int) -> DataFrame:
    """Edges between all linked pairs of each cell of large (cell, docs, cid, n, tokens): every pair of blocks is joined, each document goes to as many as its cell has."""
    n = F.ceil(F.col("docs") / block).cast("int")
    own = F.pmod(F.xxhash64("cid", F.lit(99)), n).cast("int")
    dealt = large.select("cell", "cid", "n", "tokens", own.alias("_own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_other"))
    dealt = dealt.withColumn("pair", F.xxhash64("cell", F.least("_own", "_other"), F.greatest("_own", "_other")))
    shingles = large.agg(F.sum(F.col("n") * n)).first()[0] or 0
    return saved(_joined(dealt, "pair", percent, int(shingles)), "jaccard-edges")


def cell_edges(work: DataFrame, percent: int, cell: int = CELL, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """Edges a, b that connect all linked pairs within the cells of work (cell, cid, n, tokens; saved)."""
    edges, given = None, work
    for depth in range(rounds + 1):
        sizes = saved(work.groupBy("cell").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")), "jaccard-cells")
        few = work.join(small(sizes.where(F.col("docs") <= cell).select("cell")), "cell")
        total = sizes.agg(F.sum(F.when(F.col("docs") <= cell, F.col("shingles"))), F.sum((F.col("docs") > cell).cast("long"))).first()
        found = saved(_joined(few, "cell", percent, total[0] or 0), "jaccard-edges")
        edges = found if edges is None else edges.unionByName(found)
        if not total[1]:
            break
        large = work.join(small(sizes.where(F.col("docs") > cell)), "cell")
        if depth == rounds:
            edges = edges.unionByName(_blocked(large, percent, block))
            break
        table = measured = _measured(large, depth)
        union = F.col("n") + F.col("pivot_n") - F.col("both")
        linked = 100 * F.col("both") >= percent * union
        measured = measured.withColumns({"d": 1 - F.col("both") / union, "linked": linked})
        edges = edges.unionByName(saved(measured.where("linked AND cid != pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")), "jaccard-edges"))
        near = measured.groupBy("cell", "cid").agg(F.min("d").alias("nearest"), F.collect_list(F.struct("slot", "d", "linked")).alias("at"))
        there = F.transform(F.filter("at", lambda p: within(p["d"], F.col("nearest"), percent)), lambda p: F.struct(p["slot"].alias("slot"), p["linked"].alias("linked")))
        far = F.when(beyond(F.col("nearest"), percent), F.array(F.struct(F.lit(0).alias("slot"), F.lit(False).alias("linked")))).otherwise(F.array().cast("array<struct<slot:int,linked:boolean>>"))
        regions = saved(near.select("cell", "cid", F.explode(F.concat(there, far)).alias("x")).select("cell", "cid", "x.*"), "jaccard-regions")
        held = regions.groupBy("cell", "slot").agg(F.count(F.lit(1)).alias("held"), F.sum((~F.col("linked")).cast("long")).alias("open"))
        # where all are linked to the pivot nothing is left to find
        held = saved(held.where(F.col("open") > 0), "jaccard-held")
        # cells that pivots don't separate, since all is about as near to one another
        stuck = held.groupBy("cell").agg(F.sum("held").alias("all"), F.max("held").alias("most")).join(sizes, "cell").where((F.col("all") > SPREAD * F.col("docs")) | (F.col("most") > SHRUNK * F.col("docs")))
        stuck = saved(stuck.select("cell", "docs"), "jaccard-stuck")
        if not stuck.isEmpty():
            edges = edges.unionByName(_blocked(work.join(small(stuck), "cell"), percent, block))
        left = held.join(small(stuck), "cell", "left_anti").select("cell", "slot")
        placed = regions.join(small(saved(left, "jaccard-open")), ["cell", "slot"]).select("cell", "cid", F.xxhash64("cell", "slot", F.lit(depth)).alias("_region"))
        before, work = work, saved(large.select("cell", "cid", "n", "tokens").join(placed, ["cell", "cid"]).select(F.col("_region").alias("cell"), "cid", "n", "tokens"), "jaccard-work")
        dropped(table, regions, before if before is not given else None)
    return edges


def linked_rows(docs: DataFrame, k: int, percent: int, cell: int = CELL, text: str = "text") -> DataFrame:
    """doc_id, key (row_key), n_shingles, group long, component_id for every row of docs; a group is what links connect, null for rows that no other row is linked with.

    Rows of one set, repeated rows included, are one class, rows without an id too; a class never goes by an id, so different texts under one id
    stay apart. component_id is the smallest id of the group (null if none of its rows has one), for a row alone its own.
    """
    if not 0 < percent < 100:
        raise ValueError("percent must be between 0 and 100")
    rows = saved(shared_counts(docs, k, text), "jaccard-counts")
    classes = class_rows(rows, F.max("shared").alias("shared"))
    wanted = saved(classes.where(F.col("shared") >= least_shared("n", percent)).select("cid", "key", *CLASS), "jaccard-wanted")
    sets = saved(sets_of(docs, wanted, k, text).dropDuplicates(["cid"]), "jaccard-sets")
    # a pair's sizes lie in one band or in neighbouring ones: each document goes to its band and the next
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")
    placed = saved(prefixes(sets, percent).select("cid", "token", F.explode(F.array(band, band + 1)).alias("band")), "jaccard-ties")
    ties = placed.groupBy("token", "band").agg(F.min("cid").alias("least"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") > 1)
    cells = components(placed.join(ties, ["token", "band"]).select(F.col("cid").alias("a"), F.col("least").alias("b")))
    work = saved(sets.join(cells, F.col("cid") == F.col("node")).select(F.col("component").alias("cell"), "cid", "n", "tokens"), "jaccard-cells")
    dropped(wanted, sets, placed, cells)
    found = components(cell_edges(work, percent, cell))
    dropped(work)
    return named_rows(rows, classes, found)


#: What the rows of one set agree in.
CLASS = ["n", "f1", "f2"]


def class_rows(rows: DataFrame, *more) -> DataFrame:
    """n, f1, f2, cid (their hash), least (smallest id), key (of one row), copies and the aggregates more of every set of rows that has a shingle."""
    classes = rows.where(F.col("n") > 0).groupBy(*CLASS).agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), *more)
    return classes.withColumn("cid", F.xxhash64(*CLASS))


def named_rows(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, group, component_id for every row of rows; found: node (cid) and component."""
    # classes of one row that are linked with nothing need no lookup
    named = classes.join(found, F.col("cid") == F.col("node"), "left").where((F.col("copies") > 1) | F.col("component").isNotNull())
    named = saved(named.select(*[F.col(c).alias(f"_{c}") for c in CLASS], "least", F.coalesce("component", "cid").alias("group")), "named-classes")
    groups = named.groupBy(F.col("group").alias("_group")).agg(F.min("least").alias("_component"))
    named = named.join(groups, F.col("group") == F.col("_group")).drop("_group", "least")
    same = [F.col(c) == F.col(f"_{c}") for c in CLASS]
    return rows.join(named, same, "left").select("doc_id", "key", F.col("n").alias("n_shingles"), "group", F.coalesce("_component", "doc_id").alias("component_id"))


def link_documents(docs: DataFrame, k: int, percent: int, cell: int = CELL, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs: documents link when their shingle sets' Jaccard index is percent / 100 or more.

    component_id is the smallest id reachable by links. Null and empty texts and those without words are linked with nothing. Rows of one
    set, repeated rows included, are one class; a null id belongs to its class but never names it. Other columns of docs are not looked at.
    """
    return linked_rows(docs, k, percent, cell, text).select("doc_id", "n_shingles", "component_id")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 3, 90)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS x FROM documents)),
t AS (SELECT doc_id, i, word || coalesce(' ' || lead(word, 1) OVER p, '') || coalesce(' ' || lead(word, 2) OVER p, '') AS shingle, count(*) OVER (PARTITION BY doc_id) AS words
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, shingle FROM t WHERE i <= greatest(words - 2, 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.v FROM reach r JOIN (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
