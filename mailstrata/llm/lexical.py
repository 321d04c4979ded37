"""Ranked lexical search with a bit-sliced impact index.

The index has a row for every block of documents: its terms, and for each the places of its documents and how often it
stands in them. To search, the impacts of the asked terms are opened as bitmaps, one for each bit of an impact, with a bit for each document of the
block. The scores of an item are the sum of its terms' bitmaps: three numbers at a time become a sum and a carry by bitwise operations, and the last two are
added with a rippling carry, for all documents and many items at once. The best documents are found from the most significant slice
down: as long as more than k candidates have the slice's bit the others go, and where fewer have it they are in.

Blocks are made where the rows lie, and queries come to them in parts of bounded size, so neither documents nor the index move; only k
rows of each task and item do.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, saved, small

#: Terms in a text, and in its lower-cased UTF-8 bytes, where every byte beyond ASCII is part of one.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a block and bytes of their texts; bytes of query terms that are sent to tasks at once; terms that a task holds open; bytes of bitmaps added at once.
BLOCK, BLOCK_BYTES, ASKED_BYTES, OPEN, ADDED_BYTES = 2048, 16 << 20, 8 << 20, 4096, 16 << 20
#: Results of an item.
TOP = 50
INDEX = "ids binary, nameless binary, sizes binary, terms array<string>, df array<int>, places binary, tf binary"


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each block: ids (int64), nameless (bool: the id is null), sizes (int32: terms with repeats), terms, df (documents of each term), and for each term in turn places (uint16) and tf (int32) of its documents.

    Null and empty texts have no terms and aren't in the index; rows that repeat are documents of their own.
    """

    def block(ids, nameless, sizes, postings: dict[bytes, list[int]]) -> pa.RecordBatch:
        terms = sorted(postings)
        flat = np.array([x for t in terms for x in postings[t]], np.int64).reshape(-1, 2)
        df = np.array([len(postings[t]) // 2 for t in terms], np.int32)
        columns = [np.array(ids, np.int64).tobytes(), np.array(nameless, bool).tobytes(), np.array(sizes, np.int32).tobytes()]
        lists = [pa.array([terms], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([df], pa.list_(pa.int32()))]
        ends = [flat[:, 0].astype(np.uint16).tobytes(), flat[:, 1].astype(np.int32).tobytes()]
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in columns), *lists, *(pa.array([x], pa.binary()) for x in ends)], names=["ids", "nameless", "sizes", "terms", "df", "places", "tf"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nameless, sizes, postings, held = [], [], [], {}, 0
        for b in batches:
            for doc, raw in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                raw = raw.as_py()
                found = Counter(TERM_BYTES.findall(raw.lower())) if raw else None
                if not found:
                    continue
                place = len(ids)
                ids.append(doc or 0)
                nameless.append(doc is None)
                sizes.append(found.total())
                for term, tf in found.items():
                    postings.setdefault(term, []).extend((place, tf))
                held += len(raw)
                if len(ids) == BLOCK or held >= BLOCK_BYTES:
                    yield block(ids, nameless, sizes, postings)
                    ids, nameless, sizes, postings, held = [], [], [], {}, 0
        if ids:
            yield block(ids, nameless, sizes, postings)

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(built, INDEX)


def asked_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item (a hash of id and text), item_id, term: each term of an item once; rows that agree in id and text are one item."""
    lower = F.translate(F.col(text), UPPER, LOWER)
    rows = items.select(F.xxhash64(item_id, text).alias("item"), F.col(item_id).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("term"))
    return rows.distinct()


def weighted(index: DataFrame, asked: DataFrame) -> tuple[DataFrame, int, int]:
    """asked with the weight of each term that some document holds (saved), N and L."""
    documents, terms = F.length("nameless"), F.aggregate("df", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = index.select(documents.cast("long").alias("documents"), terms.alias("postings"), F.col("ids"), "sizes")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = [int(np.frombuffer(x, np.int32).sum(dtype=np.int64)) for x in b.column("sizes").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("documents"), pa.array(total, pa.int64())], names=["documents", "size"])

    n, length = sizes.select("documents", "sizes").mapInArrow(summed, "documents long, size long").agg(F.sum("documents"), F.sum("size")).first()
    n, length = n or 0, length or 0
    held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("_term"), F.col("x.df").alias("df"))
    wanted = saved(asked.select(F.col("term").alias("_asked")).distinct(), "lexical-asked")
    df = held.join(small(wanted), F.col("_term") == F.col("_asked"), "left_semi").groupBy("_term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    out = saved(asked.join(df, F.col("term") == F.col("_term")).select("item", "item_id", "term", weight.alias("weight")), "lexical-weights")
    dropped(wanted)
    return out, n, length


def open_slices(rows: np.ndarray, places: np.ndarray, impacts: np.ndarray, n_rows: int, n_docs: int, bits: int) -> np.ndarray:
    """(n_rows, bits, words) bitmaps: bit p of slice b of row r is bit b of the impact at (r, p). Postings lie by row, then place."""
    words = (n_docs + 63) // 64
    out = np.zeros((n_rows, bits, words), np.uint64)
    if not len(rows):
        return out
    at = rows * words + places // 64
    starts = np.flatnonzero(np.r_[True, np.diff(at) != 0])
    row, word = at[starts] // words, at[starts] % words
    bit = (places % 64).astype(np.uint64)
    for b in range(min(bits, int(impacts.max()).bit_length())):
        out[row, b, word] = np.bitwise_or.reduceat((((impacts >> b) & 1).astype(np.uint64)) << bit, starts)
    return out


def add_all(numbers: np.ndarray) -> np.ndarray:
    """The sums over axis 1 of sliced numbers (items, addends, bits, words), in as many bits, which must suffice."""
    while numbers.shape[1] > 2:
        three = numbers.shape[1] // 3 * 3
        a, b, c = (numbers[:, i:three:3] for i in range(3))
        half = a ^ b
        carry = np.zeros_like(a)
        carry[:, :, 1:] = ((a & b) | (c & half))[:, :, :-1]
        numbers = np.concatenate([half ^ c, carry, numbers[:, three:]], 1)
    if numbers.shape[1] == 1:
        return numbers[:, 0]
    a, b = numbers[:, 0], numbers[:, 1]
    out, carry = np.empty_like(a), np.zeros_like(a[:, 0])
    for s in range(a.shape[1]):
        half = a[:, s] ^ b[:, s]
        out[:, s] = half ^ carry
        carry = (a[:, s] & b[:, s]) | (carry & half)
    return out


def best_bits(scores: np.ndarray, k: int) -> np.ndarray:
    """(items, words) bitmaps of the documents whose sliced score (items, bits, words) is above 0 and among the k highest, all that tie with the kth included."""
    tied = np.bitwise_or.reduce(scores, 1)
    inside = np.zeros_like(tied)
    for s in range(scores.shape[1] - 1, -1, -1):
        have = tied & scores[:, s]
        count = np.bitwise_count(inside | have).sum(1)[:, None]
        few = count < k
        tied = np.where(few, tied & ~scores[:, s], have)
        inside = np.where(few, inside | have, inside)
    return inside | tied


def scores_of(scores: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place, score) of every chosen document."""
    flags = np.unpackbits(chosen.view(np.uint8).reshape(len(chosen), -1), axis=1, bitorder="little")
    item, place = np.nonzero(flags)
    total = np.zeros(len(item), np.int64)
    for s in range(scores.shape[1]):
        total += (((scores[item, s, place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1)) << np.uint64(s)).astype(np.int64)
    return item, place, total


def _block_scores(block: dict, items: list[list[tuple[str, int]]], n: int, length: int, k: int):
    """(item number, place, score) of the best documents of one block."""
    df = np.asarray(block["df"], np.int64)
    ends = np.cumsum(df)
    m = 50 + (50 * np.frombuffer(block["sizes"], np.int32).astype(np.int64) * n) // length
    places, tf = np.frombuffer(block["places"], np.uint16).astype(np.int64), np.frombuffer(block["tf"], np.int32).astype(np.int64)
    at = 0
    while at < len(items):
        weights: dict[str, int] = {}
        first = at
        while at < len(items) and (at == first or len(weights) + len(items[at]) <= OPEN):
            weights |= dict(items[at])
            at += 1
        terms = list(weights)
        held = pc.index_in(pa.array(terms, pa.string()), block["terms"])
        number = {t: i for i, (t, x) in enumerate(zip(terms, held.is_valid().to_pylist(), strict=True)) if x}
        number = {t: (j, held[i].as_py()) for j, (t, i) in enumerate(number.items())}
        if not number:
            continue
        which = np.array([i for _, i in number.values()], np.int64)
        many = df[which]
        posting = np.repeat(ends[which] - many - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        row, place = np.repeat(np.arange(len(which)), many), places[posting]
        impact = (1_000_000_000 * tf[posting]) // (1000 * tf[posting] + 20 * m[place])
        impact *= np.repeat(np.array([weights[t] for t in number], np.int64), many)
        wide = [[number[t][0] for t, _ in item if t in number] for item in items[first:at]]
        most = max(map(len, wide))
        bits = max(1, int(impact.max()).bit_length() + most.bit_length())
        slices = open_slices(row, place, impact, len(which) + 1, len(m), bits)  # the last one is 0 and fills items of fewer terms up
        step = max(1, ADDED_BYTES // (most * slices[0].nbytes))
        by_width = sorted(range(len(wide)), key=lambda i: len(wide[i]))
        for part in (by_width[i : i + step] for i in range(0, len(by_width), step)):
            part = [i for i in part if wide[i]]
            if not part:
                continue
            width = max(len(wide[i]) for i in part)
            total = add_all(slices[np.array([wide[i] + [len(which)] * (width - len(wide[i])) for i in part])])
            item, place_, score = scores_of(total, best_bits(total, k))
            yield first + np.array(part)[item], place_, score


def search(index: DataFrame, asked: DataFrame, k: int = TOP) -> DataFrame:
    """item, item_id, rank, doc_id, score: the k documents of highest score above 0 of each item (see asked_terms), equal scores by ascending id, a null one last. Saved."""
    terms, n, length = weighted(index, asked)
    spark = index.sparkSession
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    chunks = math.ceil(size / ASKED_BYTES)
    lists = terms.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    found = spark.createDataFrame([], "item long, nameless boolean, doc_id long, score long")
    for c in range(chunks):
        # ASKED_BYTES of terms at a time come to the blocks
        rows = lists.where(F.pmod(F.xxhash64("item", F.lit(1)), F.lit(chunks)) == c).collect()
        items, names = [[(t["term"], t["weight"]) for t in r["terms"]] for r in rows], np.array([r["item"] for r in rows], np.int64)

        def searched(batches: Iterator[pa.RecordBatch], items=items, names=names) -> Iterator[pa.RecordBatch]:
            best = np.zeros((4, 0), np.int64)  # item, nameless, id, score
            for b in batches:
                for i in range(len(b)):
                    block = {c: b.column(c)[i].values if c in ("terms", "df") else b.column(c)[i].as_py() for c in b.schema.names}
                    ids, nameless = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["nameless"], bool)
                    new = [np.stack([item, nameless[place], ids[place], score]) for item, place, score in _block_scores(block, items, n, length, k)]
                    best = np.concatenate([best, *new], 1)
                    best = best[:, np.lexsort((best[2], best[1], -best[3], best[0]))]
                    first = np.flatnonzero(np.r_[True, np.diff(best[0]) != 0]) if best.shape[1] else np.zeros(0, np.int64)
                    rank = np.arange(best.shape[1]) - np.repeat(first, np.diff(np.r_[first, best.shape[1]]))
                    best = best[:, rank < k]
            yield pa.RecordBatch.from_arrays([pa.array(names[best[0]] if len(names) else best[0]), pa.array(best[1].astype(bool)), pa.array(best[2]), pa.array(best[3])], names=["item", "nameless", "doc_id", "score"])

        found = found.unionByName(index.mapInArrow(searched, "item long, nameless boolean, doc_id long, score long"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "nameless", "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = small(asked.select(F.col("item").alias("_item"), "item_id").distinct())
    named = ranked.join(ids, F.col("item") == F.col("_item"))
    out = saved(named.select("item", "item_id", "rank", F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "score"), "lexical-best")
    dropped(terms)
    return out


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of docs for each row of items.

    Documents and items without a term, null and empty texts among them, have no results. Rows of docs that repeat are documents of their own, items that
    agree in id and text are one, and an id with several texts has results for each. Empty tables give no rows; other columns aren't looked at.
    """
    index = saved(build_index(docs, text, doc_id), "lexical-index")
    asked = saved(asked_terms(items, item_id, item_text), "lexical-items")
    out = search(index, asked, k).select("item_id", "rank", "doc_id", "score")
    dropped(index, asked)
    return out


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return rank_documents(docs.select("doc_id", "text"), items.select("item_id", "text"))


ORACLE = r"""
WITH t AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
tf AS MATERIALIZED (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY row, doc_id, term),
docs AS MATERIALIZED (SELECT row, sum(tf) AS n FROM tf GROUP BY row),
all_docs AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM docs),
m AS (SELECT row, 100 - 50 + (CAST(50 * n * nn AS BIGINT) // l) AS m FROM docs, all_docs),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM asked JOIN df USING (term), all_docs),
s AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM w JOIN tf USING (term) JOIN m USING (row) GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
