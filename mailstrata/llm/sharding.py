"""Resharding by minimum-cost flow: new capacities with the fewest bytes moved, then only affected files rewritten.

Rows lie in old shards by the hash of their text, equal texts together, so copies make old
shards uneven. Each old shard consists of blocks by the hash of the row's id, which split even a
group of copies evenly. The driver sees only the block sizes, at most old shards times BLOCKS of
them. A flow from old shards (what they hold) to new shards (what they may hold), where staying
costs nothing and moving costs its bytes, says how many bytes go from where to where; blocks,
largest first, fill these amounts, and the smallest ones even out what remains.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved, shared_dir

#: New shards, old shards, blocks of an old shard, bytes that a row costs besides its text, tasks that may write one shard.
SHARDS, OLD_SHARDS, BLOCKS, ROW_BYTES, WRITERS = 40, 32, 1024, 16, 64


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Amounts {(i, j): > 0} that send every supply to capacities at the least sum of amount times cost(i, j), by shortest augmenting paths.

    The capacities must hold the supplies.
    """
    if sum(supply) > sum(capacity):
        raise ValueError(f"{sum(supply)} don't fit into {sum(capacity)}")
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, room = list(supply), list(capacity)
    n, m = len(supply), len(capacity)
    price_i, price_j = [0] * n, [0] * m  # potentials keep reduced costs at 0 or above
    while any(left):
        near, came, done = {}, {}, set()
        heap = [(0, 0, i) for i in range(n) if left[i]]
        near.update({(0, i): 0 for _, _, i in heap})
        heapq.heapify(heap)
        goal = None
        while heap:
            d, side, a = heapq.heappop(heap)
            if (side, a) in done:
                continue
            done.add((side, a))
            if side == 1 and room[a] and goal is None:
                goal = (a, d)
                break
            if side == 0:
                steps = ((j, cost(a, j) + price_i[a] - price_j[j]) for j in range(m))
            else:
                steps = ((i, price_j[a] - price_i[i] - cost(i, a)) for i in range(n) if flow.get((i, a)))
            for b, c in steps:
                if d + c < near.get((1 - side, b), float("inf")):
                    near[1 - side, b] = d + c
                    came[1 - side, b] = a
                    heapq.heappush(heap, (d + c, 1 - side, b))
        j, reach = goal
        for side, prices in ((0, price_i), (1, price_j)):
            for a in range(len(prices)):
                prices[a] += min(near.get((side, a), reach), reach)
        path, at = [], (1, j)
        while at in came:
            path.append((came[at], at))
            at = (1 - at[0], came[at])
        amount = min([left[at[1]], room[j], *(flow[x[1], a] for a, x in path if x[0] == 0)])
        for a, (side, b) in path:
            if side == 1:
                flow[a, b] += amount
            else:
                flow[b, a] -= amount
        left[at[1]] -= amount
        room[j] -= amount
    return {k: v for k, v in flow.items() if v}


def assign_blocks(sizes: dict[tuple[int, int], int], old: int, new: int) -> dict[tuple[int, int], int]:
    """(old shard, block) -> new shard, near-equal bytes; old shard i goes on as new shard i where there is one."""
    total = sum(sizes.values())
    supply = [0] * old
    for (i, _), size in sizes.items():
        supply[i] += size
    capacity = [total // new + (j < total % new) for j in range(new)]
    flow = min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    room: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), amount in flow.items():
        room[i][j] = amount
    chosen, load = {}, [0] * new
    for (i, b), size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        j = max(room[i], key=lambda j: (room[i][j], j == i, -j)) if room[i] else min(range(new), key=lambda j: (load[j], j))
        chosen[i, b] = j
        load[j] += size
        if room[i]:
            room[i][j] -= size
    return _evened(sizes, chosen, load)


def _evened(sizes, chosen, load):
    """Blocks go from the fullest to the emptiest shard while that brings the two nearer: the one nearest to half the difference."""
    inside: dict[int, list] = defaultdict(list)
    for k, j in chosen.items():
        inside[j].append((sizes[k], k))
    for _ in range(4 * len(load)):
        most, least = max(range(len(load)), key=lambda j: (load[j], -j)), min(range(len(load)), key=lambda j: (load[j], j))
        gap = load[most] - load[least]
        fits = [x for x in inside[most] if 0 < x[0] < gap]
        if not fits:
            break
        best = min(fits, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        inside[most].remove(best)
        inside[least].append(best)
        chosen[best[1]] = least
        load[most] -= best[0]
        load[least] += best[0]
    return chosen


def _content(text: str) -> F.Column:
    return F.coalesce(F.col(text), F.lit(""))


def _crc(text: str) -> F.Column:
    return F.crc32(_content(text).cast("binary"))


def _old_shard(text: str, old: int) -> F.Column:
    return F.pmod(F.xxhash64(_content(text)), F.lit(old)).cast("int")


def _block(doc_id: str, text: str, blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(doc_id), _crc(text)), F.lit(blocks)).cast("int")


def _slim(docs: DataFrame, old: int, blocks: int, text: str, doc_id: str, *more: str) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, block and the columns more of every row, saved."""
    size = (F.octet_length(_content(text)) + ROW_BYTES).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), _crc(text).alias("text_crc32"), _old_shard(text, old).alias("old_shard"), _block(doc_id, text, blocks).alias("block"), *more)
    return saved(rows, "shard-rows")


def _plan(rows: DataFrame, new: int, old: int) -> DataFrame:
    """old_shard, block, shard, first (slot) of every block of rows (see _slim)."""
    held = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    chosen = assign_blocks({(r["old_shard"], r["block"]): r["size"] for r in held}, old, new)
    plan, at = [], [0] * new
    for r in sorted(held):
        j = chosen[r["old_shard"], r["block"]]
        plan.append((r["old_shard"], r["block"], j, at[j]))
        at[j] += r["rows"]
    return rows.sparkSession.createDataFrame(plan, "old_shard int, block int, shard int, first long")


def _slots(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with the columns of their block's plan and slot."""
    inside = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("_n", F.row_number().over(inside) - 1).join(F.broadcast(plan), ["old_shard", "block"])
    return placed.withColumn("slot", F.col("first") + F.col("_n"))


def _bounded(old: int, blocks: int) -> None:
    if old * blocks > BROADCAST_ROWS:
        raise ValueError(f"the plan of {old * blocks} blocks is sent to every task; at most {BROADCAST_ROWS} are")


def reshard(docs: DataFrame, new: int = SHARDS, old: int = OLD_SHARDS, blocks: int = BLOCKS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot for every row; slots of a shard go from 0 without gaps.

    Bytes near equal and copies of one text kept together exclude one another where a group of copies is larger than a shard, and the law is on bytes: copies
    lie together in old shards only, blocks are made by ids and split them. A null text has no bytes and the CRC of an empty one. Rows that agree in id and text are
    interchangeable and stay in one block. An empty table gives no rows.
    """
    _bounded(old, blocks)
    rows = _slim(docs, old, blocks, text, doc_id)
    return _slots(rows, _plan(rows, new, old)).select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")


def reshard_files(docs: DataFrame, path: str, new: int = SHARDS, old: int = OLD_SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """What reshard gives for docs (doc_id, text), carried out: old shards are written under path, the affected ones rewritten, and every column comes from the files then in force."""
    _bounded(old, blocks)
    spark = docs.sparkSession
    write_shards(docs.withColumn("old_shard", _old_shard("text", old)), path, "old_shard")
    plan = _plan(_slim(read_shards(spark, path, docs.schema), old, blocks, "text", "doc_id"), new, old)
    affected = {r[0] for r in plan.where("old_shard != shard").select(F.explode(F.array("old_shard", "shard"))).distinct().collect()}

    def moved(rows: DataFrame) -> DataFrame:
        keyed = rows.drop("shard").withColumns({"old_shard": _old_shard("text", old), "block": _block("doc_id", "text", blocks)})
        return keyed.join(F.broadcast(plan.drop("first")), ["old_shard", "block"]).select(*docs.columns, "shard")

    _rewrite(spark, path, affected, moved, docs.schema)
    rows = _slim(read_shards(spark, path, docs.schema), old, blocks, "text", "doc_id", "shard")
    return _slots(rows, plan.drop("shard")).select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")


MANIFEST = "shard int, path string"


def write_shards(rows: DataFrame, path: str, shard: str) -> None:
    """The first generation: rows under path by their shard column, and a manifest of each shard's folder."""
    _write(rows.sparkSession, rows.withColumnRenamed(shard, "shard"), path, {})


def read_shards(spark, path: str, schema=None, only: set[int] | None = None) -> DataFrame:
    """All rows of the present generation (only: of these shards), with shard. An empty one needs the schema of its rows."""
    found = sorted((s, p) for s, p in _manifest(spark, path).items() if only is None or s in only)
    if not found:
        return spark.createDataFrame([], schema).withColumn("shard", F.lit(0))
    reader = spark.read.schema(schema) if schema else spark.read
    # one scan of all folders; a file's folder names its shard
    rows = reader.parquet(*[p for _, p in found])
    return rows.withColumn("shard", F.regexp_extract("_metadata.file_path", r"/shard=(\d+)/", 1).cast("int"))


def rewrite_affected(spark, path: str, moves: DataFrame, text: str = "text") -> list[int]:
    """Rewrite the files of the shards that lose or gain rows; the others' files stay. Returns the shards rewritten.

    moves: doc_id (null too), old_shard, text_crc32, shard, as reshard gives them; one shard holds all rows that agree in the first
    three, since they are of one block. New files go to a folder of their own and the manifest, written last,
    turns to them; an interrupted run leaves the old generation in force.
    """
    changed = moves.where(F.col("old_shard") != F.col("shard"))
    affected = {r[0] for r in changed.select("old_shard").union(changed.select("shard")).distinct().collect()}
    to = moves.select(F.col("doc_id").alias("_id"), F.col("old_shard").alias("_old"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_to")).distinct()

    def moved(rows: DataFrame) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("shard") == F.col("_old")) & (_crc(text) == F.col("_crc"))
        return rows.join(to, same).drop("shard", "_id", "_old", "_crc").withColumnRenamed("_to", "shard")

    return _rewrite(spark, path, affected, moved)


def _rewrite(spark, path: str, affected: set[int], moved, schema=None) -> list[int]:
    if affected:
        rows = moved(read_shards(spark, path, schema, affected))
        _write(spark, rows, path, {s: p for s, p in _manifest(spark, path).items() if s not in affected})
    return sorted(affected)


def _write(spark, rows: DataFrame, path: str, kept: dict[int, str]) -> None:
    generation = f"{path}/generation-{uuid.uuid4().hex}"
    # as many tasks write as a shuffle of this size has; copies of one text go to the writers of their shard by their ids
    writers = min(WRITERS, max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS))
    part = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "shard"]), F.lit(writers))
    rows.repartition("shard", part).write.option("compression", "zstd").partitionBy("shard").parquet(generation)
    shards = [r[0] for r in spark.read.schema(rows.schema).parquet(generation).select("shard").distinct().collect()]
    now = kept | {s: f"{generation}/shard={s}" for s in shards}
    spark.createDataFrame(sorted(now.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def _manifest(spark, path: str) -> dict[int, str]:
    return {r["shard"]: r["path"] for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()}


def op10_flow_resharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = reshard_files(docs, f"{shared_dir(spark)}/mailstrata/shards-{uuid.uuid4().hex}")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
