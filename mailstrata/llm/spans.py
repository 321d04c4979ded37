"""Spans of regular expressions by DataFrame functions alone: one pass for the matches, one for what lies between.

Matches and pieces are columns of a projection of their own, read as attributes afterwards, and
everything that runs along a list does so in blocks of BLOCK items, so the cost of a text grows with
its length and its hits, not with their product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a list that one inner fold walks, code points of a segment that cuts are taken from.
BLOCK, SEGMENT = 256, 2048
SPAN = "struct<start:int,end:int,hit:string,before:string,after:string>"


def fold(items, state, state_type: str, out_type: str, step):
    """The items that step(state, item) -> (new state, array of outputs) yields along items (a column that is an attribute).

    Two nested aggregates: appending copies at most a block, or one entry for each block.
    """
    n_blocks = F.ceil(F.size(items) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.slice(items, i * BLOCK + 1, BLOCK))
    none, nothing = F.array().cast(f"array<{out_type}>"), F.array().cast(f"array<array<{out_type}>>")

    def inside(acc, x):
        new, out = step(acc["state"], x)
        return F.struct(new.cast(state_type).alias("state"), F.concat(acc["out"], out).alias("out"))

    def over(acc, block):
        begun = F.struct(acc["state"].alias("state"), none.alias("out"))
        return F.aggregate(block, begun, inside, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

    zero = F.struct(state.cast(state_type).alias("state"), nothing.alias("out"))
    walked = F.aggregate(blocks, zero, over, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(items) > 0, walked).otherwise(none)


def with_matches(df: DataFrame, text, patterns: dict[str, str], around: int) -> DataFrame:
    """df with a column for each name of patterns: all leftmost non-overlapping matches with code point offsets.

    Each has up to around characters of context on both sides, which ends at the neighbouring match. No match
    or a null text: an empty array. A column of df with one of the names is replaced.
    """
    kept = [c for c in df.columns if c not in patterns]
    hits, between, items, starts = ({k: f"_{part}_{k}" for k in patterns} for part in ("hits", "between", "items", "starts"))
    out = df.select(*kept, text.alias("_whole"), *[F.coalesce(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.array()).alias(hits[k]) for k, p in patterns.items()])
    # each list is read twice below, so Spark keeps these projections apart and computes none of them again
    cut = lambda k, p: F.when(F.size(hits[k]) > 0, F.split("_whole", p, -1)).otherwise(F.array().cast("array<string>"))
    out = out.select(*kept, *hits.values(), *[cut(k, p).alias(between[k]) for k, p in patterns.items()])

    def zipped(k: str):
        parts, found = F.col(between[k]), F.col(hits[k])
        rows = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("before"), found.alias("hit"), F.slice(parts, 2, F.size(found)).alias("after"))
        return F.when(F.size(found) > 0, rows).otherwise(F.array().cast("array<struct<before:string,hit:string,after:string>>"))

    out = out.select(*kept, *[zipped(k).alias(items[k]) for k in patterns])

    def walk(k: str):
        def step(at, x):
            start = at + F.length(x["before"])
            return start + F.length(x["hit"]), F.array(start)

        return fold(F.col(items[k]), F.lit(0), "int", "int", step)

    out = out.select(*kept, *items.values(), *[walk(k).alias(starts[k]) for k in patterns])

    def spans(k: str):
        def one(x, start):
            return F.struct(
                start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"),
                F.right(x["before"], F.lit(around)).alias("before"), F.left(x["after"], F.lit(around)).alias("after"),
            )

        return F.zip_with(F.col(items[k]), F.col(starts[k]), one)

    return out.select(*kept, *[spans(k).cast(f"array<{SPAN}>").alias(k) for k in patterns])


def segments(text):
    """text in pieces of SEGMENT code points, for between(); make it a column of its own first."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))


def between(parts, start, end):
    """Code points from start to end of the text whose segments parts are: only the segments that hold them are touched."""
    first = F.floor(start / SEGMENT).cast("int")
    some = F.slice(parts, first + 1, F.floor(end / SEGMENT).cast("int") - first + 1)
    return F.when(end > start, F.substr(F.array_join(some, ""), start - first * SEGMENT + 1, end - start)).otherwise(F.lit(""))


def joined(spans):
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans):
    return F.sha2(joined(spans).cast("binary"), 256)
