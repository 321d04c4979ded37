"""Which packets a byte range rests on, by range joins that are linear in the ranges and in what they meet; where packets disagree, by one walk over each stream in order.

Segments: the key of a stream, packet, start, end (half-open) and, where bytes are compared, payload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlaps


def _as_ranges(rows: DataFrame, key: list[str], id_: str) -> DataFrame:
    """An empty range stands for its first byte."""
    return rows.select(*key, F.col(id_).alias("_id"), "start", F.greatest(F.col("end"), F.col("start") + 1).alias("end"))


def carriers(ranges: DataFrame, segments: DataFrame, key: list[str], id_: str) -> DataFrame:
    """ranges (key, id_, start, end) with packets: sorted distinct numbers of the packets whose segments meet the range; empty where none does."""
    met = overlaps(_as_ranges(ranges, key, id_), segments.select(*key, F.col("packet").alias("_id"), "start", "end"), key, "_id", "start", "end")
    found = met.groupBy(*[F.col(k).alias(f"_{k}") for k in key], F.col("left_id").alias("_of")).agg(F.sort_array(F.collect_set("right_id")).alias("packets"))
    joined = ranges.join(found, (F.col(id_) == F.col("_of")) & _all([F.col(k) == F.col(f"_{k}") for k in key]), "left")
    none = F.array().cast(found.schema["packets"].dataType)
    return joined.select(*ranges.columns, F.coalesce("packets", none).alias("packets"))


def _all(tests: list):
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


class _Walk:
    """A stream's segments (packet, start, end, payload) in order of their starts. Held are those that reach beyond the place walked to, the least packet first, and what the later ones of them share with owners."""

    def __init__(self):
        self.open, self.at, self.shared = [], 0, {}

    def add(self, segment: tuple) -> list:
        found = self.upto(segment[1])
        self.at = segment[1]
        self.open.append(segment)
        if len(self.open) > 1:
            self.open.sort(key=lambda s: s[0])
        return found

    def upto(self, place) -> list:
        """Walks to a place; [start, end, owner, later segment] for each stretch that a segment which ends before it shares with one owner."""
        found = []
        while self.open and self.at < place:
            first = min(s[2] for s in self.open)
            to = min(first, place)
            owner = self.open[0]
            for later in self.open[1:]:
                if later[0] > owner[0]:
                    runs = self.shared.setdefault(id(later), [])
                    if runs and runs[-1][2] is owner and runs[-1][1] == self.at:
                        runs[-1][1] = to
                    else:
                        runs.append([self.at, to, owner, later])
            self.at = to
            if to == first:
                for s in self.open:
                    if s[2] == to:
                        found += self.shared.pop(id(s), ())
                self.open = [s for s in self.open if s[2] > to]
        return found


def _part(segment: tuple, start: int, end: int):
    return None if segment[3] is None else segment[3][start - segment[1] : end - segment[1]]


def _digest(part) -> str:
    return hashlib.sha256(part.encode() if isinstance(part, str) else part).hexdigest()


def disagreements(segments: DataFrame, key: list[str], digests: bool = True) -> DataFrame:
    """key, start, end, accepted_packet, conflicting_packet and, with digests, accepted_sha256, conflicting_sha256: where a packet brought other bytes than the one that was observed first.

    Every byte belongs to its least packet. What a later packet shares with one owner without a break is compared as a whole; where
    they differ the first observation stays and both digests are kept, never the bytes.
    Streams are sorted once, segments that meet no other go, and a task walks over its streams in order, holding the segments that are open at one place.
    Empty segments and those without a key or a packet take no part.
    """
    given = ["packet", "start", "end", "payload"]
    rows = segments.select(*key, *given).dropna(subset=[*key, "packet"]).where(F.col("start") < F.col("end"))
    w = Window.partitionBy(*key).orderBy("start")
    before, after = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lead("start").over(w)
    met = rows.withColumns({"_before": before, "_after": after}).where("start < _before OR _after < end").select(*key, *given).sortWithinPartitions(*key, "start")
    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    shown = {**{k: kinds[k] for k in key}, "start": kinds["start"], "end": kinds["end"], "accepted_packet": kinds["packet"], "conflicting_packet": kinds["packet"]}
    if digests:
        shown |= {"accepted_sha256": "string", "conflicting_sha256": "string"}

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, walk, out = None, _Walk(), []

        def tell(found: list) -> None:
            for start, end, owner, later in found:
                a, c = _part(owner, start, end), _part(later, start, end)
                if a is not None and c is not None and a != c:
                    out.append((*stream, start, end, owner[0], later[0], *((_digest(a), _digest(c)) if digests else ())))

        for b in batches:
            for k, *segment in zip(zip(*(b[c].tolist() for c in key), strict=True), *(b[c].tolist() for c in given), strict=True):
                if k != stream:
                    if walk.open:
                        tell(walk.upto(float("inf")))
                    stream = k
                tell(walk.add(tuple(segment)))
            if out:
                yield pd.DataFrame(out, columns=list(shown))
                out.clear()
        tell(walk.upto(float("inf")))
        if out:
            yield pd.DataFrame(out, columns=list(shown))

    return met.mapInPandas(walked, ", ".join(f"`{n}` {kind}" for n, kind in shown.items()))


def ambiguous(ranges: DataFrame, conflicts: DataFrame, key: list[str]) -> DataFrame:
    """ranges with ambiguous: whether a conflict (key, start, end) meets the range.

    Of the conflicts that begin before a range's end the one that reaches farthest meets it, if any does: one sort of both over each stream, no join.
    """
    place = lambda c: F.col(c).cast("long")
    marks = conflicts.dropna(subset=key).select(*key, place("start").alias("_at"), place("end").alias("_reach"), F.lit(None).cast(ranges.select(F.struct(*ranges.columns)).schema[0].dataType).alias("_row"))
    asked = ranges.select(*key, F.greatest(place("end"), place("start") + 1).alias("_at"), F.lit(None).cast("long").alias("_reach"), F.struct(*ranges.columns).alias("_row"))
    before = F.max("_reach").over(Window.partitionBy(*key).orderBy("_at", F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    seen = asked.unionByName(marks).withColumn("_before", before).where("_row IS NOT NULL")
    return seen.select("_row.*", F.coalesce(F.col("_before") > F.col("_row.start"), F.lit(False)).alias("ambiguous"))


def acked_missing(streams: DataFrame, key: list[str], acked: str, end: str, fin: str) -> DataFrame:
    """key, missing: bytes that the peer's highest acknowledgement, less a FIN, lies beyond the last byte captured, where that is more than none."""
    x = streams.groupBy(*key).agg(F.max(acked).alias("_acked"), F.max(end).alias("_end"), F.max(F.col(fin).cast("long")).alias("_fin"))
    return x.select(*key, (F.col("_acked") - F.col("_fin") - F.col("_end")).cast("long").alias("missing")).where("missing > 0")
