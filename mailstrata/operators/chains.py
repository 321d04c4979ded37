"""Certificates of captures and the paths from them to configured anchors.

Names give the candidate parents of a certificate, all of them; a signature is checked once for each distinct pair, however many sessions show it.
Paths are searched within what one server presented, step by step for all distinct presented lists together. A path's validity
is the intersection of its certificates', so a list is searched once and each session only asks whether its time lies in one of the windows.
"""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import x509
from ..sources.signatures import signed_by

#: Certificates of a path, the leaf and the anchor included; a longer one is reported as such.
DEPTH = 8
PARSED = "sha256 string, der binary, subject string, issuer string, not_before_us long, not_after_us long, signature_hash string, key_algorithm string, key_bits int, is_ca boolean, path_len int, may_sign boolean, names array<string>, spki_sha256 string"


def observed(sessions: DataFrame) -> DataFrame:
    """capture_id, session_id, position (0: the leaf), sha256, der, capture_us, packets: a row for every certificate that a session shows."""
    each = F.posexplode("chain_der").alias("position", "der")
    rows = sessions.select("capture_id", "session_id", each, F.expr("first_ns div 1000").alias("capture_us"), F.col("certificate_packets").alias("packets"))
    return rows.select("capture_id", "session_id", "position", F.sha2("der", 256).alias("sha256"), "der", "capture_us", "packets")


def parsed(certificates: DataFrame) -> DataFrame:
    """The distinct certificates of certificates (sha256, der) with what they say; one that can't be read has nulls and is no parent."""

    def walk(batches):
        for b in batches:
            rows = []
            for sha256, der in zip(b["sha256"], b["der"], strict=True):
                try:
                    x = x509.parse(bytes(der))
                except ValueError:
                    x = {}
                rows.append({**{k.split()[0]: x.get(k.split()[0]) for k in PARSED.split(", ")}, "sha256": sha256, "der": der})
            yield pd.DataFrame(rows, columns=[k.split()[0] for k in PARSED.split(", ")], dtype=object)

    return certificates.select("sha256", "der").dropDuplicates(["sha256"]).mapInPandas(walk, PARSED)


def trust_store(spark: SparkSession, path: str | None) -> tuple[DataFrame, dict]:
    """Anchors (see PARSED) of a PEM file that Spark can read, and configured, anchor_count, anchor_set_digest and error.

    Never the system's store. A missing or broken file is no store at all, with the reason; it isn't an empty store that nothing verifies against.
    """
    none = spark.createDataFrame([], PARSED)
    info = {"configured": False, "anchor_count": 0, "anchor_set_digest": None, "error": None}
    if path is None:
        return none, info
    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        ders = [base64.b64decode(re.sub(r"\s", "", m), validate=True) for m in re.findall(r"-----BEGIN CERTIFICATE-----(.+?)-----END CERTIFICATE-----", text, re.S)]
        found = {x["sha256"]: (x, d) for d in ders for x in [x509.parse(d)]}
    except Exception as e:  # whatever a reader of some store raises: the reason is reported
        return none, info | {"error": f"the trust store could not be read: {type(e).__name__}"}
    if not found:
        return none, info | {"error": "the trust store holds no certificate"}
    names = [k.split()[0] for k in PARSED.split(", ")]
    rows = [tuple((x | {"der": d}).get(n) for n in names) for x, d in found.values()]
    return spark.createDataFrame(rows, PARSED), {"configured": True, "anchor_count": len(found), "anchor_set_digest": x509.anchor_digest(found), "error": None}


def links(certificates: DataFrame, anchors: DataFrame) -> DataFrame:
    """child, parent, goal, ok, since, until, path_len: every pair of distinct certificates whose names fit, and whether the parent may and did sign the child.

    A pair is ok if the parent is a CA that may sign, the child's signature isn't by MD5 or SHA-1, and it verifies; an algorithm that isn't built is not ok.
    """
    parents = anchors.withColumn("goal", F.lit(True)).unionByName(certificates.join(anchors.select("sha256"), "sha256", "left_anti").withColumn("goal", F.lit(False)))
    may = F.col("is_ca") & F.col("may_sign")
    parents = parents.where(F.col("subject").isNotNull()).select(F.col("sha256").alias("parent"), F.col("subject").alias("_subject"), F.col("der").alias("_der"), "goal", may.alias("_may"), F.col("not_before_us").alias("since"), F.col("not_after_us").alias("until"), "path_len")
    sound = ~F.coalesce(F.lower("signature_hash").isin("md5", "sha1"), F.lit(False))
    pairs = certificates.select(F.col("sha256").alias("child"), "issuer", "der", sound.alias("_sound")).join(parents, (F.col("issuer") == F.col("_subject")) & (F.col("child") != F.col("parent")))

    def verified(batches):
        for b in batches:
            good = [m and s and signed_by(bytes(c), bytes(p)) is True for c, p, m, s in zip(b["der"], b["_der"], b["_may"], b["_sound"], strict=True)]
            yield b[["child", "parent", "goal", "since", "until", "path_len"]].assign(ok=good)

    return pairs.select("child", "parent", "goal", "since", "until", "path_len", "der", "_der", "_may", "_sound").mapInPandas(verified, "child string, parent string, goal boolean, since long, until long, path_len int, ok boolean")


def paths(starts: DataFrame, members: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """chain, state, since, until, length: every way from the start of a chain along edges to a goal, or to where it ends.

    starts: chain, node, since, until. members: chain, node, what a way may pass besides goals. edges: child, parent, goal, ok, since, until and path_len (how many
    certificates that aren't leaves may lie below the parent). state: DONE; BROKEN at an edge that isn't ok, that would exceed a path_len or whose times don't meet; MISSING where no parent is known; LONG after depth nodes.
    """
    local = members.join(edges, F.col("node") == F.col("child")).select("chain", "child", "parent", "goal", "ok", "since", "until", "path_len")
    inside = members.select(F.col("chain").alias("_c"), F.col("node").alias("_n"))
    known = local.join(inside, (F.col("chain") == F.col("_c")) & (F.col("parent") == F.col("_n")), "left").where(F.col("goal") | F.col("_n").isNotNull()).drop("_c", "_n").distinct()
    known = known.withColumnsRenamed({c: f"_{c}" for c in known.columns})
    walk = starts.select("chain", "node", F.lit("OPEN").alias("state"), "since", "until", F.lit(1).alias("length"), F.array("node").alias("seen"))
    for _ in range(depth - 1):
        step = walk.join(known, (F.col("state") == "OPEN") & (F.col("chain") == F.col("_chain")) & (F.col("node") == F.col("_child")) & ~F.expr("array_contains(seen, _parent)"), "left")
        moved = F.col("_parent").isNotNull()
        since, until = F.greatest("since", "_since"), F.least("until", "_until")
        broken = ~F.col("_ok") | (since > until) | F.coalesce(F.col("_path_len") < F.col("length") - 1, F.lit(False))
        state = F.when(F.col("state") != "OPEN", F.col("state")).when(~moved, "MISSING").when(broken, "BROKEN").when(F.col("_goal"), "DONE").otherwise("OPEN")
        walk = step.select(
            "chain", F.coalesce("_parent", "node").alias("node"), state.alias("state"), F.when(moved, since).otherwise(F.col("since")).alias("since"), F.when(moved, until).otherwise(F.col("until")).alias("until"),
            F.when(moved, F.col("length") + 1).otherwise(F.col("length")).alias("length"), F.when(moved, F.expr("array_append(seen, _parent)")).otherwise(F.col("seen")).alias("seen"),
        )
    return walk.select("chain", F.when(F.col("state") == "OPEN", "LONG").otherwise(F.col("state")).alias("state"), "since", "until", "length").distinct()


def verdicts(found: DataFrame) -> DataFrame:
    """chain, windows (since, until, length of complete paths, in order), reason for a time outside all of them: EXPIRED, INVALID, TOO_LONG or INCOMPLETE."""
    has = lambda s: F.bool_or(F.col("state") == s)
    windows = F.array_sort(F.collect_set(F.when(F.col("state") == "DONE", F.struct("since", "until", "length"))))
    reason = F.when(has("DONE"), "EXPIRED").when(has("BROKEN"), "INVALID").when(has("LONG"), "TOO_LONG").otherwise("INCOMPLETE")
    return found.groupBy("chain").agg(windows.alias("windows"), reason.alias("reason"))


def status_at(windows: str, time: str) -> Column:
    return F.exists(windows, lambda w: (F.col(time) >= w["since"]) & (F.col(time) <= w["until"]))


def with_chain_status(sessions: DataFrame, anchors: DataFrame, configured: bool) -> DataFrame:
    """sessions with chain_status and chain_reason: PASSED, FAILED (with the reason), or NOT_AVAILABLE without a store, a certificate, a time or a DNS name in the leaf."""
    if not configured:
        return sessions.withColumns({"chain_status": F.lit("NOT_AVAILABLE"), "chain_reason": F.lit("NO_TRUST_STORE")})
    digests = F.transform("chain_der", lambda d: F.sha2(d, 256))
    shown = sessions.withColumn("_chain", F.when(F.size("chain_der") > 0, F.sha2(F.array_join(digests, ",").cast("binary"), 256)))
    lists = shown.where(F.col("_chain").isNotNull()).select(F.col("_chain").alias("chain"), digests.alias("nodes"), "chain_der").dropDuplicates(["chain"])
    flat = lists.select("chain", F.posexplode(F.arrays_zip("nodes", "chain_der")).alias("position", "x")).select("chain", "position", F.col("x.nodes").alias("node"), F.col("x.chain_der").alias("der"))
    known = parsed(flat.select(F.col("node").alias("sha256"), "der"))
    leaves = flat.where("position = 0").join(known.select(F.col("sha256").alias("node"), F.col("not_before_us").alias("since"), F.col("not_after_us").alias("until"), "names"), "node")
    found = verdicts(paths(leaves.select("chain", "node", "since", "until"), flat.select("chain", "node").distinct(), links(known, anchors)))
    named = leaves.select("chain", (F.size("names") > 0).alias("named")).join(found, "chain").withColumnRenamed("chain", "_of")
    x = shown.withColumn("_at", F.expr("first_ns div 1000")).join(named, F.col("_chain") == F.col("_of"), "left")
    status = F.when(F.col("_of").isNull() | F.col("_at").isNull() | ~F.coalesce("named", F.lit(False)), "NOT_AVAILABLE").when(status_at("windows", "_at"), "PASSED").otherwise("FAILED")
    x = x.withColumn("chain_status", status)
    return x.withColumn("chain_reason", F.when(F.col("chain_status") == "FAILED", F.col("reason"))).drop("_chain", "_of", "_at", "named", "windows", "reason")


def inventory(sessions: DataFrame) -> DataFrame:
    """A row for every certificate that a session shows: where it stood, what it says, the packets that brought it, and whether it had expired at the capture's time."""
    seen = observed(sessions)
    facts = parsed(seen).drop("der")
    dated = F.when(F.col("capture_us") > F.col("not_after_us"), "EXPIRED").when(F.col("capture_us") < F.col("not_before_us"), "NOT_YET_VALID").when(F.col("not_after_us").isNotNull(), "VALID")
    return seen.drop("der").join(facts, "sha256").withColumn("at_capture", dated)
