"""An investigation that grows by captures: entities, correlations and drift are kept as tables, and a capture changes only the keys that it touches.

Under the investigation's folder every run writes a generation of its own and then the manifest, which names the tables in force; it turns last, so a run
that breaks off leaves the former state. A capture that is in already changes nothing. Counts of sessions and captures add up, since a session
lies in one capture; what doesn't add up (distinct configurations, the members that an id hashes, the neighbours of a snapshot) is kept as rows, and
only the rows of touched keys are read together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import intel, inventory

#: What an investigation keeps; all but the last three are made anew from these for touched keys only.
TABLES = ("captures", "members", "snapshots", "configurations", "entities", "correlations", "drift")
MANIFEST = "name string, path string"
KINDS = list(intel.DRIFTS)


def _read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables in force; none where there is no manifest yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # the newest manifest that was written whole
    done = sorted(s.getPath().getParent().getName() for d in (files.listStatus(folder) if files.exists(folder) else []) for s in files.listStatus(d.getPath()) if s.getPath().getName() == "_SUCCESS")
    if not done:
        return {}
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{done[-1]}").collect()
    return {r["name"]: spark.read.parquet(r["path"]) for r in rows}


def _generation(root: str, tables: dict[str, DataFrame]) -> int:
    return int(tables["captures"].agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]) + 1 if tables else 1


def entity_rows(new: DataFrame) -> DataFrame:
    """entity, sessions, captures, first_at, last_at over facts (see add_captures)."""
    return new.groupBy("entity").agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("capture_id").alias("captures"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def snapshot_rows(new: DataFrame) -> DataFrame:
    """The first session of each entity in each capture, by time and id, with what drift compares."""
    shown = ["session_id", "at", *KINDS, "offer"]
    first = F.min(F.struct("at", "session_id", *[c for c in shown if c not in ("at", "session_id")])).alias("x")
    return new.groupBy("entity", "capture_id").agg(first).select("entity", "capture_id", *[F.col(f"x.{c}").alias(c) for c in shown])


def drift_rows(snapshots: DataFrame) -> DataFrame:
    """What changed from each snapshot of an entity to its next one, in the order of times and captures."""
    dated = snapshots.withColumn("period", F.struct("at", "capture_id"))
    return intel.drift(dated, "entity", "period", ["at", "session_id"], intel.DRIFTS, "offer", "session_id", ("capture_id", "session_id", "at"))


def add_captures(spark: SparkSession, root: str, facts: DataFrame, found: DataFrame | None = None) -> dict[str, DataFrame]:
    """Take the captures of facts into the investigation under root; gives the tables then in force.

    facts: capture_id, session_id, entity, at, the columns of intel.DRIFTS, offer, and config_fingerprint; leaf_sha256 and spki_sha256, or chain_sha256 (array) for whole chains,
    make members of correlations, as findings (capture_id, session_id, rule_id) of rules with a pattern do. Sessions without an entity are members, no more.
    """
    old = _read(spark, root)
    number = _generation(root, old)
    folder = f"{root}/generation-{number}-{uuid.uuid4().hex[:8]}"

    def kept(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    if old:
        facts = facts.join(old["captures"].select("capture_id"), "capture_id", "left_anti")
    new = kept("new", facts)
    if new.isEmpty() and old:
        return old
    servers = new.where(F.col("entity").isNotNull())
    material = {"SHARED_CERTIFICATE": "chain_sha256" if "chain_sha256" in new.columns else "leaf_sha256", "SHARED_PUBLIC_KEY": "spki_sha256"}
    members = inventory.shared_material(new, material, "capture_id", "session_id")
    if found is not None:
        fresh = found.join(new.select("capture_id").distinct(), "capture_id", "left_semi")
        members = members.unionByName(inventory.pattern_members(fresh))
    added = {
        "captures": new.select("capture_id").distinct().withColumn("generation", F.lit(number)),
        "members": members.distinct(),
        "snapshots": snapshot_rows(servers),
        "configurations": servers.where(F.col("config_fingerprint").isNotNull()).select("entity", "config_fingerprint").distinct(),
    }
    added = {name: kept(f"added-{name}", rows) for name, rows in added.items()}
    state = {}
    for name, rows in added.items():
        whole = rows if not old else old[name].unionByName(rows)
        state[name] = kept(name, whole.distinct() if name == "configurations" else whole)

    # sums and ends add up; configurations are counted for touched entities
    touched = servers.select("entity").distinct()
    part = entity_rows(servers)
    if old:
        part = part.unionByName(old["entities"].join(touched, "entity", "left_semi").select(part.columns))
    part = part.groupBy("entity").agg(F.sum("sessions").alias("sessions"), F.sum("captures").alias("captures"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    configs = state["configurations"].join(touched, "entity", "left_semi").groupBy("entity").agg(F.count(F.lit(1)).alias("configurations"))
    fresh = part.join(configs, "entity", "left").select(*part.columns, F.coalesce("configurations", F.lit(0)).alias("configurations"))
    state["entities"] = kept("entities", _replaced(old, "entities", fresh, touched, ["entity"]))

    groups = added["members"].select("kind", "basis").distinct()
    fresh = inventory.correlated(state["members"].join(groups, ["kind", "basis"], "left_semi"))
    state["correlations"] = kept("correlations", _replaced(old, "correlations", fresh, groups, ["kind", "basis"]))

    fresh = drift_rows(state["snapshots"].join(touched, "entity", "left_semi"))
    state["drift"] = kept("drift", _replaced(old, "drift", fresh, touched, ["entity"]))

    names = [(name, f"{folder}/{name}") for name in TABLES]
    spark.createDataFrame(names, MANIFEST).coalesce(1).write.parquet(f"{root}/manifest/{number:012d}")
    return state


def _replaced(old: dict[str, DataFrame], name: str, fresh: DataFrame, touched: DataFrame, key: list[str]) -> DataFrame:
    """The rows of untouched keys as they were, and fresh ones."""
    return fresh if not old else old[name].join(touched, key, "left_anti").select(fresh.columns).unionByName(fresh)


def timeline_events(state: dict[str, DataFrame]) -> DataFrame:
    """Events of the changes that were observed between captures, for the timeline."""
    return inventory.drift_events(state["drift"])
