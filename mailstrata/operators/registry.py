"""Stored models: tables with a manifest of digests that is checked before anything of a model is used."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Form of a stored model; another one is refused.
FORMAT = 1


class ModelRejected(Exception):
    """A stored model whose manifest is missing or unreadable, or doesn't fit its files, format or features."""


def _files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name below path, SHA-256) of every file of a model."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/model")
    rows = files.select("path", F.sha2("content", 256).alias("sha256")).collect()  # a model has a few files
    return sorted((r["path"].rpartition("/model/")[2], r["sha256"]) for r in rows)


def save(model: DataFrame | Callable[[str], None], spark: SparkSession, path: str, name: str, features: list[str], **more) -> dict:
    """Write a table, or what model(folder) writes, under path; the manifest comes last, so a run that breaks off leaves no model in force."""
    if callable(model) and not isinstance(model, DataFrame):
        model(f"{path}/model")
    else:
        model.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    manifest = {"name": name, "format": FORMAT, "features": list(features), "files": _files(spark, path)} | more
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def manifest(spark: SparkSession, path: str, name: str, features: list[str]) -> dict:
    """The manifest of the model under path, once its format, name, features and every file's digest have been found right."""
    try:
        text = "".join(r[0] for r in spark.read.text(f"{path}/manifest").collect())
        found = json.loads(text)
        files = [tuple(x) for x in found["files"]]
    except Exception as e:  # whatever a reader of some store raises
        raise ModelRejected(f"no readable manifest: {type(e).__name__}") from e
    for what, have, want in (("format", found.get("format"), FORMAT), ("name", found.get("name"), name), ("features", found.get("features"), list(features))):
        if have != want:
            raise ModelRejected(f"{what} is {have}, not {want}")
    try:
        here = _files(spark, path)
    except Exception as e:
        raise ModelRejected(f"files can't be read: {type(e).__name__}") from e
    if files != here:
        raise ModelRejected("a file was changed, added or lost")
    return found


def status(spark: SparkSession, path: str | None, name: str, features: list[str], enabled: bool = True) -> tuple[str, str | None]:
    """DISABLED, MODEL_UNAVAILABLE, MODEL_REJECTED or COMPLETED, and the reason; never an error, so an analysis goes on without its model."""
    if not enabled:
        return "DISABLED", None
    if path is None:
        return "MODEL_UNAVAILABLE", "no model is configured"
    try:
        manifest(spark, path, name, features)
    except ModelRejected as e:
        return ("MODEL_UNAVAILABLE" if "no readable manifest" in str(e) else "MODEL_REJECTED"), str(e)
    return "COMPLETED", None
