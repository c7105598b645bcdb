"""Train a model once, keep it on shared storage, load it afterwards.

Every save goes into a fresh folder. A line is then added beside them that names the folder, the
parameters, and the log the model was trained on; it appears as a whole or not at all, and
only then is there a new version. Until that moment, and if the save is cut short, the version before
stays in use. Versions are never overwritten; remove old folders when no reader is left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Model = TypeVar("Model")

VERSIONS = "versions"


def kept_versions(spark: SparkSession, path: str) -> list[dict]:
    """The versions saved at ``path``, oldest first: ``version``, ``folder``, ``parameters`` and ``log``."""
    try:
        lines = [row["value"] for row in spark.read.text(f"{path}/{VERSIONS}").collect()]  # one per save
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(map(json.loads, lines), key=lambda kept: (kept["version"], kept["folder"]))


def kept_parameters(spark: SparkSession, path: str) -> dict | None:
    """The parameters of the newest version at ``path``; None if there is none."""
    versions = kept_versions(spark, path)
    return versions[-1]["parameters"] if versions else None


def log_fingerprint(plays: DataFrame) -> dict:
    """What tells logs apart: the number of plays, the last instant, and a sum of hashes of all plays."""
    play = F.xxhash64("user", "ts_ms", "artistId", "songId").cast("decimal(38,0)")
    row = plays.agg(F.count("*"), F.max("ts_ms"), F.sum(play).cast("string")).first()
    return {"plays": row[0], "last_ts_ms": row[1], "sum": row[2]}


def load_or_train(
    spark: SparkSession,
    path: str | None,
    parameters: dict,
    train: Callable[[], Model],
    save: Callable[[Model, str], None],
    load: Callable[[SparkSession, str], Model],
    retrain: bool = False,
    log: DataFrame | None = None,
) -> Model:
    """Load the newest version at ``path`` with these parameters, or train and save one; without a path, just train.

    The path is the caller's, so they decide when new data means a new model; ``log`` (plays) is
    remembered by its fingerprint, for :func:`changed_models`.
    """
    if path is None:
        return train()
    wanted = json.loads(json.dumps(parameters))
    versions = kept_versions(spark, path)
    fitting = [kept for kept in versions if kept["parameters"] == wanted]
    if fitting and not retrain:
        return load(spark, f"{path}/{fitting[-1]['folder']}")
    model = train()
    number = versions[-1]["version"] + 1 if versions else 1
    folder = f"version-{number}-{uuid.uuid4().hex}"
    save(model, f"{path}/{folder}")
    line = {"version": number, "folder": folder, "parameters": wanted, "log": None if log is None else log_fingerprint(log)}
    named = spark.createDataFrame([(json.dumps(line, sort_keys=True),)], "value string")
    named.coalesce(1).write.mode("append").text(f"{path}/{VERSIONS}")
    return model


def changed_models(spark: SparkSession, paths: dict[str, str], plays: DataFrame) -> DataFrame:
    """The newest version at each path against the log as it is now: one row per stored model.

    ``model``, ``version``, ``trained_plays`` (null if the log was not given), ``plays`` and ``changed``.
    """
    now, rows = log_fingerprint(plays), []
    for name, path in paths.items():
        versions = kept_versions(spark, path)
        if versions:
            then = versions[-1]["log"]
            trained = None if then is None else then["plays"]
            rows.append((name, versions[-1]["version"], trained, now["plays"], then != now))
    return spark.createDataFrame(rows, "model string, version int, trained_plays bigint, plays bigint, changed boolean")
