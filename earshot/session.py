"""Session helpers: a local session for tests and benchmarks, and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A ``local[cores]`` session sized for one machine. On a cluster, pass your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("earshot")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable without ever writing to one executor's own disk.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a session that runs
    in one process (master ``local`` or ``local[...]``) may do without it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="earshot-checkpoints-")
    context.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, for tables written between jobs."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Compute ``df`` once into a table in the shared checkpoint folder and read it back.

    For small aggregates that several later jobs read: the scan of the log behind them runs
    once, a lost executor costs nothing, and the planner knows the table's size.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    name = "earshot-package.zip"
    if any(file.endswith(name) for file in context.listFiles):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="earshot-")) / name
    with zipfile.ZipFile(archive, "w") as to:
        for file in sorted(package.rglob("*.py")):
            to.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
