"""Tables on storage and views for SQL: parse text once, then work on columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_plays(plays: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write plays as Parquet in ranges of (user, time).

    Row-group statistics then let a question about one user skip nearly all of the table,
    and a user with very many plays spreads over several files instead of filling one.
    """
    keys = [F.col("user_id"), F.col("ts_ms")]
    spread = plays.repartitionByRange(partitions, *keys) if partitions else plays.repartitionByRange(*keys)
    spread.sortWithinPartitions("user_id", "ts_ms").write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_result(result: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store an answer for later requests. ``fmt`` is any Spark writer, such as json."""
    result.write.mode("overwrite").format(fmt).save(path)


def register_views(plays: DataFrame, profiles: DataFrame | None = None) -> None:
    """Make the tables known to ``spark.sql`` as ``plays`` and ``profiles``."""
    plays.createOrReplaceTempView("plays")
    if profiles is not None:
        profiles.createOrReplaceTempView("profiles")
