"""Repeatable train and test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_TENTHS = 6


def with_split(examples: DataFrame, train_tenths: int = TRAIN_TENTHS) -> DataFrame:
    """Add ``is_train``, decided by a hash of the row's identity.

    Unlike a sampled split it does not depend on partitioning or row order, so a retried
    task cannot move a row to the other side.
    """
    if "event_id" in examples.columns:
        identity = F.col("event_id").cast("string")
    else:
        identity = F.concat_ws("\t", "user", "ts_ms", "songId")
    digest = F.conv(F.substring(F.md5(identity), 1, 8), 16, 10).cast("long")
    return examples.withColumn("is_train", digest % 10 < train_tenths)


def random_split(examples: DataFrame, train_share: float = 0.6, seed: int = 11) -> list[DataFrame]:
    """Spark's sampled split, for callers who want it."""
    return examples.randomSplit([train_share, 1 - train_share], seed=seed)
