"""Who is there, who played most, what is played most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_users(plays: DataFrame) -> DataFrame:
    """Users with at least one identified play, by name."""
    return plays.select("user").distinct().orderBy("user")


def unique_users_raw(raw_log: DataFrame) -> DataFrame:
    """Users of every line of the log, identified or not, in no order."""
    return raw_log.select("user").distinct()


def top_users(plays: DataFrame, n: int) -> DataFrame:
    """The n users with the most distinct songs; ties by name.

    Spark counts distinct songs in two steps, first by (user, song), so a user with very
    many plays is spread over tasks until only one number per task is left.
    """
    return (
        plays.groupBy(F.col("user").alias("userName"))
        .agg(F.count_distinct("songId").alias("songCount"))
        .orderBy(F.desc("songCount"), "userName")
        .limit(n)
    )


def top_songs(plays: DataFrame, n: int) -> DataFrame:
    """The n most played songs; ties by id."""
    return (
        plays.groupBy("songId")
        .agg(F.count(F.lit(1)).alias("playCount"))
        .orderBy(F.desc("playCount"), "songId")
        .limit(n)
    )
