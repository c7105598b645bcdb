"""Per-user lookups, for one user, some, or all: the plan is the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.text import user_number
from earshot.session import cut_lineage
from earshot.sources.profiles import one_per_user

_LAST_FIELDS = ("user", "ts", "ts_ms", "artistId", "artist", "songId", "song", "song_id", "day_of_week", "hour_of_day")


# User numbers, a table with a ``user_id`` column, or None for everybody.
Users = Sequence[int] | DataFrame | None


def numbers_of(spark: SparkSession, names: Sequence[str]) -> list[int]:
    """The user numbers of names in any spelling."""
    named = spark.createDataFrame([(name,) for name in names], "user string")
    return [row[0] for row in named.select(user_number(F.col("user"))).distinct().collect()]


def of_users(df: DataFrame, users: Users) -> DataFrame:
    """Rows of ``df`` for the given users; all rows without them.

    Numbers become a literal filter, which reaches a Parquet scan and skips row groups.
    """
    if users is None:
        return df
    if isinstance(users, DataFrame):
        return df.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return df.filter(F.col("user_id").isin(list(users)))


def last_play_by_user(plays: DataFrame, users: Users = None) -> DataFrame:
    """The latest play of each user number; ties by song id. Unknown users give no row."""
    fields = [c for c in _LAST_FIELDS if c in plays.columns]
    latest = F.max_by(F.struct(*fields), F.struct("ts_ms", "songId", "artistId"))
    return (
        of_users(plays, users).groupBy("user_id").agg(latest.alias("last")).select("user_id", "last.*")
    )


def with_profile(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left join on the user number; age and the code columns are 0 without a profile.

    Profiles grow with users, so whether they are broadcast is left to Spark's own size
    estimates. They are made unique in a stored table first: then both sides of a sort-merge
    join are bare exchanges, and adaptive execution can split a user with very many rows.
    """
    known = cut_lineage(
        one_per_user(profiles).select("user_id", "gender", "age", "country", "gender_id", "country_id"), "profiles"
    )
    codes = {c: F.coalesce(c, F.lit(0)) for c in ("age", "gender_id", "country_id")}
    return rows.join(known, "user_id", "left").withColumns(codes)


def plays_with_profile(plays: DataFrame, profiles: DataFrame) -> DataFrame:
    return with_profile(plays, profiles)
