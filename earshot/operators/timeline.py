"""The play before and the play after, without one task per user.

A plain ``PARTITION BY user`` window puts a user's whole history in one task, and one user
may own a third of the log. Users with at most ``PLAYS_PER_TASK`` plays get just that window. The plays of
all others are ranged by (user, time, identity) and so split anywhere, within one millisecond too;
the window runs per (user, range). Only the first (or last) play of a range has its neighbour
elsewhere; those come from an *edge* table of one row per user and range, whose own per-user window is
bounded by the number of ranges.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from earshot.functions.text import user_number
from earshot.operators.users import with_profile
from earshot.session import cut_lineage

HOUR_MS = 3_600_000

# Plays of one user that a task may sort, and how many go to a range.
PLAYS_PER_TASK = 2_000_000
RANGE_PLAYS = 1_000_000

# A log that Spark estimates to be smaller has no such user and is not counted.
SMALL_BYTES = 32 << 20

# Names of busy users that are sent to every task; more of them meet the plays by a shuffle.
SENT_USERS = 100_000

Describe = Callable[[DataFrame], DataFrame]


def play_order(plays: DataFrame) -> list[str]:
    """Columns that put one user's plays in a repeatable order, also within one millisecond."""
    return [c for c in ("ts_ms", "artistId", "songId", "event_id") if c in plays.columns]


def by_busy_users(plays: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Plays of users whom one task can sort; and those of all others with ``_range``, if there are any.

    Plays that are equal in all that orders them are split by ``_nth``, whatever it says.
    """
    if int(plays._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL_BYTES:
        return plays, None
    busy = cut_lineage(plays.groupBy("user").count().where(F.col("count") > PLAYS_PER_TASK), "busy-users")
    n_users, n_plays = busy.agg(F.count("*"), F.sum("count")).first()
    if not n_users:
        return plays, None
    named = busy.select(F.col("user").alias("_busy"))
    named = F.broadcast(named) if n_users <= SENT_USERS else named
    is_busy = F.col("user") == F.col("_busy")
    numbered = plays.join(named, is_busy, "left_semi").withColumn("_nth", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(ceil(n_plays / RANGE_PLAYS), "user", *play_order(plays), "_nth")
    return plays.join(named, is_busy, "left_anti"), cut_lineage(ranged.withColumn("_range", F.spark_partition_id()), "busy-plays")


def in_user(plays: DataFrame) -> WindowSpec:
    return Window.partitionBy("user").orderBy(*play_order(plays))


def in_range(plays: DataFrame) -> WindowSpec:
    return Window.partitionBy("user", "_range").orderBy(*play_order(plays), "_nth")


def over_ranges() -> WindowSpec:
    return Window.partitionBy("user").orderBy("_range")


def with_neighbour(
    plays: DataFrame, column: str, name: str, back: bool, describe: Describe | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Both parts of the plays with ``column`` of the same user's previous (or next) play as ``name``.

    ``describe`` adds columns to tables with a ``user``; they come along by a join that reuses the
    partitioning of the window. The part of busy users keeps ``_range`` and ``_nth``.
    """
    step = F.lag if back else F.lead
    calm, busy = by_busy_users(plays)
    found = calm.withColumn(name, step(column).over(in_user(plays)))
    if describe is not None:
        found = found.join(describe(calm.select("user").distinct()), "user")
    if busy is None:
        return found, None
    ends = F.struct(*play_order(plays), "_nth")
    edge = F.max_by(column, ends) if back else F.min_by(column, ends)
    edges = busy.groupBy("user", "_range").agg(edge.alias("_edge")).withColumn("_edge", step("_edge").over(over_ranges()))
    split = (
        busy.withColumn("_here", step(column).over(in_range(plays)))
        .join(edges if describe is None else describe(edges), ["user", "_range"])
        .withColumn(name, F.coalesce("_here", "_edge"))
        .drop("_here", "_edge")
    )
    return found, split


def _together(parts: tuple[DataFrame, DataFrame | None]) -> DataFrame:
    calm, busy = parts
    return calm if busy is None else calm.unionByName(busy.drop("_range", "_nth"))


def with_previous_ts(plays: DataFrame, name: str = "pts") -> DataFrame:
    """Add the ``ts_ms`` of the same user's previous play; NULL for the first one."""
    return _together(with_neighbour(plays, "ts_ms", name, back=True))


def with_next_ts(plays: DataFrame, name: str = "nts") -> DataFrame:
    """Add the ``ts_ms`` of the same user's next play; NULL for the last one."""
    return _together(with_neighbour(plays, "ts_ms", name, back=False))


def with_next_song(plays: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Add ``next_songId``, the song of the same user's next play; NULL for the last one.

    With ``profiles``, the profile columns come along. They are joined to a table of users (and of
    ranges of busy ones) that meets the plays by the window's partitioning, so the plays are not
    shuffled again.
    """

    def described(users: DataFrame) -> DataFrame:
        return with_profile(users.withColumn("user_id", user_number(F.col("user"))), profiles).drop("user_id")

    describe = None if profiles is None else described
    return _together(with_neighbour(plays, "songId", "next_songId", back=False, describe=describe))


def play_gaps(plays: DataFrame) -> DataFrame:
    """Plays with ``pts`` and ``pdiff``, the milliseconds since the previous play."""
    return with_previous_ts(plays).withColumn("pdiff", F.col("ts_ms") - F.col("pts"))


def next_song_pairs(plays: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Plays that have a successor, with ``next_songId`` and, if given, profile columns."""
    return with_next_song(plays, profiles).filter(F.col("next_songId").isNotNull())
