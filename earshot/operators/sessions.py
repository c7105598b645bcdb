"""Listening sessions: a session goes on while the next play starts within the gap.

Plays are first folded into slices of time no wider than the gap. Two plays in one slice
are closer than the gap, so they always share a session, and only the first and last
instant of a slice matter. That fold is an ordinary aggregation with map-side combine, so a
user with a third of all plays, or a third of all plays in one instant, shrinks before the
shuffle. What the per-user window then sees is bounded by the time span over the gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.functions.time import slice_start
from earshot.operators.timeline import HOUR_MS, in_range, in_user, over_ranges, play_order, with_neighbour
from earshot.session import cut_lineage

# Fixed value: more than 20 minutes between two starts ends a session.
SESSION_GAP_MS = 1_200_000

# Slices of wider gaps are an hour.
WIDEST_SLICE_MS = HOUR_MS

# Sessions of slices narrower than this are numbered hour by hour, then within the hour.
NARROW_SLICE_MS = 60_000


def slice_width(gap_ms: int) -> int:
    """No wider than the gap and the hour."""
    return max(1, min(gap_ms, WIDEST_SLICE_MS))


def carried(edges: DataFrame) -> DataFrame:
    """``edges`` of narrow slices with ``prev_ts`` of the user's previous non-empty slice in its place.

    It is carried within the hour, and from hour to hour by one row each, so that a window over a
    user alone sees hours, however narrow the slices are.
    """
    hourly = edges.withColumn("_hour", slice_start(F.col("slice"), HOUR_MS))
    hours = (
        hourly.groupBy("user", "_hour")
        .agg(F.max_by("prev_ts", "slice").alias("_far"))
        .withColumn("_far", F.lag("_far").over(Window.partitionBy("user").orderBy("_hour")))
    )
    in_hour = Window.partitionBy("user", "_hour").orderBy("slice")
    return (
        hourly.withColumn("prev_ts", F.lag("prev_ts").over(in_hour))
        .join(hours, ["user", "_hour"])
        .withColumn("prev_ts", F.coalesce("prev_ts", "_far"))
        .drop("_far")
    )


def session_slices(plays: DataFrame, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """One row per user and non-empty slice: first and last play, session number.

    ``prev_ts`` is the user's last play before the slice.
    """
    width = slice_width(gap_ms)
    slices = plays.groupBy("user", slice_start(F.col("ts_ms"), width).alias("slice")).agg(
        F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts")
    )
    starts = F.when(F.col("prev_ts").isNull() | (F.col("first_ts") - F.col("prev_ts") > gap_ms), 1).otherwise(0)
    if width >= NARROW_SLICE_MS:
        by_slice = Window.partitionBy("user").orderBy("slice")
        return slices.withColumn("prev_ts", F.lag("last_ts").over(by_slice)).withColumn(
            "user_session_id", F.sum(starts).over(by_slice)
        )
    linked = carried(slices.withColumn("prev_ts", F.col("last_ts"))).withColumn("_starts", starts)
    before = Window.partitionBy("user").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = (
        linked.groupBy("user", "_hour")
        .agg(F.sum("_starts").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    in_hour = F.sum("_starts").over(Window.partitionBy("user", "_hour").orderBy("slice"))
    return (
        linked.withColumn("_in_hour", in_hour)
        .join(hours, ["user", "_hour"])
        .withColumn("user_session_id", F.col("_before") + F.col("_in_hour"))
        .drop("_hour", "_starts", "_before", "_in_hour")
    )


def sessionize(plays: DataFrame, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """Plays with ``pts``, ``pdiff``, ``is_new_session`` and ``user_session_id``.

    Session numbers are running counts of starts, over a user's plays, or over a range of a busy user's
    with the count of the ranges before it.
    """
    calm, busy = with_neighbour(plays, "ts_ms", "pts", back=True)
    pdiff = F.col("ts_ms") - F.col("pts")
    starts = F.when(F.col("pts").isNull() | (pdiff > gap_ms), 1).otherwise(0)
    so_far = (Window.unboundedPreceding, Window.currentRow)

    def started(part: DataFrame) -> DataFrame:
        return part.withColumn("pdiff", pdiff).withColumn("is_new_session", starts)

    columns = [*plays.columns, "pts", "pdiff", "is_new_session", "user_session_id"]
    number = F.sum("is_new_session").over(in_user(plays).rowsBetween(*so_far))
    found = started(calm).withColumn("user_session_id", number).select(*columns)
    if busy is None:
        return found
    busy = started(busy)
    before = F.sum("_n").over(over_ranges().rowsBetween(Window.unboundedPreceding, -1))
    earlier = busy.groupBy("user", "_range").agg(F.sum("is_new_session").alias("_n")).withColumn("_n", F.coalesce(before, F.lit(0)))
    number = F.sum("is_new_session").over(in_range(plays).rowsBetween(*so_far))
    numbered = busy.withColumn("_in_range", number).join(earlier, ["user", "_range"])
    return found.unionByName(numbered.withColumn("user_session_id", F.col("_n") + F.col("_in_range")).select(*columns))


def session_lengths(plays: DataFrame, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """Length in milliseconds of every session; one play alone makes a session of length 0."""
    return _session_bounds(plays, gap_ms).select("user", "user_session_id", "session_length")


def _session_bounds(plays: DataFrame, gap_ms: int) -> DataFrame:
    return (
        session_slices(plays, gap_ms)
        .groupBy("user", "user_session_id")
        .agg(F.min("first_ts").alias("start_ts"), F.max("last_ts").alias("end_ts"))
        .withColumn("session_length", F.col("end_ts") - F.col("start_ts"))
    )


def longest_sessions(plays: DataFrame, n: int, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """The n longest sessions with their bounds; ties by user, then session number."""
    return (
        _session_bounds(plays, gap_ms)
        .orderBy(F.desc("session_length"), "user", "user_session_id")
        .limit(n)
    )


def top_sessions(plays: DataFrame, n: int, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """Every play of the n longest sessions, longest session first, plays in order.

    The slices of these sessions are a stored table that meets the plays by (user, slice); its
    size is known, so the planner sends it to the plays while it is small. A session that is
    most of the log stays spread over its slices until the final sort.
    """
    slices = session_slices(plays, gap_ms)
    best = slices.select("user", "slice", "user_session_id").join(
        longest_sessions(plays, n, gap_ms), ["user", "user_session_id"]
    )
    best = cut_lineage(best.select("user", "slice", "user_session_id", "session_length"), "longest-sessions")
    sliced = plays.withColumn("slice", slice_start(F.col("ts_ms"), slice_width(gap_ms)))
    # spread the matching plays first: a global sort samples its input, which must then be those
    # plays and not another scan of the log
    detailed = sliced.join(best, ["user", "slice"]).repartition("user", "slice")
    return detailed.orderBy(
        F.desc("session_length"), "user", "user_session_id", *play_order(plays)
    ).select(
        F.col("user_session_id").alias("sessionId"),
        F.col("session_length").alias("sessionLength"),
        "user",
        "artist",
        "song",
    )


def sessions_sql(spark: SparkSession, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """The SQL form of :func:`sessionize` over the view ``plays``, registered as ``sessions``."""
    order = ", ".join(play_order(spark.table("plays")))
    sessions = spark.sql(
        f"""
        WITH sliced AS (
          SELECT *, ts_ms - pmod(ts_ms, :width) AS slice FROM plays
        ),
        slices AS (
          SELECT user, slice, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts
          FROM sliced GROUP BY user, slice
        ),
        linked AS (
          SELECT *, lag(last_ts) OVER (PARTITION BY user ORDER BY slice) AS prev_ts FROM slices
        ),
        numbered AS (
          SELECT user, slice, prev_ts,
                 sum(CASE WHEN prev_ts IS NULL OR first_ts - prev_ts > :gap THEN 1 ELSE 0 END)
                   OVER (PARTITION BY user ORDER BY slice) AS user_session_id
          FROM linked
        ),
        placed AS (
          SELECT *, lag(ts_ms) OVER (PARTITION BY user, slice
                                     ORDER BY {order}) AS pts_here
          FROM sliced
        ),
        gaps AS (
          SELECT p.*, coalesce(p.pts_here, n.prev_ts) AS pts, n.user_session_id
          FROM placed p JOIN numbered n ON p.user = n.user AND p.slice = n.slice
        )
        SELECT * EXCEPT (slice, pts_here, pts, user_session_id),
               pts, ts_ms - pts AS pdiff,
               CASE WHEN pts IS NULL OR ts_ms - pts > :gap THEN 1 ELSE 0 END AS is_new_session,
               user_session_id
        FROM gaps
        """,
        args={"gap": gap_ms, "width": slice_width(gap_ms)},
    )
    sessions.createOrReplaceTempView("sessions")
    return sessions
