"""The play log: tab-separated lines of who played what and when.

Two layers, both DataFrames: the *raw log* (fields as they stand, instants parsed where
possible) and *plays* (only lines with a time and both ids, with the derived number
columns). Columns nobody asks for are not even parsed, so the derived ones cost nothing to
the queries that ignore them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.text import hash_key31, user_number
from earshot.functions.time import day_of_week, hour_of_day, play_time

LOG_SCHEMA = "user string, ts_text string, artistId string, artist string, songId string, song string"


def read_raw_log(spark: SparkSession, path: str) -> DataFrame:
    """Fields between tabs, without quoting; missing and empty ones are NULL."""
    fields = spark.read.schema(LOG_SCHEMA).csv(path, sep="\t", quote="", mode="PERMISSIVE")
    ts = play_time(F.col("ts_text"))
    return fields.select(
        "user", ts.alias("ts"), F.unix_millis(ts).alias("ts_ms"), "artistId", "artist", "songId", "song"
    )


def read_raw_users(spark: SparkSession, path: str) -> DataFrame:
    """``user``, the first field of every line of the file, whatever else the line holds."""
    return spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("user"))


def rejected_plays(spark: SparkSession, path: str) -> DataFrame:
    """``line`` and ``reason`` of every line of the file that is no play: the first of what it lacks.

    Reasons: ``blank line``, ``fields missing`` (none for the song id), ``unreadable time``, ``no artist id``, ``no
    song id``. Lines are read as they stand, so this is a pass of its own, for those who ask.
    """
    lines = spark.read.text(path)
    fields = F.split("value", "\t")
    named = lines.select("value", fields.alias("fields"), play_time(F.get(fields, F.lit(1))).alias("ts"))
    reason = (
        F.when(F.trim("value") == "", "blank line")
        .when(F.size("fields") < 5, "fields missing")
        .when(F.col("ts").isNull(), "unreadable time")
        .when(F.get("fields", F.lit(2)) == "", "no artist id")
        .when(F.get("fields", F.lit(4)) == "", "no song id")
    )
    return named.select(F.col("value").alias("line"), reason.alias("reason")).where("reason IS NOT NULL")


def identified_plays(raw_log: DataFrame) -> DataFrame:
    """Only rows that say when, by whom (artist) and what (song)."""
    return raw_log.filter(
        F.col("ts_ms").isNotNull() & (F.col("artistId") != "") & (F.col("songId") != "")
    )


def with_play_numbers(plays: DataFrame) -> DataFrame:
    """Add the numeric user, artist and song columns and the calendar fields of each play.

    Columns a stored table already has are kept, so filters on them still reach its scan.
    """
    numbers = {
        "user_id": user_number(F.col("user")),
        "artist_id": hash_key31(F.col("artistId")),
        "song_id": hash_key31(F.col("songId")),
        "day_of_week": day_of_week(F.col("ts")),
        "hour_of_day": hour_of_day(F.col("ts")),
    }
    return plays.withColumns({name: made for name, made in numbers.items() if name not in plays.columns})


def plays_from_raw(raw_log: DataFrame) -> DataFrame:
    return with_play_numbers(identified_plays(raw_log))


def read_plays(spark: SparkSession, path: str) -> DataFrame:
    return plays_from_raw(read_raw_log(spark, path))
