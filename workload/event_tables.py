"""A raw log and profile lines derived from the given parquet tables.

The rules are those of ``FIXTURES.md`` section 3; ``workload/oracle.py`` states them in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.text import integer_or_zero
from earshot.functions.time import naive_epoch_ms
from earshot.session import cut_lineage, shared_folder
from earshot.sources.play_log import plays_from_raw
from earshot.sources.profiles import with_profile_numbers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_name(number: Column) -> Column:
    """At least six digits; longer numbers are never cut."""
    return F.format_string("user_%06d", number.cast("long"))


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")
    padded = F.format_string("%03d", k)
    kind = F.col("event_type")
    artist_id = F.when((kind == "signup") & (k % 10 == 0), "").otherwise(F.concat(F.lit("art_"), padded))
    song_id = F.when(kind == "error", "").otherwise(F.concat(F.lit("song_"), padded, F.lit("_"), kind))
    return table(spark, sf_dir, "events").select(
        "event_id",
        user_name(F.col("user_id")).alias("user"),
        "ts",
        naive_epoch_ms(F.col("ts")).alias("ts_ms"),
        artist_id.alias("artistId"),
        F.concat(F.lit("Artist "), k.cast("string")).alias("artist"),
        song_id.alias("songId"),
        F.concat(F.lit("Song "), k.cast("string"), F.lit(" "), kind).alias("song"),
    )


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plays_from_raw(raw_log(spark, sf_dir))


def stored_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays with their numbers, written once: models read them several times."""
    return cut_lineage(plays(spark, sf_dir), "plays")


def write_log_lines(spark: SparkSession, sf_dir: str) -> str:
    """The log as a text file in a fresh part of the shared folder; returns its path."""
    path = shared_folder(spark, "play-log")
    log_lines(spark, sf_dir).write.text(path)
    return path


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log as text lines, with instants cut to whole seconds."""
    instant = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return raw_log(spark, sf_dir).select(
        F.concat_ws("\t", "user", instant, "artistId", "artist", "songId", "song").alias("value")
    )


def profile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as user profiles.

    Every tenth has no registration date, as a customer without orders, and its line is left out
    by the parser's rule of five fields. So joins miss some users.
    """
    first_order = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.min("o_orderdate").alias("registered"))
    )
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    segment = F.col("c_mktsegment")
    gender = (
        F.when(segment == "BUILDING", "m").when(segment == "AUTOMOBILE", "M").when(segment == "MACHINERY", "f").otherwise("")
    )
    age = F.when(F.col("c_acctbal") < 0, "").otherwise((15 + F.col("c_custkey") % 60).cast("string"))
    return (
        table(spark, sf_dir, "customer")
        .join(nations, "c_nationkey")
        .join(first_order, "c_custkey", "left")
        .select(
            user_name(F.col("c_custkey")).alias("user"),
            gender.alias("gender"),
            age.alias("age_text"),
            F.col("n_name").alias("country"),
            F.when(F.col("c_custkey") % 10 != 7, F.col("registered")).alias("registered"),
        )
    )


def profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles as text lines; a customer without a date leaves the last field empty."""
    registered = F.coalesce(F.date_format("registered", "MMM d, yyyy"), F.lit(""))
    return profile_fields(spark, sf_dir).select(
        F.concat_ws("\t", "user", "gender", "age_text", "country", registered).alias("value")
    )


def write_profile_lines(spark: SparkSession, sf_dir: str) -> str:
    """The profiles as a text file, after a header, a blank line and a line of four fields."""
    path = shared_folder(spark, "profiles")
    other = spark.createDataFrame([("#id\tgender\tage\tcountry\tregistered",), ("  ",), ("user_0\tm\t30\tnowhere",)], "value string")
    profile_lines(spark, sf_dir).union(other).write.text(path)
    return path


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = profile_fields(spark, sf_dir).filter(F.col("registered").isNotNull())
    return with_profile_numbers(
        known.select(
            "user",
            "gender",
            integer_or_zero(F.col("age_text")).alias("age"),
            "country",
            F.col("registered").cast("date").alias("registered"),
        )
    )
