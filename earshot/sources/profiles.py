"""User profiles: five tab-separated fields per line, with ``#`` comment lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.text import gender_code, hash_key31, integer_or_zero, user_number
from earshot.functions.time import registration_date

PROFILE_FIELDS = ("user", "gender", "age_text", "country", "registered_text")


def parse_profiles(lines: DataFrame) -> DataFrame:
    """Lines with exactly five fields, not counting empty ones at the end of the line."""
    content = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    fields = F.split(F.regexp_replace("value", "\t+$", ""), "\t")
    named = [F.get(fields, F.lit(i)).alias(name) for i, name in enumerate(PROFILE_FIELDS)]
    return (
        content.filter(F.size(fields) == len(PROFILE_FIELDS))
        .select(*named)
        .select(
            "user",
            "gender",
            integer_or_zero(F.col("age_text")).alias("age"),
            "country",
            registration_date(F.col("registered_text")).alias("registered"),
        )
        .filter(F.col("registered").isNotNull())
    )


def rejected_profiles(lines: DataFrame) -> DataFrame:
    """``line`` and ``reason`` of the lines that are no profile: ``comment``, ``blank line``, ``not five fields``, ``unreadable date``."""
    fields = F.split(F.regexp_replace("value", "\t+$", ""), "\t")
    date = registration_date(F.get(fields, F.lit(len(PROFILE_FIELDS) - 1)))
    reason = (
        F.when(F.col("value").startswith("#"), "comment")
        .when(F.trim("value") == "", "blank line")
        .when(F.size(fields) != len(PROFILE_FIELDS), "not five fields")
        .when(date.isNull(), "unreadable date")
    )
    return lines.select(F.col("value").alias("line"), reason.alias("reason")).where("reason IS NOT NULL")


def with_profile_numbers(profiles: DataFrame) -> DataFrame:
    return profiles.withColumns(
        {
            "user_id": user_number(F.col("user")),
            "gender_id": gender_code(F.col("gender")),
            "country_id": hash_key31(F.col("country")),
        }
    )


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return with_profile_numbers(parse_profiles(spark.read.text(path)))


def one_per_user(profiles: DataFrame) -> DataFrame:
    """One profile per user number, the first by name, so that joins cannot repeat plays."""
    fields = [c for c in profiles.columns if c != "user_id"]
    first = F.min(F.struct(*fields)).alias("profile")
    return profiles.groupBy("user_id").agg(first).select("user_id", "profile.*")
