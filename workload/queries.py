"""The registered queries: every operator over the whole derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot import ListeningLog
from earshot.functions.text import hash_key31, user_number
from earshot.functions.time import plus_ms
from earshot.models import next_song, next_time, recommend, store
from earshot.operators import items, rankings, sessions, splits, timeline, users
from earshot.session import cut_lineage, shared_folder
from earshot.sources.play_log import identified_plays, read_plays
from earshot.sources.profiles import parse_profiles
from earshot.sources.table_functions import register_functions
from earshot.sources.tables import register_views
from workload.event_tables import plays, profiles, raw_log, stored_plays, write_log_lines, write_profile_lines

Query = Callable[[SparkSession, str], DataFrame]

TOP_N = 10
TOP_SESSIONS = 20
RECOMMENDATIONS = 5
# Users that a model is trained on; the others are new to it.
OLD_USERS = "user_id % 3 <> 0"
# Plays that an item dictionary starts from.
FIRST_HOURS = "hour_of_day < 2"


def scan_play_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_plays(spark, write_log_lines(spark, sf_dir)).select(
        "user", "ts_ms", "artistId", "artist", "songId", "song", "user_id", "artist_id", "song_id"
    )


def scan_user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_profiles(spark.read.text(write_profile_lines(spark, sf_dir)))


def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ListeningLog.from_files(spark, write_log_lines(spark, sf_dir), write_profile_lines(spark, sf_dir))
    return log.rejected_lines().groupBy("file", "reason").count().withColumnRenamed("count", "n_lines")


def user_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("user", "user_id", "gender_id", "age", "country_id")


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified_plays(raw_log(spark, sf_dir)).select("event_id", "user", "ts_ms", "artistId", "songId")


def hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = plays(spark, sf_dir)
    texts = log.select(F.col("songId").alias("text")).union(log.select("artistId"))
    return texts.distinct().select("text", hash_key31(F.col("text")).alias("hash_key"))


def play_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plays(spark, sf_dir).select("event_id", "day_of_week", "hour_of_day")


def play_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.play_gaps(plays(spark, sf_dir)).select("event_id", "user", "ts_ms", "pts", "pdiff")


def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionize(plays(spark, sf_dir)).select(
        "event_id", "user", "ts_ms", "pts", "pdiff", "is_new_session", "user_session_id"
    )


def sessions_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(plays(spark, sf_dir))
    return sessions.sessions_sql(spark).select(
        "event_id", "user", "ts_ms", "pts", "pdiff", "is_new_session", "user_session_id"
    )


def _in_sql(question: str) -> Query:
    """A question to the table functions over the view ``plays``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(plays(spark, sf_dir))
        register_functions(spark)
        return spark.sql(question)

    return query


def next_song_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.next_song_pairs(plays(spark, sf_dir)).select("event_id", "user", "ts_ms", "songId", "next_songId")


def plays_with_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.plays_with_profile(plays(spark, sf_dir), profiles(spark, sf_dir)).select(
        "event_id", "user_id", "songId", "gender", "age", "country", "gender_id", "country_id"
    )


def last_play_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.last_play_by_user(plays(spark, sf_dir)).select("user_id", "user", "ts_ms", "artistId", "songId")


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.with_split(plays(spark, sf_dir)).select("event_id", "is_train")


def next_song_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_song.next_song_examples(plays(spark, sf_dir), profiles(spark, sf_dir)).select(
        "event_id", *next_song.FEATURES, "next_songId", "next_song_id"
    )


def predict_next_song(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, people = stored_plays(spark, sf_dir), profiles(spark, sf_dir)
    return next_song.predict(next_song.train(log, people), log, people)


def next_song_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, accuracy = next_song.train_and_score(plays(spark, sf_dir), profiles(spark, sf_dir))
    return accuracy


def gap_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_time.gap_examples(plays(spark, sf_dir)).select("event_id", *next_time.FEATURES, "pdiff")


def forward_gap_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_time.forward_gap_examples(plays(spark, sf_dir)).select("event_id", *next_time.FEATURES, "gap_ms")


def predict_next_play_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stored_plays(spark, sf_dir)
    return next_time.predict(next_time.train(log), log)


def next_time_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, accuracy = next_time.train_and_score(plays(spark, sf_dir))
    return accuracy


def next_time_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in whole seconds: the last digits of a millisecond depend on the order of sums."""
    log = plays(spark, sf_dir)
    seconds = F.round(F.col("predicted_gap_ms") / 1000).cast("long")
    return next_time.predict_linear(next_time.train_linear(log), log).select(
        "user_id",
        "user",
        "last_ts",
        seconds.alias("predicted_gap_s"),
        plus_ms(F.col("last_ts"), seconds * 1000).alias("predicted_ts"),
    )


def next_time_linear_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = plays(spark, sf_dir)
    mse = next_time.linear_mse(next_time.train_linear(log), log)
    return mse.select(F.round(F.sqrt("mse") / 1000).cast("long").alias("rmse_s"))


def predict_next_play_time_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stored_plays(spark, sf_dir)
    return next_time.predict(next_time.train(log, bucket_ms=1, forward=False), log)


def predict_next_play_time_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of a model that was saved and loaded again."""
    log, folder = stored_plays(spark, sf_dir), shared_folder(spark, "models")
    next_time.train(log, f"{folder}/next_time")
    return next_time.predict(next_time.train(log, f"{folder}/next_time"), log)


def changed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored models, one of them trained before the log grew."""
    log, folder = stored_plays(spark, sf_dir), shared_folder(spark, "models")
    paths = {name: f"{folder}/{name}" for name in ("next_time", "next_song")}
    next_time.train(log.where(OLD_USERS), paths["next_time"])
    next_song.train(log, profiles(spark, sf_dir), paths["next_song"])
    return store.changed_models(spark, paths, log)


def recommend_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stored_plays(spark, sf_dir)
    return recommend.recommend_songs(recommend.train(log, "songId"), log, RECOMMENDATIONS)


def recommend_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stored_plays(spark, sf_dir)
    return recommend.recommend_artists(recommend.train(log, "artistId"), log, RECOMMENDATIONS)


def _recommend_check(spark: SparkSession, sf_dir: str, item: str, trained_on: str = "true") -> DataFrame:
    """What must hold of every user's recommendations, one row per user."""
    log = stored_plays(spark, sf_dir)
    found = recommend.recommend(recommend.train(log.where(trained_on), item), log, RECOMMENDATIONS)
    heard = log.select("user_id", item).distinct().withColumn("was_heard", F.lit(True))
    before = F.lag("score").over(Window.partitionBy("user_id").orderBy("rank"))
    by_user = (
        found.join(heard, ["user_id", item], "left")
        .withColumn("before", before)
        .groupBy("user_id")
        .agg(
            F.count("*").alias("n"),
            F.count_distinct("rank").alias("ranks"),
            F.max("rank").alias("last"),
            F.count_if(F.col("score") > F.col("before")).alias("rises"),
            F.count("was_heard").alias("n_heard"),
        )
    )
    return (
        log.select("user_id").distinct().join(by_user, "user_id", "left").select(
            "user_id",
            F.coalesce("n", F.lit(0)).alias("n_items"),
            F.coalesce((F.col("ranks") == F.col("n")) & (F.col("last") == F.col("n")), F.lit(True)).alias("ranks_run"),
            F.coalesce(F.col("rises") == 0, F.lit(True)).alias("scores_fall"),
            F.coalesce(F.col("n_heard") == 0, F.lit(True)).alias("none_heard"),
        )
    )


def asked_users(log: DataFrame) -> DataFrame:
    """The users of ``top_users``, as a table."""
    return rankings.top_users(log, TOP_N).select(user_number(F.col("userName")).alias("user_id"))


def last_play_of_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = plays(spark, sf_dir)
    return users.last_play_by_user(log, asked_users(log)).select("user_id", "user", "ts_ms", "artistId", "songId")


def unheard_of_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = plays(spark, sf_dir)
    return items.unheard_items(log, "songId", asked_users(log))


def lasting_song_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs of the first hours keep their numbers when all others join them."""
    log = plays(spark, sf_dir)
    first = cut_lineage(items.item_index(log.where(FIRST_HOURS), "songId"), "song-numbers")
    return items.extended_index(first, log, "songId")


QUERIES: dict[str, Query] = {
    "scan_play_log": scan_play_log,
    "scan_user_profiles": scan_user_profiles,
    "rejected_lines": rejected_lines,
    "identified_plays": identified,
    "user_dimension": user_dimension,
    "hash_key31": hash_keys,
    "play_calendar": play_calendar,
    "unique_users": lambda spark, sf_dir: rankings.unique_users(plays(spark, sf_dir)),
    "unique_users_raw": lambda spark, sf_dir: rankings.unique_users_raw(raw_log(spark, sf_dir)),
    "top_users": lambda spark, sf_dir: rankings.top_users(plays(spark, sf_dir), TOP_N),
    "top_songs": lambda spark, sf_dir: rankings.top_songs(plays(spark, sf_dir), TOP_N),
    "play_gaps": play_gaps,
    "sessionize": sessionize,
    "sessions_sql": sessions_sql,
    "session_lengths": lambda spark, sf_dir: sessions.session_lengths(plays(spark, sf_dir)),
    "top_sessions": lambda spark, sf_dir: sessions.top_sessions(plays(spark, sf_dir), TOP_SESSIONS),
    "top_users_sql": _in_sql(f"SELECT * FROM top_users({TOP_N})"),
    "top_songs_sql": _in_sql(f"SELECT * FROM top_songs({TOP_N})"),
    "top_sessions_sql": _in_sql(f"SELECT * FROM top_sessions({TOP_SESSIONS})"),
    "session_lengths_sql": _in_sql(
        f"SELECT user, user_session_id, session_length FROM listening_sessions({sessions.SESSION_GAP_MS}L)"
    ),
    "last_plays_sql": _in_sql("SELECT * FROM last_plays()"),
    "artist_dimension": lambda spark, sf_dir: items.artist_dimension(plays(spark, sf_dir)),
    "song_dimension": lambda spark, sf_dir: items.song_dimension(plays(spark, sf_dir)),
    "artist_ratings": lambda spark, sf_dir: items.artist_ratings(plays(spark, sf_dir)),
    "song_ratings": lambda spark, sf_dir: items.song_ratings(plays(spark, sf_dir)),
    "plays_with_profile": plays_with_profile,
    "last_play_by_user": last_play_by_user,
    "unheard_artists": lambda spark, sf_dir: items.unheard_items(plays(spark, sf_dir), "artistId"),
    "unheard_songs": lambda spark, sf_dir: items.unheard_items(plays(spark, sf_dir), "songId"),
    "lasting_song_numbers": lasting_song_numbers,
    "unheard_artist_ranges": lambda spark, sf_dir: items.unheard_ranges(plays(spark, sf_dir), "artistId"),
    "unheard_song_ranges": lambda spark, sf_dir: items.unheard_ranges(plays(spark, sf_dir), "songId"),
    "recommend_artists": recommend_artists,
    "recommend_songs": recommend_songs,
    "recommend_artists_check": lambda spark, sf_dir: _recommend_check(spark, sf_dir, "artistId"),
    "recommend_songs_check": lambda spark, sf_dir: _recommend_check(spark, sf_dir, "songId"),
    "recommend_new_users_check": lambda spark, sf_dir: _recommend_check(spark, sf_dir, "songId", OLD_USERS),
    "last_play_of_asked": last_play_of_asked,
    "unheard_songs_of_asked": unheard_of_asked,
    "next_song_pairs": next_song_pairs,
    "next_song_examples": next_song_examples,
    "train_test_split": train_test_split,
    "predict_next_song": predict_next_song,
    "next_song_accuracy": next_song_accuracy,
    "gap_examples": gap_examples,
    "forward_gap_examples": forward_gap_examples,
    "predict_next_play_time": predict_next_play_time,
    "predict_next_play_time_exact": predict_next_play_time_exact,
    "predict_next_play_time_stored": predict_next_play_time_stored,
    "changed_models": changed_models,
    "next_time_accuracy": next_time_accuracy,
    "next_time_linear": next_time_linear,
    "next_time_linear_error": next_time_linear_error,
}
