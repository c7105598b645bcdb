"""The seven questions about a listening log, each answered by one DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.models import next_song, next_time, recommend, store
from earshot.operators import rankings, sessions
from earshot.operators.users import Users, numbers_of
from earshot.sources.play_log import plays_from_raw, read_raw_log, read_raw_users, rejected_plays, with_play_numbers
from earshot.sources.profiles import read_profiles, rejected_profiles
from earshot.sources.table_functions import register_functions
from earshot.sources.tables import read_table, register_views, write_plays

Asked = str | Iterable[str] | DataFrame | None


class ListeningLog:
    """A raw log and its profiles. Nothing runs until an answer is used or a model trained.

    Per-user questions take a user name, several names, a DataFrame with ``user_id``, or
    nothing for all users. Users who are not in the log get no row. With ``model_dir``,
    models are kept there and loaded next time; ``retrain=True`` replaces them.
    """

    def __init__(
        self, raw_log: DataFrame, profiles: DataFrame, model_dir: str | None = None, retrain: bool = False
    ):
        self.spark = raw_log.sparkSession
        self.raw_log = raw_log
        self.plays = plays_from_raw(raw_log)
        self.profiles = profiles
        self._raw_users = raw_log
        self._model_dir = model_dir
        self._retrain = retrain
        self._models: dict[str, object] = {}
        self._files: tuple[str, str] | None = None

    @classmethod
    def from_files(
        cls, spark: SparkSession, log_path: str, profiles_path: str, model_dir: str | None = None, retrain: bool = False
    ) -> ListeningLog:
        log = cls(read_raw_log(spark, log_path), read_profiles(spark, profiles_path), model_dir, retrain)
        log._raw_users = read_raw_users(spark, log_path)
        log._files = log_path, profiles_path
        return log

    def rejected_lines(self) -> DataFrame:
        """``file``, ``line`` and ``reason`` of the lines that were left out; of a log from files."""
        if self._files is None:
            raise ValueError("only a log from files knows its lines")
        log_path, profiles_path = self._files
        of_log = rejected_plays(self.spark, log_path).withColumn("file", F.lit("plays"))
        of_profiles = rejected_profiles(self.spark.read.text(profiles_path)).withColumn("file", F.lit("profiles"))
        return of_log.unionByName(of_profiles).select("file", "line", "reason")

    def store(self, folder: str) -> None:
        """Write the tables as Parquet, so that later questions do not parse text again."""
        write_plays(with_play_numbers(self.raw_log), f"{folder}/raw_log")
        self.unique_users_raw().write.mode("overwrite").parquet(f"{folder}/raw_users")
        self.profiles.write.mode("overwrite").parquet(f"{folder}/profiles")

    @classmethod
    def from_store(
        cls, spark: SparkSession, folder: str, model_dir: str | None = None, retrain: bool = False
    ) -> ListeningLog:
        raw_log, profiles = read_table(spark, f"{folder}/raw_log"), read_table(spark, f"{folder}/profiles")
        log = cls(raw_log, profiles, model_dir, retrain)
        log._raw_users = read_table(spark, f"{folder}/raw_users")
        return log

    def register_views(self) -> None:
        """``plays``, ``profiles`` and the table functions for ``spark.sql``."""
        register_views(self.plays, self.profiles)
        register_functions(self.spark)

    def unique_users(self) -> DataFrame:
        return rankings.unique_users(self.plays)

    def unique_users_raw(self) -> DataFrame:
        return rankings.unique_users_raw(self._raw_users)

    def top_users(self, n: int) -> DataFrame:
        return rankings.top_users(self.plays, n)

    def top_songs(self, n: int) -> DataFrame:
        return rankings.top_songs(self.plays, n)

    def top_sessions(self, n: int, gap_ms: int = sessions.SESSION_GAP_MS) -> DataFrame:
        return sessions.top_sessions(self.plays, n, gap_ms)

    def predict_next_play_time(self, users: Asked = None, exact: bool = False) -> DataFrame:
        """From the gap after a play, by the hour; ``exact`` learns every gap before a play instead."""
        kind = {"bucket_ms": 1, "forward": False} if exact else {}
        model = self._model(
            "next_time_exact" if exact else "next_time",
            lambda path: next_time.train(self.plays, path, retrain=self._retrain, **kind),
        )
        return next_time.predict(model, self.plays, self._users(users))

    def predict_next_song(self, users: Asked = None) -> DataFrame:
        model = self._model(
            "next_song",
            lambda path: next_song.train(
                self.plays, self.profiles, path, retrain=self._retrain
            ),
        )
        return next_song.predict(model, self.plays, self.profiles, self._users(users))

    def recommend_artists(self, n: int, users: Asked = None) -> DataFrame:
        return recommend.recommend_artists(self._recommender("artistId"), self.plays, n, self._users(users))

    def recommend_songs(self, n: int, users: Asked = None) -> DataFrame:
        return recommend.recommend_songs(self._recommender("songId"), self.plays, n, self._users(users))

    def recommend(self, n: int, users: Asked = None) -> DataFrame:
        """Both kinds in one row per user, as arrays."""
        return recommend.one_row_per_user(self.recommend_artists(n, users), self.recommend_songs(n, users))

    def changed_models(self) -> DataFrame:
        """Stored models and whether the log has changed since they were trained."""
        names = ["next_time", "next_time_exact", "next_song", "recommend_songId", "recommend_artistId"]
        paths = {name: f"{self._model_dir}/{name}" for name in names} if self._model_dir else {}
        return store.changed_models(self.spark, paths, self.plays)

    def _recommender(self, item: str) -> recommend.Recommender:
        return self._model(
            f"recommend_{item}", lambda path: recommend.train(self.plays, item, path, self._retrain)
        )

    def _model(self, name: str, train):
        if name not in self._models:
            self._models[name] = train(f"{self._model_dir}/{name}" if self._model_dir else None)
        return self._models[name]

    def _users(self, users: Asked) -> Users:
        if users is None or isinstance(users, DataFrame):
            return users
        return numbers_of(self.spark, [users] if isinstance(users, str) else list(users))
