"""Which song comes next: naive Bayes on the current song and the user's profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import hash_key31
from earshot.models import bayes
from earshot.models.store import load_or_train
from earshot.operators.items import names_of, song_dimension
from earshot.operators.splits import with_split
from earshot.operators.timeline import next_song_pairs
from earshot.operators.users import Users, last_play_by_user, with_profile
from earshot.session import cut_lineage

FEATURES = ("user_id", "song_id", "country_id", "gender_id", "age")


def next_song_examples(plays: DataFrame, profiles: DataFrame) -> DataFrame:
    """One example per play that has a successor.

    ``next_songId`` is the label; ``next_song_id`` is its hash key, for information only,
    because two songs may share one. Profiles are unique per user when they join, so they
    cannot change who follows whom.
    """
    identity = [c for c in ("event_id", "user", "ts_ms", "songId") if c in plays.columns]
    return next_song_pairs(plays, profiles).select(
        *identity,
        *FEATURES,
        "next_songId",
        hash_key31(F.col("next_songId")).alias("next_song_id"),
    )


def split_examples(plays: DataFrame, profiles: DataFrame) -> DataFrame:
    """Labels, features and ``is_train``."""
    examples = with_split(next_song_examples(plays, profiles))
    return examples.select("is_train", "next_songId", *FEATURES)


def counted_examples(plays: DataFrame, profiles: DataFrame) -> DataFrame:
    """Equal examples of either side of the split as one row, with their number ``n``."""
    examples = bayes.as_features(split_examples(plays, profiles), FEATURES)
    return examples.groupBy("is_train", "next_songId", *FEATURES).agg(F.count(F.lit(1)).alias("n"))


def train_on(examples: DataFrame, weight: str | None = None) -> bayes.BayesModel:
    """Fit on the training side of :func:`split_examples` (or the counted ones)."""
    return bayes.train(bayes.class_totals(examples.filter("is_train"), "next_songId", FEATURES, weight), FEATURES)


def train(
    plays: DataFrame,
    profiles: DataFrame,
    path: str | None = None,
    retrain: bool = False,
) -> bayes.BayesModel:
    """Fit, or load the model kept at ``path``."""

    def fit() -> bayes.BayesModel:
        return train_on(split_examples(plays, profiles))

    parameters = {"kind": "next_song", "features": FEATURES}
    return load_or_train(plays.sparkSession, path, parameters, fit, bayes.save, bayes.load, retrain, plays)


def predict(
    model: bayes.BayesModel, plays: DataFrame, profiles: DataFrame, users: Users = None
) -> DataFrame:
    """The song each user will probably play after their last one.

    One song may be predicted for most users, so names are looked up for the distinct
    predicted songs, and both sides of that join are stored tables.
    """
    last = cut_lineage(with_profile(last_play_by_user(plays, users), profiles).select("user", *FEATURES), "last-plays")
    predicted = cut_lineage(
        bayes.predict(model, last, FEATURES).select(
            F.col("user_id").cast("int").alias("user_id"), "user", F.col("predicted_label").alias("songId")
        ),
        "predicted-songs",
    )
    return predicted.join(names_of(predicted, song_dimension(plays), "songId"), "songId").select(
        "user_id", "user", "artistId", "artist", "songId", "song"
    )


def holdout_accuracy(model: bayes.BayesModel, counted: DataFrame) -> DataFrame:
    """Accuracy on the test side of :func:`counted_examples`, as one row."""
    return bayes.accuracy(model, counted.filter("NOT is_train"), "next_songId", FEATURES, "n")


def train_and_score(plays: DataFrame, profiles: DataFrame) -> tuple[bayes.BayesModel, DataFrame]:
    """A model and its holdout accuracy, from one aggregation of the examples."""
    counted = cut_lineage(counted_examples(plays, profiles), "next-song-counts")
    model = train_on(counted, "n")
    return model, holdout_accuracy(model, counted)
