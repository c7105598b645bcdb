"""When the next play will be: naive Bayes on the hour and weekday of the last one.

Gaps are grouped into buckets of ``bucket_ms``; the classes are buckets, and the answer is
the median training gap of the predicted bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.functions.time import plus_ms
from earshot.models import bayes
from earshot.models.store import load_or_train
from earshot.operators.splits import with_split
from earshot.operators.timeline import HOUR_MS, play_gaps, with_next_ts
from earshot.operators.users import Users, last_play_by_user
from earshot.session import cut_lineage

FEATURES = ("user_id", "day_of_week", "hour_of_day")

# Enough for any bigint.
BUCKET_DIGITS = 19

# Different gaps of one bucket that a task may sort, and cells of a histogram beyond that.
SORTED_GAPS = 1_000_000
CELLS = 1_024


def _example_columns(plays: DataFrame) -> list[str]:
    return [c for c in ("event_id", "user", "ts_ms", "songId") if c in plays.columns] + list(FEATURES)


def gap_examples(plays: DataFrame) -> DataFrame:
    """The gap *before* each play, with that play's calendar; 0 for a user's first play."""
    return play_gaps(plays).select(*_example_columns(plays), F.coalesce("pdiff", F.lit(0)).alias("pdiff"))


def forward_gap_examples(plays: DataFrame) -> DataFrame:
    """The gap *after* each play that has a successor, with that play's calendar.

    This is the direction a prediction needs: it starts from a user's last play.
    """
    return (
        with_next_ts(plays)
        .filter(F.col("nts").isNotNull())
        .select(*_example_columns(plays), (F.col("nts") - F.col("ts_ms")).alias("gap_ms"))
    )


def split_examples(
    plays: DataFrame, bucket_ms: int = HOUR_MS, forward: bool = True
) -> DataFrame:
    """Gaps, their buckets, features and ``is_train``.

    ``forward=False`` with ``bucket_ms=1`` learns every gap as its own class from the plays
    that end it. Bucket numbers are padded, so their text order is their numeric order.
    """
    if forward:
        examples = forward_gap_examples(plays)
    else:
        examples = gap_examples(plays).withColumnRenamed("pdiff", "gap_ms")
    bucket = F.lpad(F.expr(f"gap_ms div {bucket_ms}").cast("string"), BUCKET_DIGITS, "0")
    return with_split(examples).select("is_train", "gap_ms", bucket.alias("bucket"), *FEATURES)


@dataclass(frozen=True)
class NextTimeModel:
    """A classifier of gap buckets and, for each bucket seen in training, its median gap."""

    classifier: bayes.BayesModel
    medians: DataFrame


def counted_gaps(training: DataFrame, weight: str | None = None) -> DataFrame:
    """Per (bucket, gap): the number of examples ``n`` and the sum of each feature."""
    n = F.col(weight) if weight else F.lit(1)
    return (
        bayes.as_features(training, FEATURES)
        .groupBy("bucket", "gap_ms")
        .agg(F.sum(n).alias("n"), *[F.sum(F.col(f) * n).alias(f) for f in FEATURES])
    )


def median_gaps(counted: DataFrame) -> DataFrame:
    """The median gap of each bucket: ``predicted_label, predicted_gap_ms``.

    The gaps of a bucket are sorted in one task as long as none has over ``SORTED_GAPS`` different
    ones; else the medians are closed in on by histograms, and no task sees more than a part of a bucket.
    """
    totals = cut_lineage(
        counted.groupBy("bucket").agg(
            F.sum("n").alias("total"), F.count("*").alias("gaps"), F.min("gap_ms").alias("low"), F.max("gap_ms").alias("high")
        ),
        "gap-totals",
    )
    most = totals.agg(F.max("gaps")).first()[0] or 0
    lower, upper = _sorted_medians(counted, totals) if most <= SORTED_GAPS else _closed_in_medians(counted, totals)
    joined = lower.join(upper, "bucket")
    middle = (F.col("lower") + (F.col("upper") - F.col("lower")) / 2).cast("long")
    return joined.select(F.col("bucket").alias("predicted_label"), middle.alias("predicted_gap_ms"))


def _sorted_medians(counted: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By running counts over the sorted gaps of each bucket."""
    ascending = Window.partitionBy("bucket").orderBy("gap_ms").rowsBetween(Window.unboundedPreceding, 0)
    place = counted.select("bucket", "gap_ms", F.sum("n").over(ascending).alias("upto")).join(totals, "bucket")

    def at(rank, name: str) -> DataFrame:
        return place.groupBy("bucket").agg(F.min(F.when(F.col("upto") > rank, F.col("gap_ms"))).alias(name))

    return at(F.floor((F.col("total") - 1) / 2), "lower"), at(F.ceil((F.col("total") - 1) / 2), "upper")


def _closed_in_medians(counted: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By histograms of ``CELLS`` cells over the range that holds the wanted rank, again and again.

    Every pass is an aggregation with map-side combine that leaves at most ``CELLS`` rows per bucket
    and rank; a range of any bigint is a single gap after seven passes.
    """
    ranks = F.array(
        F.struct(F.lit("lower").alias("which"), F.floor((F.col("total") - 1) / 2).alias("rank")),
        F.struct(F.lit("upper").alias("which"), F.ceil((F.col("total") - 1) / 2).alias("rank")),
    )
    state = totals.select("bucket", "low", "high", F.explode(ranks).alias("one")).select("bucket", "low", "high", "one.*")
    state = cut_lineage(state, "gap-ranges")
    while not state.where("low < high").isEmpty():
        width = F.expr(f"(high - low) div {CELLS} + 1")
        cells = (
            counted.join(state, "bucket")
            .where("gap_ms BETWEEN low AND high")
            .withColumn("cell", F.expr(f"(gap_ms - low) div ((high - low) div {CELLS} + 1)"))
            .groupBy("bucket", "which", "cell")
            .agg(F.sum("n").alias("n"))
        )
        upto = F.sum("n").over(Window.partitionBy("bucket", "which").orderBy("cell"))
        held = (
            cells.withColumn("upto", upto)
            .join(state, ["bucket", "which"])
            .where("rank < upto AND rank >= upto - n")
            .withColumn("start", F.col("low") + F.col("cell") * width)
        )
        state = cut_lineage(
            held.select(
                "bucket", F.col("start").alias("low"), F.least("high", F.col("start") + width - 1).alias("high"), "which",
                (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"),
            ),
            "gap-ranges",
        )
    return tuple(state.where(F.col("which") == name).select("bucket", F.col("low").alias(name)) for name in ("lower", "upper"))


def train_on(examples: DataFrame, weight: str | None = None) -> NextTimeModel:
    """Fit on the training side of :func:`split_examples`, which is read once."""
    counted = cut_lineage(counted_gaps(examples.filter("is_train"), weight), "gap-counts")
    totals = counted.groupBy(F.col("bucket").alias("label")).agg(
        F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in FEATURES]
    )
    return NextTimeModel(bayes.train(totals, FEATURES), cut_lineage(median_gaps(counted), "gap-medians"))


def _save(model: NextTimeModel, path: str) -> None:
    bayes.save(model.classifier, f"{path}/classifier")
    model.medians.write.mode("overwrite").parquet(f"{path}/medians")


def train(
    plays: DataFrame,
    path: str | None = None,
    bucket_ms: int = HOUR_MS,
    forward: bool = True,
    retrain: bool = False,
) -> NextTimeModel:
    """Fit, or load the model kept at ``path``."""

    def load(spark: SparkSession, saved: str) -> NextTimeModel:
        medians = spark.read.parquet(f"{saved}/medians")
        return NextTimeModel(bayes.load(spark, f"{saved}/classifier"), medians)

    def fit() -> NextTimeModel:
        return train_on(split_examples(plays, bucket_ms, forward))

    parameters = {"kind": "next_time", "features": FEATURES, "bucket_ms": bucket_ms, "forward": forward}
    return load_or_train(plays.sparkSession, path, parameters, fit, _save, load, retrain, plays)


def predict(model: NextTimeModel, plays: DataFrame, users: Users = None) -> DataFrame:
    """``predicted_ts`` per user, never before their last play."""
    last = last_play_by_user(plays, users).select("user", "ts", *FEATURES)
    return (
        bayes.predict(model.classifier, last, FEATURES)
        .join(model.medians, "predicted_label")
        .select(
            F.col("user_id").cast("int").alias("user_id"),
            "user",
            F.col("ts").alias("last_ts"),
            "predicted_gap_ms",
            plus_ms(F.col("ts"), F.col("predicted_gap_ms")).alias("predicted_ts"),
        )
    )


def holdout_accuracy(model: NextTimeModel, counted: DataFrame) -> DataFrame:
    """Share of test examples whose bucket is predicted, as one row."""
    return bayes.accuracy(model.classifier, counted.filter("NOT is_train"), "bucket", FEATURES, "n")


def train_and_score(
    plays: DataFrame, bucket_ms: int = HOUR_MS, forward: bool = True
) -> tuple[NextTimeModel, DataFrame]:
    """A model and its holdout accuracy; the test side is counted by bucket and features."""
    examples = split_examples(plays, bucket_ms, forward)
    model = train_on(examples)
    counted = (
        bayes.as_features(examples.filter("NOT is_train"), FEATURES)
        .groupBy("is_train", "bucket", *FEATURES)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return model, holdout_accuracy(model, counted)


def train_linear(plays: DataFrame) -> LinearRegressionModel:
    """Least squares of the gap on the same features, over all examples.

    Examples with equal features are replaced by their mean gap, weighted by their number.
    That leaves the solution unchanged and at most 168 rows per user to solve it from.
    """
    means = (
        forward_gap_examples(plays)
        .groupBy(*FEATURES)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("gap_ms").alias("mean_gap"))
    )
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    regression = LinearRegression(
        featuresCol="_features",
        labelCol="mean_gap",
        weightCol="n",
        predictionCol="predicted_gap",
        solver="normal",
    )
    return regression.fit(assembler.transform(cut_lineage(means, "gap-means")))


def linear_mse(model: LinearRegressionModel, plays: DataFrame) -> DataFrame:
    """Mean squared error over all examples, as one row."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    scored = model.transform(assembler.transform(forward_gap_examples(plays)))
    return scored.agg(F.avg(F.pow(F.col("predicted_gap") - F.col("gap_ms"), 2)).alias("mse"))


def predict_linear(
    model: LinearRegressionModel, plays: DataFrame, users: Users = None
) -> DataFrame:
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    last = last_play_by_user(plays, users).select("user", "ts", *FEATURES)
    gap = F.round("predicted_gap").cast("long")
    return model.transform(assembler.transform(last)).select(
        "user_id",
        "user",
        F.col("ts").alias("last_ts"),
        gap.alias("predicted_gap_ms"),
        plus_ms(F.col("ts"), gap).alias("predicted_ts"),
    )
