"""Multinomial naive Bayes over any number of classes.

Training needs one pass over the examples: per class, a count and the sum of each feature.
``class_totals`` is that pass, an aggregation with map-side combine, and all else works on
its one row per class. The model stays a table of classes, so no catalogue is too large.

The class with the highest posterior is picked, the first by label on a tie. A score is a prior plus
weights times features that are never negative, so the largest prior and the largest weights
of a block of classes bound all its scores. Classes with like weights share a block (median splits of the
widest weight, as in a k-d tree). A point first visits the block of its highest bound, and then only the
blocks whose bound is not below the score it found there: the same answer as from all classes. Bounds
are added up in the order of the scores, and rounding keeps their order, so no margin is needed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from earshot.session import cut_lineage, ship_package

# Fixed value: additive smoothing.
SMOOTHING = 1.0

# Classes of a block, unless that made more blocks than may be sent to every task as bounds.
BLOCK_CLASSES = 2_048
MAX_BLOCKS = 16_384

# Classes that one task splits into blocks.
SPLIT_CLASSES = 262_144

# Points that meet a block at a time, in one task and in one matrix.
BLOCK_POINTS = 65_536
MATRIX_POINTS = 256


@dataclass(frozen=True)
class BayesModel:
    """``block``, ``label``, ``prior`` and a weight per feature (``w_`` and its name), one row per class."""

    classes: DataFrame
    features: tuple[str, ...]

    @property
    def numbers(self) -> list[str]:
        return ["prior", *(f"w_{f}" for f in self.features)]


def as_features(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles; missing and negative values (an age of -1) count as 0.

    The multinomial model has no meaning for a negative feature.
    """
    cleaned = {f: F.greatest(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features}
    return rows.withColumns(cleaned)


def class_totals(
    examples: DataFrame, label: str, features: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Per label: ``n`` examples and the sum of every feature.

    ``weight`` names a column that says how many examples a row stands for.
    """
    n = F.col(weight) if weight else F.lit(1)
    return (
        as_features(examples, features)
        .groupBy(F.col(label).cast("string").alias("label"))
        .agg(F.sum(n).alias("n"), *[F.sum(F.col(f) * n).alias(f) for f in features])
    )


def train(totals: DataFrame, features: Sequence[str]) -> BayesModel:
    """Fit on :func:`class_totals`. Of classes with equal totals, which always tie, the first is kept."""
    totals = cut_lineage(totals, "class-totals")
    told = totals.agg(F.count("*"), F.sum("n"), *[F.sum(f) for f in features]).first()
    n_classes, n_examples, *sums = told
    if n_classes == 0:
        raise ValueError("no training examples")
    mass = reduce(add, [F.col(f) for f in features]) + SMOOTHING * len(features)
    prior = F.log(F.col("n") + SMOOTHING) - F.log(F.lit(n_examples + n_classes * SMOOTHING))
    weights = [(F.log(F.col(f) + SMOOTHING) - F.log(mass)).alias(f"w_{f}") for f in features]
    firsts = totals.groupBy("n", *features).agg(F.min("label").alias("label"))
    model = BayesModel(firsts.select(F.lit(0).cast("long").alias("block"), "label", prior.alias("prior"), *weights), tuple(features))
    if n_classes <= BLOCK_CLASSES:
        return model
    return _in_blocks(model, n_classes, [total / n_examples for total in sums])


def _boxes(points: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Row numbers in groups of at most ``most``, cut at the median of the widest column again and again."""
    waiting = [np.arange(len(points))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= most:
            yield rows
            continue
        part = points[rows]
        order = np.argsort(part[:, np.argmax(np.ptp(part, axis=0))], kind="stable")
        waiting += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]


def _in_blocks(model: BayesModel, n_classes: int, means: Sequence[float]) -> BayesModel:
    """Classes of like weights get one block number; a weight counts as much as its feature is large."""
    numbers, scales = model.numbers, np.array([1.0, *means])
    most = max(BLOCK_CLASSES, -(-2 * n_classes // MAX_BLOCKS))
    n_parts, spread = -(-n_classes // SPLIT_CLASSES), model.classes.drop("block")
    ship_package(spread.sparkSession)
    if n_parts > 1:
        widths = spread.agg(*[F.max(c) - F.min(c) for c in numbers]).first()
        widest = numbers[int(np.argmax(np.array(widths) * scales))]
        spread = spread.repartitionByRange(n_parts, widest, "label")
    else:
        spread = spread.coalesce(1)  # at most SPLIT_CLASSES rows

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        if not len(rows):
            return
        part = int(rows["part"].iloc[0]) << 32
        rows = rows.drop(columns="part").sort_values("label", ignore_index=True)
        for at, chosen in enumerate(_boxes(rows[numbers].to_numpy() * scales, most)):
            yield rows.iloc[np.sort(chosen)].assign(block=part + at)

    schema = "label string, " + ", ".join(f"{c} double" for c in numbers) + ", block bigint"
    blocks = spread.withColumn("part", F.spark_partition_id()).mapInPandas(split, schema)
    return BayesModel(cut_lineage(blocks, "class-blocks"), model.features)


def _scores(points: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Scores of rows of features against rows of prior and weights, added up feature by feature."""
    scores = np.broadcast_to(numbers[:, 0], (len(points), len(numbers)))
    for at in range(points.shape[1]):
        scores = scores + numbers[:, at + 1] * points[:, at, None]
    return scores


def _best(points: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the place and the score of the best class, the first one on a tie."""
    places, best = np.empty(len(points), dtype=np.int64), np.empty(len(points))
    for at in range(0, len(points), MATRIX_POINTS):
        scores = _scores(points[at : at + MATRIX_POINTS], numbers)
        places[at : at + MATRIX_POINTS] = scores.argmax(axis=1)
        best[at : at + MATRIX_POINTS] = scores.max(axis=1)
    return places, best


def bounds(model: BayesModel) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the blocks and the largest prior and weights of each; at most ``MAX_BLOCKS`` or so."""
    rows = model.classes.groupBy("block").agg(*[F.max(c).alias(c) for c in model.numbers]).orderBy("block").collect()
    return np.array([row[0] for row in rows]), np.array([row[1:] for row in rows])


def predict(model: BayesModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with ``predicted_label``; the feature columns come back as doubles."""
    ship_package(rows.sparkSession)
    rows = as_features(rows, features)
    blocks, most = bounds(model)
    if len(blocks) == 1:
        return _predict_all(model, rows, features)
    points = cut_lineage(rows.select(*features).distinct(), "points")
    best = F.min(F.struct((-F.col("score")).alias("less"), "label"))
    first, rest = _visits(model, points, blocks, most)
    found = first.unionByName(_visited(model, rest)).groupBy(*features).agg(best.alias("best"))
    return rows.join(found.select(*features, F.col("best.label").alias("predicted_label")), list(features))


def visits(model: BayesModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: ``points``, ``blocks`` of classes, and ``visits``, how many pairs of them were scored."""
    ship_package(rows.sparkSession)
    points = cut_lineage(as_features(rows, features).select(*features).distinct(), "points")
    blocks, most = bounds(model)
    n_points = points.count()
    n_more = _visits(model, points, blocks, most)[1].count() if len(blocks) > 1 else 0
    schema = "points bigint, blocks bigint, visits bigint"
    return rows.sparkSession.createDataFrame([(n_points, len(blocks), n_points + n_more)], schema)


def _predict_all(model: BayesModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """All classes are one block, which every task gets."""
    classes = sorted(model.classes.select("label", *model.numbers).collect())
    labels, numbers = pa.array([row[0] for row in classes]), np.array([row[1:] for row in classes])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
            chosen = labels.take(pa.array(_best(points, numbers)[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, chosen], names=[*batch.schema.names, "predicted_label"])

    schema = StructType([*rows.schema.fields, StructField("predicted_label", StringType())])
    return rows.mapInArrow(score, schema)


def _visits(model: BayesModel, points: DataFrame, blocks: np.ndarray, most: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Every point after its most promising block, and the (point, block) pairs that may still do as well."""
    features = list(model.features)
    shape = ", ".join(f"{f} double" for f in features)

    def promising(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(block=blocks[_best(frame[features].to_numpy(), most)[0]])

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), MATRIX_POINTS):
                part = frame.iloc[at : at + MATRIX_POINTS]
                open_ = _scores(part[features].to_numpy(), most) >= part["score"].to_numpy()[:, None]
                open_ &= blocks != part["block"].to_numpy()[:, None]
                point, block = np.nonzero(open_)
                yield part[features].iloc[point].assign(block=blocks[block])

    first = cut_lineage(_visited(model, points.mapInPandas(promising, f"{shape}, block bigint")), "first-visits")
    return first, first.mapInPandas(others, f"{shape}, block bigint")


def _visited(model: BayesModel, pairs: DataFrame) -> DataFrame:
    """The best class of the block for each pair: the point, ``block``, ``score`` and ``label``.

    A block that very many points ask for is copied, so that no task gets over ``BLOCK_POINTS`` or so.
    """
    features, numbers = list(model.features), model.numbers
    pairs = cut_lineage(pairs, "visits")
    copies = pairs.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_POINTS).alias("copies"))
    copies = F.broadcast(cut_lineage(copies, "copies"))  # a row per block
    asked = pairs.join(copies, "block").withColumn("copy", F.pmod(F.xxhash64(*features), F.col("copies"))).drop("copies")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    sent = model.classes.join(copies, "block").withColumn("copy", every).drop("copies")

    def score(key: tuple, points: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        classes = classes.sort_values("label")
        places, best = _best(points[features].to_numpy(), classes[numbers].to_numpy())
        return points[[*features, "block"]].assign(score=best, label=classes["label"].to_numpy()[places])

    schema = ", ".join(f"{f} double" for f in features) + ", block bigint, score double, label string"
    keys = ["block", "copy"]
    return asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(score, schema)


def accuracy(model: BayesModel, counted: DataFrame, label: str, features: Sequence[str], weight: str) -> DataFrame:
    """``correct``, ``total`` and ``accuracy`` over held-out examples, as one row.

    ``weight`` says how many equal examples a row stands for; equal features are scored once.
    """
    hit = F.when(F.col("predicted_label") == F.col(label).cast("string"), F.col(weight)).otherwise(F.lit(0))
    return (
        predict(model, counted, features)
        .agg(F.coalesce(F.sum(hit), F.lit(0)).alias("correct"), F.coalesce(F.sum(weight), F.lit(0)).alias("total"))
        .withColumn("accuracy", F.try_divide("correct", "total"))
    )


def save(model: BayesModel, path: str) -> None:
    model.classes.write.mode("overwrite").parquet(f"{path}/classes")


def load(spark: SparkSession, path: str) -> BayesModel:
    classes = spark.read.parquet(f"{path}/classes")
    return BayesModel(classes, tuple(c.removeprefix("w_") for c in classes.columns if c.startswith("w_")))
