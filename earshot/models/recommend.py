"""Artists and songs a user has not heard, ranked by a factor model of play counts.

A score is an inner product, at most the product of two lengths (Cauchy-Schwarz). Items are taken
by falling length, in chunks that may be sent to every task, and within a chunk in blocks; a user
visits blocks until the best that the next one could hold is below their n-th score. Only users still open go on to the
next chunk. The answer is that of all pairs.

Users whom the model does not know are folded in: their factors solve the regularised normal
equations of their current plays against the item factors, as a step of training would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.models.store import kept_versions, load_or_train
from earshot.operators.items import artist_dimension, extended_index, item_index, names_of, play_counts, song_dimension
from earshot.operators.users import Users, of_users
from earshot.session import cut_lineage, ensure_checkpoint_dir, ship_package

# The training parameters.
RANK = 10
ITERATIONS = 10
REGULARIZATION = 0.01
SEED = 11

# Factor blocks. They decide the first factors and so the answer; a parameter that is kept with
# the model, never taken from the data or the session. Raise it for more ratings than fit ten tasks.
BLOCKS = 10

# Users and items that are scored against each other at a time.
USER_BLOCK = 256
ITEM_BLOCK = 1_024

# Items (about 150 bytes each) that are sent to every task at a time.
CHUNK_ITEMS = 131_072

# A bound on a score is raised by more than rounding can lower it.
MARGIN = 1 + 1e-6


@dataclass(frozen=True)
class Recommender:
    """A factor model with what its item numbers mean."""

    als: ALSModel
    index: DataFrame
    item: str


def _fit(plays: DataFrame, item: str, blocks: int, known: DataFrame | None = None) -> Recommender:
    """``known`` are the numbers of an earlier model, which its items keep."""
    ensure_checkpoint_dir(plays.sparkSession)
    counts = cut_lineage(play_counts(plays, item), "play-counts")
    numbered = item_index(counts, item) if known is None else extended_index(known, counts, item)
    index = cut_lineage(numbered.withColumn("item_index", F.col("item_index").cast("int")), "item-index")
    ratings = counts.join(index, item).select(
        "user_id", "item_index", F.col("play_count").cast("float").alias("rating")
    )
    als = ALS(
        userCol="user_id",
        itemCol="item_index",
        ratingCol="rating",
        rank=RANK,
        maxIter=ITERATIONS,
        regParam=REGULARIZATION,
        seed=SEED,
        coldStartStrategy="drop",
        checkpointInterval=5,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
    )
    # the order of ratings within a block decides how sums are rounded
    ordered = cut_lineage(ratings.repartitionByRange(blocks, "user_id", "item_index").sortWithinPartitions("user_id", "item_index"), "ratings")
    return Recommender(als.fit(ordered), index, item)


def _save(model: Recommender, path: str) -> None:
    model.als.write().overwrite().save(f"{path}/als")
    model.index.write.mode("overwrite").parquet(f"{path}/index")


def train(
    plays: DataFrame, item: str, path: str | None = None, retrain: bool = False, blocks: int = BLOCKS
) -> Recommender:
    """Fit on all play counts of ``item`` (songId or artistId), or load from ``path``.

    A model that follows another one at ``path`` keeps its item numbers.
    """
    spark = plays.sparkSession

    def fit() -> Recommender:
        older = [kept for kept in kept_versions(spark, path) if kept["parameters"].get("item") == item] if path else []
        known = spark.read.parquet(f"{path}/{older[-1]['folder']}/index") if older else None
        return _fit(plays, item, blocks, known)

    def load(spark: SparkSession, saved: str) -> Recommender:
        return Recommender(ALSModel.load(f"{saved}/als"), spark.read.parquet(f"{saved}/index"), item)

    parameters = {"kind": "recommender", "item": item, "rank": RANK, "iterations": ITERATIONS, "blocks": blocks}
    return load_or_train(spark, path, parameters, fit, _save, load, retrain, plays)


@dataclass(frozen=True)
class Chunk:
    """Items by falling length: model numbers, ids, factors and lengths; orders by number and by id."""

    numbers: np.ndarray
    ids: np.ndarray
    factors: np.ndarray
    lengths: np.ndarray
    by_number: np.ndarray
    sorted_ids: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Chunk:
        factors = np.array([row.features for row in rows], dtype=np.float64).reshape(len(rows), RANK)
        lengths = np.sqrt((factors**2).sum(axis=1))
        ids = np.array([row.item for row in rows], dtype=str)
        order = np.lexsort((ids, -lengths))
        ids = ids[order]
        by_id, places = np.argsort(ids), np.empty(len(ids), dtype=np.int64)
        places[by_id] = 2 * np.arange(len(ids)) + 1  # an id of another chunk falls on an even place
        numbers = np.array([row.item_index for row in rows], dtype=np.int64)[order]
        return cls(numbers, ids, factors[order], lengths[order], np.argsort(numbers), ids[by_id], places)


def _length(features: str) -> Column:
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def _catalogue(model: Recommender) -> tuple[DataFrame, list[int]]:
    """Items with their factors and chunk, and the chunks by falling length."""
    factors = model.als.itemFactors.select(F.col("id").alias("item_index"), "features")
    items = factors.join(model.index.select(F.col(model.item).alias("item"), "item_index"), "item_index")
    n_items = model.index.count()
    if n_items <= CHUNK_ITEMS:
        return items.withColumn("chunk", F.lit(0)), [0]
    items = items.withColumn("length", _length("features"))
    n_bands = -(-2 * n_items // CHUNK_ITEMS)
    cuts = items.agg(F.percentile_approx("length", [at / n_bands for at in range(1, n_bands)], 10 * n_bands)).first()[0]
    cuts = sorted(set(cuts), reverse=True)
    band = reduce(lambda found, cut: found + (F.col("length") < cut).cast("int"), cuts, F.lit(0))
    banded = cut_lineage(items.withColumn("band", band), "catalogue-bands")
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).orderBy("band").collect()  # a few per chunk
    spread, first = {}, 0
    for row in sizes:  # a band of equal lengths may be large
        spread[row.band] = (first, -(-2 * row.n // CHUNK_ITEMS))
        first += spread[row.band][1]
    table = banded.sparkSession.createDataFrame([(k, a, n) for k, (a, n) in spread.items()], "band int, first int, parts int")
    chunk = F.col("first") + F.pmod(F.xxhash64("item"), F.col("parts")).cast("int")
    placed = banded.join(F.broadcast(table), "band").withColumn("chunk", chunk).drop("band", "first", "parts", "length")
    return cut_lineage(placed, "catalogue"), list(range(first))


def _pairs(rows: np.ndarray, scores: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best of each row, by score and then place, row by row."""
    order = np.lexsort((places, -scores, rows))
    in_order = rows[order]
    begins = np.searchsorted(in_order, in_order, side="left")
    return order[np.arange(len(order)) - begins < n]


def _visit(chunk: Chunk, users: np.ndarray, heard: tuple, best: tuple, n: int) -> tuple:
    """The n best items of each user so far, after this chunk, and the blocks visited.

    ``heard`` are (row, model number) pairs; ``best`` are rows, scores and ids from earlier chunks, in order.
    """
    rows, scores, ids = best
    places = 2 * np.searchsorted(chunk.sorted_ids, ids) if len(ids) else np.zeros(0, dtype=np.int64)
    lengths, visited = np.sqrt((users**2).sum(axis=1)), np.zeros(len(users), dtype=np.int64)
    order, (heard_row, heard_number) = chunk.by_number, heard
    found = np.searchsorted(chunk.numbers[order], heard_number)
    known = found < len(order)
    known[known] = chunk.numbers[order[found[known]]] == heard_number[known]
    heard_row, heard_at = heard_row[known], order[found[known]]
    for at in range(0, len(chunk.ids), ITEM_BLOCK):
        nth = np.full(len(users), -np.inf, dtype=np.float32)
        counts = np.bincount(rows, minlength=len(users))
        full = counts >= n
        nth[full] = scores[np.cumsum(counts)[full] - 1]
        active = np.flatnonzero((lengths * chunk.lengths[at] * MARGIN).astype(np.float32) >= nth)
        if not len(active):
            break
        visited[active] += 1
        block = slice(at, at + ITEM_BLOCK)
        # in double precision, so that the size of a block leaves no trace after rounding
        new = (users[active] @ chunk.factors[block].T).astype(np.float32)
        inside = (heard_at >= at) & (heard_at < at + new.shape[1])
        row_of = np.full(len(users), -1)
        row_of[active] = np.arange(len(active))
        masked_row, masked_at = row_of[heard_row[inside]], heard_at[inside] - at
        new[masked_row[masked_row >= 0], masked_at[masked_row >= 0]] = -np.inf
        last = min(n, new.shape[1]) - 1
        least = np.maximum(-np.partition(-new, last, axis=1)[:, last], nth[active])
        row, item = np.nonzero((new >= least[:, None]) & np.isfinite(new))
        rows, scores = np.concatenate([rows, active[row]]), np.concatenate([scores, new[row, item]])
        ids, places = np.concatenate([ids, chunk.ids[at + item]]), np.concatenate([places, chunk.places[at + item]])
        kept = _pairs(rows, scores, places, n)
        rows, scores, ids, places = rows[kept], scores[kept], ids[kept], places[kept]
    return rows, scores, ids, visited


def fold_in(model: Recommender, ratings: DataFrame) -> DataFrame:
    """``id, features`` of users from ``user_id, item_index, rating``, with the item factors as they are.

    Solves (X'X + REGULARIZATION n I) u = X'y of a user's n rated items X. A user's rows add up
    in parts before they meet, so one with very many is no task of their own.
    """
    spark = ratings.sparkSession
    ship_package(spark)
    upper = np.triu_indices(RANK)
    names = [f"s{at}" for at in range(len(upper[0]) + RANK + 1)]
    factors = model.als.itemFactors.select(F.col("id").alias("item_index"), "features")
    rated = ratings.join(factors, "item_index").select("user_id", F.col("rating").cast("double"), "features")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x, y = np.array(frame["features"].tolist(), dtype=np.float64), frame["rating"].to_numpy()[:, None]
            parts = np.hstack([x[:, upper[0]] * x[:, upper[1]], x * y, np.ones_like(y)])
            users, row = np.unique(frame["user_id"].to_numpy(), return_inverse=True)
            sums = np.zeros((len(users), parts.shape[1]))
            np.add.at(sums, row, parts)
            yield pd.DataFrame(sums, columns=names).assign(user_id=users)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = frame[names].to_numpy()
            left = np.zeros((len(sums), RANK, RANK))
            left[:, upper[0], upper[1]] = left[:, upper[1], upper[0]] = sums[:, : len(upper[0])]
            left += REGULARIZATION * sums[:, -1, None, None] * np.eye(RANK)
            found = np.linalg.solve(left, sums[:, len(upper[0]) : -1, None])[:, :, 0]
            yield pd.DataFrame({"id": frame["user_id"], "features": list(found.astype(np.float32))})

    shape = ", ".join(f"{name} double" for name in names) + ", user_id int"
    added = rated.mapInPandas(partial, shape).groupBy("user_id").agg(*[F.sum(name).alias(name) for name in names])
    return added.mapInPandas(solve, "id int, features array<float>")


def _with_factors(model: Recommender, counts: DataFrame) -> DataFrame:
    """``user_id, features`` of every user with a count; zeros for one who only heard items the model does not know."""
    factors = model.als.userFactors.select(F.col("id").alias("user_id"), "features")
    asked = cut_lineage(counts.select("user_id").distinct().join(factors, "user_id", "left"), "asked-users")
    new = asked.where("features IS NULL").select("user_id")
    if new.isEmpty():
        return asked
    ratings = counts.where("item_index IS NOT NULL").join(new, "user_id", "left_semi")
    folded = fold_in(model, ratings.select("user_id", "item_index", F.col("count").alias("rating")))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), RANK)
    added = new.join(folded.withColumnRenamed("id", "user_id"), "user_id", "left")
    return asked.where("features IS NOT NULL").unionByName(added.select("user_id", F.coalesce("features", zeros).alias("features")))


def _ranked(model: Recommender, plays: DataFrame, n: int, users: Users) -> DataFrame:
    """One row per user: ``scores`` and ``items``, best first, and how many blocks of items were ``visited``."""
    spark = plays.sparkSession
    ship_package(spark)
    catalogue, chunks = _catalogue(model)
    names = catalogue.select(F.col("item").alias(model.item), "item_index", "chunk")
    counts = of_users(plays.select("user_id", model.item), users).groupBy("user_id", model.item).count().join(names, model.item, "left")
    counts = cut_lineage(counts.drop(model.item), "heard")
    state = _with_factors(model, counts)
    for column, kind in (("scores", "array<float>"), ("items", "array<string>")):
        state = state.withColumn(column, F.array().cast(kind))
    state, closed = state.withColumn("visited", F.lit(0).cast("long")), []

    def visits(sent, n_next: float):
        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, USER_BLOCK):
                    batch = whole.slice(at, USER_BLOCK)
                    user_id, features, scores, items, visited, heard = (
                        batch.column(c) for c in ("user_id", "features", "scores", "items", "visited", "heard")
                    )
                    matrix = features.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                    heard_row = np.repeat(np.arange(batch.num_rows), [0 if x is None else len(x) for x in heard.to_pylist()])
                    heard_number = heard.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    lengths = [len(x) for x in items.to_pylist()]
                    best = (
                        np.repeat(np.arange(batch.num_rows), lengths),
                        scores.flatten().to_numpy(zero_copy_only=False).astype(np.float32),
                        np.array(items.flatten().to_pylist(), dtype=str),
                    )
                    rows, points, ids, more = _visit(sent.value, matrix, (heard_row, heard_number), best, n)
                    counted = np.bincount(rows, minlength=batch.num_rows)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(counted)]), pa.int32())
                    bound = (np.sqrt((matrix**2).sum(axis=1)) * n_next * MARGIN).astype(np.float32)
                    nth = np.where(counted >= n, points[np.minimum(np.cumsum(counted), len(points)) - 1] if len(points) else 0, -np.inf)
                    yield pa.RecordBatch.from_arrays(
                        [
                            user_id, features, pa.ListArray.from_arrays(offsets, pa.array(points, pa.float32())),
                            pa.ListArray.from_arrays(offsets, pa.array(ids.tolist(), pa.string())),
                            pa.array(visited.to_numpy() + more), pa.array(bound >= nth),
                        ],
                        names=["user_id", "features", "scores", "items", "visited", "open"],
                    )

        return visit

    loaded = Chunk.of(catalogue.where(F.col("chunk") == chunks[0]).collect())
    for at, chunk in enumerate(chunks):
        following = Chunk.of(catalogue.where(F.col("chunk") == chunks[at + 1]).collect()) if at + 1 < len(chunks) else None
        heard = counts.where(F.col("chunk") == chunk).groupBy("user_id").agg(F.collect_list("item_index").alias("heard"))
        # the length of the longest item to come: later parts of a band may hold longer ones than the next
        n_next = _longest_after(catalogue, chunk) if following is not None else 0.0
        schema = "user_id int, features array<float>, scores array<float>, items array<string>, visited bigint, open boolean"
        state = state.join(heard, "user_id", "left").mapInArrow(visits(spark.sparkContext.broadcast(loaded), n_next), schema)
        if following is not None:
            state = cut_lineage(state, "recommending")
            closed.append(state.where("NOT open").drop("open"))
            state = state.where("open").drop("open")
            if state.isEmpty():
                break
        loaded = following
    found = reduce(DataFrame.unionByName, closed, state.drop("open"))
    return found.select("user_id", "scores", "items", "visited")


def _longest_after(catalogue: DataFrame, chunk: int) -> float:
    return catalogue.where(F.col("chunk") > chunk).agg(F.max(_length("features"))).first()[0] or 0.0


def recommend(model: Recommender, plays: DataFrame, n: int, users: Users = None) -> DataFrame:
    """The n best unheard items per user: ``user_id``, ``rank``, ``score`` and the item, ties by its id.

    What is heard comes from ``plays``, so a play after training removes its item, and users
    newer than the model are folded in.
    """
    found = _ranked(model, plays, n, users).select("user_id", F.posexplode(F.arrays_zip("scores", "items")).alias("at", "found"))
    return found.select(
        "user_id", (F.col("at") + 1).alias("rank"), F.col("found.scores").alias("score"), F.col("found.items").alias(model.item)
    )


def visited_blocks(model: Recommender, plays: DataFrame, n: int, users: Users = None) -> DataFrame:
    """``user_id`` and the blocks of items ``visited`` for their n best."""
    return _ranked(model, plays, n, users).select("user_id", "visited")


def _named(model: Recommender, plays: DataFrame, n: int, users: Users, dimension: DataFrame) -> DataFrame:
    """One item may be recommended to everybody, so names and answers meet as stored tables."""
    answers = cut_lineage(recommend(model, plays, n, users), "recommendations")
    return answers.join(names_of(answers, dimension, model.item), model.item)


def recommend_songs(model: Recommender, plays: DataFrame, n: int, users: Users = None) -> DataFrame:
    return _named(model, plays, n, users, song_dimension(plays)).select(
        "user_id", "rank", "score", "artistId", "artist", "songId", "song"
    )


def recommend_artists(model: Recommender, plays: DataFrame, n: int, users: Users = None) -> DataFrame:
    return _named(model, plays, n, users, artist_dimension(plays)).select(
        "user_id", "rank", "score", "artistId", "artist"
    )


def one_row_per_user(artists: DataFrame, songs: DataFrame) -> DataFrame:
    """Both answers nested: ``user_id``, ``artists``, ``songs``, arrays of at most n structs."""

    def nested(ranked: DataFrame, fields: list[str], name: str) -> DataFrame:
        in_order = F.sort_array(F.collect_list(F.struct("rank", *fields)))
        return ranked.groupBy("user_id").agg(
            F.transform(in_order, lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(name)
        )

    return nested(artists, ["artistId", "artist"], "artists").join(
        nested(songs, ["artistId", "artist", "songId", "song"], "songs"), "user_id", "full"
    )
