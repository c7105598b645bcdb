"""Artists and songs: names, dense numbers, play counts, and what a user has not heard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.users import Users, of_users
from earshot.session import cut_lineage

# Three hex digits bound the offset table at 4,096 rows.
_HASH_DIGITS = 3

# Items per block when complements are built; bounds the array in one row.
BLOCK_ITEMS = 4_096


def _latest_names(plays: DataFrame, key: str, names: list[str]) -> DataFrame:
    latest = F.max_by(F.struct(*names), F.struct("ts_ms", *names))
    return plays.groupBy(key).agg(latest.alias("named")).select(key, "named.*")


def artist_dimension(plays: DataFrame) -> DataFrame:
    """One row per artist id, with the name it was last played under."""
    return _latest_names(plays, "artistId", ["artist"])


def song_dimension(plays: DataFrame) -> DataFrame:
    """One row per song id, with the names it was last played under."""
    return _latest_names(plays, "songId", ["artistId", "artist", "song"])


def names_of(answers: DataFrame, dimension: DataFrame, item: str) -> DataFrame:
    """Rows of ``dimension`` for the items in ``answers``, as a stored table."""
    return cut_lineage(dimension.join(answers.select(item).distinct(), item, "left_semi"), "names")


def play_counts(plays: DataFrame, item: str) -> DataFrame:
    """Plays per user and item, the rating that recommendations are trained on."""
    return plays.groupBy("user_id", item).agg(F.count(F.lit(1)).alias("play_count"))


def song_ratings(plays: DataFrame) -> DataFrame:
    return play_counts(plays, "songId")


def artist_ratings(plays: DataFrame) -> DataFrame:
    return play_counts(plays, "artistId")


def item_index(items: DataFrame, item: str) -> DataFrame:
    """Number the distinct values of ``item`` 0, 1, 2 ... with no gap and no collision.

    A global ``row_number`` would sort the catalogue in one task. Numbering runs inside
    4,096 hash buckets instead, after an offset per bucket; only the offsets, one row per
    bucket, pass through a single task and a broadcast. The distinct values are written
    down first, so the log behind ``items`` is read once however often the index is used.
    """
    hashed = F.conv(F.substring(F.md5(item), 1, _HASH_DIGITS), 16, 10).cast("int")
    keyed = cut_lineage(items.select(item).distinct(), "items").withColumn("_bucket", hashed)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(item)) - 1
    numbered = keyed.withColumn("_place", place).join(F.broadcast(offsets), "_bucket")
    return numbered.select(item, (F.col("_offset") + F.col("_place")).alias("item_index"))


def extended_index(kept: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """``kept`` numbers as they are, and the next numbers for the values of ``item`` that it lacks.

    Nothing is ever renumbered or reused: what was stored under a number stays right as the
    catalogue grows, whether or not an item is played again. Numbers stay dense.
    """
    kept = kept.select(item, F.col("item_index").cast("long").alias("item_index"))
    following = kept.agg(F.coalesce(F.max("item_index") + 1, F.lit(0))).scalar()
    new = item_index(items.select(item).distinct().join(kept, item, "left_anti"), item)
    return kept.unionByName(new.withColumn("item_index", F.col("item_index") + following))


def unheard_ranges(plays: DataFrame, item: str, users: Users = None, index: DataFrame | None = None) -> DataFrame:
    """Items somebody played that the user did not, as ``user_id, low, high``: runs of item numbers, both ends in.

    ``users`` narrows the answer; without it, every user with a play is answered. A user has at most one
    run more than items heard, so the result is bounded by what was heard, not by users times items; a user who
    heard it all has none. ``index`` (:func:`item_index` of the log, made here without one) says what the numbers
    mean; :func:`expanded` turns runs into items. No (user, item) pair is built to be thrown away.
    """
    heard = of_users(plays.select("user_id", item), users).distinct()
    index = item_index(plays, item) if index is None else index
    n_items = index.agg(F.count(F.lit(1))).scalar()

    by_user = Window.partitionBy("user_id").orderBy("item_index")
    following = F.coalesce(F.lead("item_index").over(by_user), n_items)
    before = F.struct(
        F.lit(0).cast("long").alias("low"),
        F.when(F.col("_is_first"), F.col("item_index") - 1).otherwise(F.lit(-1)).alias("high"),
    )
    after = F.struct((F.col("item_index") + 1).alias("low"), (F.col("_following") - 1).alias("high"))
    return (
        heard.join(index, item)
        .withColumn("_is_first", F.lag("item_index").over(by_user).isNull())
        .withColumn("_following", following)
        .select("user_id", F.explode(F.array(before, after)).alias("range"))
        .select("user_id", "range.*")
        .filter("low <= high")
    )


def expanded(ranges: DataFrame, index: DataFrame, item: str) -> DataFrame:
    """``user_id`` and ``item`` for every number in ``ranges``, with ``index`` saying what it means.

    Runs are cut at blocks of the catalogue, and each piece takes its slice of the block it falls
    in: shuffles carry runs, never pairs. The output is as large as the runs are long, so ask for
    some users on a large log.
    """
    # A small catalogue is one block; the salt spreads the users who take slices of it.
    salts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ranges.withColumn(
        "block", F.explode(F.expr(f"sequence(low div {BLOCK_ITEMS}, high div {BLOCK_ITEMS})"))
    ).withColumn("salt", F.pmod(F.xxhash64("user_id"), F.lit(salts)))
    blocks = index.groupBy(F.expr(f"item_index div {BLOCK_ITEMS}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("item_index", item))).alias("items")
    ).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    base = F.col("block") * BLOCK_ITEMS
    start = F.greatest(F.col("low") - base, F.lit(0))
    end = F.least(F.col("high") - base, F.lit(BLOCK_ITEMS - 1))
    taken = F.slice(F.col("items"), (start + 1).cast("int"), (end - start + 1).cast("int"))
    return (
        pieces.join(blocks, ["block", "salt"])
        .select("user_id", F.explode(taken).alias("taken"))
        .select("user_id", F.col(f"taken.{item}").alias(item))
    )


def unheard_items(plays: DataFrame, item: str, users: Users = None) -> DataFrame:
    """Items somebody played that the user did not: ``user_id``, ``item``, one row per pair."""
    index = cut_lineage(item_index(plays, item), "item-index")
    return expanded(unheard_ranges(plays, item, users, index), index, item)
