"""What several text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.session import cut_lineage, ship_package

#: White space that separates words: space and the characters 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"

#: Rows of ids (about 40 bytes each in a hash table) that every executor may be sent.
BROADCAST_ROWS = 500_000


#: Rows that travel together between the JVM and Python; texts can be long.
BATCH_ROWS = 1_000
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder; later reads survive lost executors."""
    return cut_lineage(df, name)


def text_or_empty() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def narrow(df: DataFrame) -> DataFrame:
    """``df`` of short stored rows, sent to all executors if its counted rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def without(docs: DataFrame, dropped: DataFrame, digest: Column) -> DataFrame:
    """``docs`` less the rows whose id and ``digest`` stand in ``dropped`` (``doc_id, digest``).

    Rows that share an id are told apart by what the verdict was about. The digest is computed only for
    rows whose id stands there: written as two comparisons, it is no key of the join.
    """
    gone = stored(dropped.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct(), "dropped")
    same = (digest >= F.col("__digest")) & (digest <= F.col("__digest"))
    return docs.join(narrow(gone), F.col("doc_id").eqNullSafe(F.col("__id")) & same, "left_anti")


def ship(spark: SparkSession) -> None:
    """Make ready for Python workers: they get this package, and texts in batches that stay small."""
    ship_package(spark)
    if int(spark.conf.get(ROWS_SETTING)) > BATCH_ROWS:
        spark.conf.set(ROWS_SETTING, BATCH_ROWS)
