"""Exact copies: group by a 128-bit content hash, compare bytes inside the groups.

Texts are equal when they are identical without white space. Of equal texts the row with the most
code points stays, and among those the one with the smallest ``doc_id``.

A null text counts as empty, and all empty texts are copies of each other. Rows that repeat a
``doc_id`` are judged each by its own text; equal ones count as separate copies and get the same answer. A
null ``doc_id`` comes after all others, so such a row stays only where no row with an id has its text.
An empty table gives no rows. Other columns of the input are ignored by ``copies`` and kept by ``without_copies``.

Only hashes are shuffled for all rows. Texts move for members of groups alone: the text of a copy
meets the text of the row that stays in a join whose sides are bare exchanges, so that adaptive
execution can split a row with very many copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import SPACES, narrow, stored, text_or_empty, without


def content(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, SPACES, "")


def _choose(members: DataFrame, *keys: str) -> DataFrame:
    """Size and staying row (its id and SHA-256) of each group of equal keys."""
    order = F.struct((-F.col("n_points")).alias("fewer"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sha256")
    first = F.min(order)
    return members.groupBy(*keys).agg(
        F.count("*").alias("group_size"), first["doc_id"].alias("keep_id"), first["sha256"].alias("keep_sha256")
    )


def _of_row() -> Column:
    """The row ``doc_id, sha256`` is the one named by ``__id`` and ``__sha256``.

    Two comparisons are no key of a join, so digests are made only for rows whose id is met.
    """
    same = (F.col("__sha256") >= F.col("sha256")) & (F.col("__sha256") <= F.col("sha256"))
    return F.col("__id").eqNullSafe(F.col("doc_id")) & same


def _differing(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Members whose bytes differ from those of the row that stays: ``__id, __sha256, bytes``."""
    texts = docs.select(F.col("doc_id").alias("__id"), content(text_or_empty()).alias("bytes"))
    texts = texts.withColumn("__sha256", F.unhex(F.sha2("bytes", 256)))
    copies = members.filter("NOT (doc_id <=> keep_id AND sha256 = keep_sha256)").select("doc_id", "sha256", "content_hash")
    keepers = members.select(F.col("keep_id").alias("doc_id"), F.col("keep_sha256").alias("sha256"), "content_hash")
    of_copies = texts.join(narrow(stored(copies.distinct(), "copies")), _of_row())
    of_keepers = texts.join(narrow(stored(keepers.distinct(), "keepers")), _of_row()).select(
        "content_hash", F.col("bytes").alias("kept_bytes")
    )
    unlike = of_copies.join(of_keepers, "content_hash").filter(F.col("bytes") != F.col("kept_bytes"))
    return unlike.select("__id", "__sha256", "bytes").distinct()


def copies(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    text = text_or_empty()
    prints = stored(
        docs.select("doc_id", text.alias("text"), content(text).alias("bytes")).select(
            "doc_id",
            F.length("text").cast("long").alias("n_points"),
            F.unhex(F.md5("bytes")).alias("content_hash"),
            F.unhex(F.sha2("bytes", 256)).alias("sha256"),
        ),
        "content-hashes",
    )
    groups = stored(_choose(prints, "content_hash").filter("group_size > 1"), "copy-groups")
    members = stored(prints.join(groups, "content_hash"), "copy-members")

    # rows that share a hash without sharing bytes are grouped anew by the bytes themselves
    unlike = stored(_differing(docs, members), "hash-collisions")
    if unlike.isEmpty():
        found = prints.join(groups, "content_hash", "left")
    else:
        bytes_of = prints.join(unlike, _of_row(), "left").withColumn("bytes", F.coalesce("bytes", F.lit(""))).drop("__id", "__sha256")
        found = bytes_of.join(_choose(bytes_of, "content_hash", "bytes"), ["content_hash", "bytes"])
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    dropped = copies(docs).filter("NOT kept").select("doc_id", F.col("text_sha256").alias("digest"))
    return without(docs, dropped, F.sha2(content(text_or_empty()), 256))
