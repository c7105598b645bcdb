"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Documents become ids plus an end id; those over the capacity are cut into full pieces, the first
one taking the remainder. Pieces are packed best-fit decreasing: longest first, each into the
fullest open sequence that still takes it, found in logarithmic time by a segment tree over
remaining capacities.

There are at most ``capacity`` different lengths, and pieces of one length can be exchanged. So
the tree runs over counts by length, which are gathered from all pieces, and places whole runs of
equal pieces: its time and its plan depend on the capacity, not on the number of documents. The
sequences are exactly those of placing piece by piece. Pieces then find their place in the plan by
their rank among pieces of their length. Ranks come from row numbers within (length, bucket of
hashed ids) and offsets per bucket, so that a length that very many pieces share is spread over
all buckets.

A null text counts as empty: its one piece is the end id. Rows that repeat a ``doc_id`` are packed
each. An empty table gives no rows. Extra columns of documents are ignored, those of pieces kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import ship, stored, text_or_empty
from earshot.llm.tokens import byte_encoder, pack_ids

CAPACITY = 1024
END_ID = 2
#: Buckets that share the pieces of one length; a bucket of a length is sorted in one task.
RANK_BUCKETS = 4096


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, **tokenizer: str) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (packed little-endian) of every document."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_encoder(**tokenizer), pack_ids([end_id])
        for batch in batches:
            row, number, start, length, ids = [], [], [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                whole = encoder.encode(text) + end
                n = len(whole) // 4
                bounds = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    row.append(at)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(whole[4 * a : 4 * b])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary"
    )


class OpenSequences:
    """Runs of open sequences by what remains in them, under a segment tree of the capacities in use."""

    def __init__(self, capacity: int):
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.leaves = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.leaves)

    def _mark(self, remaining: int) -> None:
        node = self.leaves + remaining
        self.used[node] = bool(self.runs[remaining])
        while node > 1:
            node //= 2
            self.used[node] = self.used[2 * node] or self.used[2 * node + 1]

    def add(self, remaining: int, first: int, count: int) -> None:
        if remaining and count:
            self.runs[remaining].append((first, count))
            self._mark(remaining)

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity in use that is at least ``least``."""
        node = self.leaves + least
        if self.used[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.used[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.used[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None

    def take(self, remaining: int, most: int) -> tuple[int, int]:
        """Up to ``most`` sequences of one run: (first, count)."""
        first, count = self.runs[remaining].pop()
        if count > most:
            self.runs[remaining].append((first + most, count - most))
            count = most
        self._mark(remaining)
        return first, count


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, rank from, first sequence, per sequence, offset).

    ``per sequence`` pieces of consecutive rank go to a sequence before the next one.
    """
    opened, steps, sequences = OpenSequences(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank = 0
        while rank < counts[length]:
            remaining = opened.tightest(length)
            room = capacity if remaining is None else remaining
            each, left = room // length, counts[length] - rank
            wanted = left // each or 1
            if remaining is None:
                first, taken = sequences, wanted
                sequences += wanted
            else:
                first, taken = opened.take(remaining, wanted)
            placed = min(left, each * taken)
            steps.append((length, rank, first, each, capacity - room))
            opened.add(room - (each if placed == each * taken else placed) * length, first, taken)
            rank += placed
    return steps


def _ranked(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces with ``__rank`` among those of their length, from 0; and the number by length."""
    within = Window.partitionBy("length", "__bucket").orderBy("__hash", "doc_id", "piece")
    numbered = stored(
        pieces.withColumn("__hash", F.xxhash64("doc_id", "piece"))
        .withColumn("__bucket", F.pmod("__hash", F.lit(RANK_BUCKETS)).cast("int"))
        .withColumn("__nth", F.row_number().over(within) - 1)
        .drop("__hash"),
        "numbered-pieces",
    )
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        numbered.groupBy("length", "__bucket")
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))),
        "rank-offsets",
    )
    return numbered.join(offsets.drop("__n"), ["length", "__bucket"]).select(
        *pieces.columns, (F.col("__before") + F.col("__nth")).alias("__rank")
    ), offsets.groupBy("length").agg(F.sum("__n").alias("n"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``doc_id, piece, length`` and more) with ``sequence_id`` and ``offset``."""
    ship(pieces.sparkSession)
    ranked, counted = _ranked(pieces)
    steps = sorted(plan({row.length: row.n for row in counted.collect()}, capacity))  # at most one row per length
    keys = [step[:2] for step in steps]
    first, each, offset = (np.array([step[i] for step in steps], dtype=np.int64) for i in (2, 3, 4))
    begins = np.array([rank for _, rank in keys], dtype=np.int64)
    # the steps of a length are consecutive; a search key orders them by length and rank
    span = 1 << 44
    search = np.array([length * span + rank for length, rank in keys], dtype=np.int64)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame.pop("__rank").to_numpy()
            at = np.searchsorted(search, length * span + rank, side="right") - 1
            nth = rank - begins[at] if len(frame) else rank
            frame["sequence_id"] = first[at] + nth // each[at]
            frame["offset"] = offset[at] + nth % each[at] * length
            yield frame

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInPandas(place, f"{kinds}, sequence_id bigint, offset bigint")
