"""Conversations whose turns are damaged, repaired by the cheapest edits.

The rows of a conversation, by turn, are edited until their roles read: a system turn or none, then
user and assistant in turn, ending with the assistant; or no rows at all. To keep a row costs 0, to
make it a user or assistant turn 1, to delete it 2, to insert an empty user or assistant turn 5. A
blank row, and one whose role and text an earlier row has, must go; a truncated row that stays
costs 5 more. Of the cheapest ways the one whose letters (D, I, K, R) are least is taken. The edits
are found by block tables (``turn_tables``).

A conversation of ordinary length is one group of a shuffle by conversation, sorted by turn. Longer
ones (``LONG_ROWS``, ``LONG_BYTES``) never meet in one task: equal rows are counted, the rest is
split by ranges of (conversation, turn, row) and cut into pieces; each piece is summarised by 32
numbers, one group of summaries per conversation says in which states a piece is entered and left,
and every piece is then traced by itself. Only a digest of a whole long conversation reads it in
order, piece by piece, in one task.

Nulls: a null role or text counts as one space (a blank row); a null ``turn`` comes first; rows
without ``conv_id`` are a conversation of their own. Rows of equal turn go by role and text (their
first 64 code points, then a digest), so repeated rows stand together. An empty role has no initial and
can't be kept. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import narrow, ship, stored
from earshot.llm.turn_tables import (
    ASSISTANT,
    END,
    LEAVE,
    MUST_GO,
    NOTHING,
    SYSTEM,
    Summary,
    closing,
    passed,
    solved,
    summary,
    symbol,
    traced,
)

#: White space, and ends of a sentence.
BLANKS = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"
#: Rows, and bytes of roles and texts, of a conversation that one task may hold.
LONG_ROWS = 4_096
LONG_BYTES = 64 << 20
#: Rows of a piece of a longer one, and about how many a task sorts.
PIECE_ROWS = 4_096
RANGE_ROWS = 65_536

PAIRS = {"su", "ua", "au"}
COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal"]
COUNTED = ", ".join(f"{name} bigint" for name in COUNTS)
TURNS = "turns array<struct<role: string, text: string>>"
TOTALS = "conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def digest() -> Column:
    """Tells rows of a conversation apart by role and text."""
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))


def order(text_digest: Column) -> list[Column]:
    first = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64)]
    return [*first, text_digest]


class Turns:
    """Rows of one conversation or piece: symbols, counts and edges."""

    def __init__(self) -> None:
        self.symbols = bytearray()
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_initial = self.last_initial = ""
        self.first_turn: int | None = None
        self.last_turn: int | None = None
        self.distinct_turns = 0
        self.bytes = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        counts, initial = self.counts, role[:1]
        ended = text.rstrip(BLANKS)
        truncated = bool(ended) and ended[-1] not in SENTENCE_ENDS
        fault = "blank" if not ended else "duplicate" if seen else "truncated" if truncated else None
        if fault:
            counts[fault] += 1
        self.symbols.append(MUST_GO if not ended or seen else symbol(initial, truncated))
        if not counts["rows"]:
            self.first_initial = initial
        elif self.last_initial + initial not in PAIRS:
            counts["illegal"] += 1
        self.last_initial = initial
        counts["rows"] += 1
        if turn is not None and turn != self.last_turn:
            self.distinct_turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(role) + len(text)

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.distinct_turns


def edited(audit: str, state: int, roles: list[str], texts: list[str]) -> list[dict[str, str]]:
    """The turns that an audit from ``state`` leaves."""
    turns, rows = [], zip(roles, texts)
    after = state
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K" and after == NOTHING and role[:1] == "s":
            after = SYSTEM
        else:
            user = after in (NOTHING, SYSTEM, ASSISTANT)
            after = ASSISTANT - 1 if user else ASSISTANT
            if letter != "K":
                role = "user" if user else "assistant"
        turns.append({"role": role, "text": text})
    return turns


def whole(rows: DataFrame) -> DataFrame:
    """Rows with defined values: no null role or text."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name) for name in ("role", "text"))
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role, text)


def repaired(
    rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Pieces of repaired conversations for ``conv_id, turn, role, text``.

    One row per piece: ``conv_id``, the number of its ``pieces`` (one but for long conversations), ``range``
    and ``piece`` by which they are ordered, ``gaps`` to ``cost`` of the whole conversation, ``audit`` and ``turns``
    (role and text, those of the piece).
    """
    ship(rows.sparkSession)
    rows = whole(rows)
    size = F.octet_length("role") + F.octet_length("text")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
    long = stored(sizes.where((F.col("rows") > long_rows) | (F.col("bytes") > long_bytes)), "long-conversations")
    kind = rows.schema["conv_id"].dataType.simpleString()
    n_long = long.agg(F.sum("rows")).first()[0]
    if not n_long:
        return _ordinary(rows, kind)
    names = narrow(long.select("conv_id"))
    same = rows["conv_id"].eqNullSafe(names["conv_id"])
    ordinary = _ordinary(rows.join(names, same, "left_anti"), kind)
    return ordinary.unionByName(_long(rows.join(names, same, "left_semi"), kind, n_long, piece_rows))


def _ordinary(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations that a task can hold, one after the other."""
    schema = f"{TOTALS.format(kind=kind)}, audit string, {TURNS}"
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def answer(conversation: object, turns: Turns) -> dict:
        cost, audit = solved(bytes(turns.symbols))
        left = edited(audit, NOTHING, turns.roles, turns.texts)
        counts = {name: turns.counts[name] for name in COUNTS[1:]}
        return {"conv_id": conversation, "gaps": turns.gaps(), **counts, "cost": cost, "audit": audit, "turns": left}

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turns, seen = None, None, set()
        for batch in batches:
            done = []
            for conversation, turn, role, text in zip(*(column.to_pylist() for column in batch.columns)):
                if turns is None or conversation != current:
                    if turns is not None:
                        done.append(answer(current, turns))
                    current, turns, seen = conversation, Turns(), set()
                turns.add(turn, role, text, (role, text) in seen)
                seen.add((role, text))
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
        if turns is not None:
            yield pa.RecordBatch.from_pylist([answer(current, turns)], arrow)

    sorted_rows = rows.repartition("conv_id").sortWithinPartitions(*order(digest()))
    one = F.lit(1).cast("bigint")
    return sorted_rows.mapInArrow(repair, schema).select(
        "conv_id", one.alias("pieces"), F.lit(0).alias("range"), F.lit(0).alias("piece"),
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns",
    )


def _long(rows: DataFrame, kind: str, n_rows: int, piece_rows: int) -> DataFrame:
    """Conversations in pieces that meet only as summaries."""
    key = ["conv_id", "turn", "role", "text"]
    folded = stored(rows.groupBy(*key).count().withColumn("digest", digest()), "long-conversation-rows")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("later"), "turn")).alias("first")
    firsts = folded.groupBy("conv_id", "digest").agg(first).select(
        F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), F.col("first.turn").alias("_turn")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    seen = ~F.col("turn").eqNullSafe(F.col("_turn"))
    marked = folded.join(firsts, same).select(*key, "digest", "count", seen.alias("seen"))
    ranges = marked.repartitionByRange(max(1, ceil(n_rows / RANGE_ROWS)), *order(F.col("digest")))
    placed = ranges.sortWithinPartitions(*order(F.col("digest"))).withColumn("range", F.spark_partition_id())
    cut = stored(_cut(placed.drop("digest"), kind, piece_rows), "conversation-pieces")
    passes = stored(_passes(cut.drop("symbols", "roles", "texts"), kind), "conversation-passes")
    totals = passes.where("range < 0").drop("range", "piece", "entered", "left", "last")
    steps = passes.where("range >= 0").select("conv_id", "range", "piece", "entered", "left", "last")
    named = steps.select(F.col("conv_id").alias("_conv"), F.col("range").alias("_range"), F.col("piece").alias("_piece"), "entered", "left", "last")
    found = cut.select("conv_id", "range", "piece", "symbols", "roles", "texts").join(
        named,
        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("range") == F.col("_range")) & (F.col("piece") == F.col("_piece")),
    )
    traces = _traced(found.drop("_conv", "_range", "_piece"), kind)
    totals = totals.withColumnRenamed("conv_id", "_conv")
    return traces.join(narrow(totals), F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "pieces", "range", "piece", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"
    )


def _cut(placed: DataFrame, kind: str, piece_rows: int) -> DataFrame:
    """Pieces of sorted ranges of rows, with their summaries."""
    schema = (
        f"conv_id {kind}, range int, piece int, symbols binary, roles array<string>, texts array<string>, {COUNTED}, "
        "first_initial string, last_initial string, first_turn bigint, last_turn bigint, distinct_turns bigint, "
        "costs array<bigint>, places array<int>"
    )
    arrow = placed.sparkSession.createDataFrame([], schema).toArrow().schema

    def piece_row(conversation: object, at: int, number: int, turns: Turns) -> pa.RecordBatch:
        told = summary(bytes(turns.symbols))
        row = {
            "conv_id": conversation, "range": at, "piece": number, "symbols": bytes(turns.symbols),
            "roles": turns.roles, "texts": turns.texts, **turns.counts,
            "first_initial": turns.first_initial, "last_initial": turns.last_initial,
            "first_turn": turns.first_turn, "last_turn": turns.last_turn, "distinct_turns": turns.distinct_turns,
            "costs": sum(told.costs, []), "places": sum(told.places, []),
        }
        return pa.RecordBatch.from_pylist([row], arrow)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turns, number, at = None, None, 0, 0
        for batch in batches:
            for conversation, turn, role, text, count, seen, at in zip(*(column.to_pylist() for column in batch.columns)):
                for copy in range(count):
                    full = turns is not None and (len(turns.symbols) >= piece_rows or turns.bytes > LONG_BYTES)
                    if turns is None or conversation != current or full:
                        if turns is not None:
                            yield piece_row(current, at, number, turns)
                        number = 0 if turns is None or conversation != current else number + 1
                        current, turns = conversation, Turns()
                    turns.add(turn, role, text, seen or copy > 0)
        if turns is not None:
            yield piece_row(current, at, number, turns)

    return placed.mapInArrow(cut, schema)


def _passes(pieces: DataFrame, kind: str) -> DataFrame:
    """States in which pieces are entered and left, and a row of totals (``range`` -1) for each conversation."""
    schema = f"{TOTALS.format(kind=kind)}, pieces bigint, range int, piece int, entered int, left int, last boolean"

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["range", "piece"])
        told = [
            Summary([list(costs[at : at + 4]) for at in range(0, 16, 4)], [list(places[at : at + 4]) for at in range(0, 16, 4)])
            for costs, places in zip(group["costs"], group["places"])
        ]
        cost, states = passed(told)
        initials = list(zip(group["last_initial"][:-1], group["first_initial"][1:]))
        illegal = int(group["illegal"].sum()) + sum(last + first not in PAIRS for last, first in initials)
        turned = group.dropna(subset=["first_turn"])
        shared = int((turned["last_turn"].to_numpy()[:-1] == turned["first_turn"].to_numpy()[1:]).sum())
        spread = int(turned["last_turn"].iloc[-1] - turned["first_turn"].iloc[0]) + 1 if len(turned) else 0
        sums = {name: int(group[name].sum()) for name in ("blank", "duplicate", "truncated")}
        gaps = spread - int(turned["distinct_turns"].sum()) + shared if len(turned) else 0
        conversation = group["conv_id"].iloc[0]
        total = {"conv_id": conversation, "gaps": gaps, **sums, "illegal": illegal, "cost": cost, "pieces": len(group)}
        steps = [
            {**total, "range": at, "piece": piece, "entered": entered, "left": left, "last": False}
            for at, piece, (entered, left) in zip(group["range"], group["piece"], states)
        ]
        steps[-1]["last"] = True
        return pd.DataFrame([{**total, "range": -1, "piece": 0, "entered": 0, "left": 0, "last": False}, *steps])

    return pieces.groupBy("conv_id").applyInPandas(chain, schema)


def _traced(found: DataFrame, kind: str) -> DataFrame:
    schema = f"conv_id {kind}, range int, piece int, audit string, {TURNS}"
    arrow = found.sparkSession.createDataFrame([], schema).toArrow().schema

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                end = END if row["last"] else LEAVE[row["left"]]
                audit, state = traced(row["symbols"], row["entered"], end)
                audit += closing(state) if row["last"] else ""
                turns = edited(audit, row["entered"], row["roles"], row["texts"])
                answer = {"conv_id": row["conv_id"], "range": row["range"], "piece": row["piece"], "audit": audit, "turns": turns}
                yield pa.RecordBatch.from_pylist([answer], arrow)

    return found.mapInArrow(trace, schema)


def digests(pieces: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``: totals, audit and a digest of the repaired turns.

    The digest is the SHA-256 of the lines ``role:text``. A conversation without any rows has zeros,
    no audit and the digest of the empty text.
    """
    lines = F.transform("turns", lambda turn: F.concat(turn["role"], F.lit(":"), turn["text"]))
    text = F.array_join(lines, "\n")
    totals = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    single = pieces.where("pieces = 1").select(*totals, "audit", F.sha2(text, 256).alias("repaired_sha256"))
    several = _joined(pieces.where("pieces > 1").select(*totals, "range", "piece", "audit", F.size("turns").alias("n"), text.alias("text")))
    found = single.unionByName(several)
    named = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    empty = F.lit(hashlib.sha256().hexdigest())
    return named.join(found, F.col("_conv").eqNullSafe(found["conv_id"]), "left").select(
        F.col("_conv").alias("conv_id"),
        *(F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in totals[1:]),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )


def _joined(pieces: DataFrame) -> DataFrame:
    """Audits and digests of conversations in pieces, which pass one after the other."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"{TOTALS.format(kind=kind)}, audit string, repaired_sha256 string"
    arrow = pieces.sparkSession.createDataFrame([], schema).toArrow().schema

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, audits, sha, any_text = None, [], None, False

        def closed() -> pa.RecordBatch:
            row = dict(zip(arrow.names, [*totals, "".join(audits), sha.hexdigest()]))
            return pa.RecordBatch.from_pylist([row], arrow)

        for *found, _, _, audit, n, text in read(batches):
            if totals != found:
                if totals is not None:
                    yield closed()
                totals, audits, sha, any_text = found, [], hashlib.sha256(), False
            audits.append(audit)
            if n:
                sha.update(("\n" * any_text + text).encode())
                any_text = True
        if totals is not None:
            yield closed()

    by_place = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "range", "piece")
    return by_place.mapInArrow(join, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20 (a null in it is one space).

    0 drops the row, 1 empties its text, 2 takes the ends of its sentences away, 3 repeats it, 4 makes it a
    user turn.
    """
    rows = whole(conversations)
    part = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", SENTENCE_ENDS, "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    kept = rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))
    return kept.drop("copy")
