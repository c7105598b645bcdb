"""Repairs of conversations against a search over all edits, and long conversations against short ones."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest

from earshot.llm import conversations, turn_tables
from earshot.llm.registry import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def next_roles(roles):
    """Initials that may come after these."""
    if not roles:
        return "su"
    return "a" if roles[-1] == "u" else "u"


def cheapest(rows):
    """(cost, audit, turns) of rows (role, text, must_go, truncated): all edits, cheapest first, letters as ties."""
    ways = {"": (0, "", ())}  # by the last initial

    def inserted(ways):
        for _ in range(2):
            for last, (cost, audit, turns) in list(ways.items()):
                for initial in set(next_roles(last)) & set("ua"):
                    role = "user" if initial == "u" else "assistant"
                    way = (cost + 5, audit + "I", (*turns, (role, "")))
                    ways[initial] = min(ways.get(initial, way), way)
        return ways

    for role, text, must_go, truncated in rows:
        after = {}
        for last, (cost, audit, turns) in inserted(dict(ways)).items():
            found = [(last, (cost + 2, audit + "D", turns))]
            if not must_go:
                cost += 5 * truncated
                if role[:1] and role[:1] in next_roles(last):
                    found.append((role[:1], (cost, audit + "K", (*turns, (role, text)))))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if initial in next_roles(last):
                        found.append((initial, (cost + 1, audit + "R", (*turns, (name, text)))))
            for initial, way in found:
                after[initial] = min(after.get(initial, way), way)
        ways = after
    ways = inserted(ways)
    return min(ways[last] for last in ("", "a") if last in ways)


def expected(rows):
    """All columns for one conversation of (turn, role, text) in order."""
    faults, seen, judged = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
    for _, role, text in rows:
        ended = text.strip(WHITE)
        fault = "blank" if not ended else "duplicate" if (role, text) in seen else "truncated" if ended[-1] not in ".!?" else None
        if fault:
            faults[fault] += 1
        seen.add((role, text))
        judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {turn for turn, *_ in rows if turn is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, left = cheapest(judged)
    text = "\n".join(f"{role}:{text}" for role, text in left)
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def in_order(rows):
    def place(row):
        turn, role, text = row
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        return (turn is not None, turn or 0, role[:64], text[:64], digest)

    return sorted(rows, key=place)


def all_expected(rows, damage):
    grouped = defaultdict(list)
    for conversation, turn, role, text in rows:
        role, text = (" " if value is None else value for value in (role, text))
        found = grouped[conversation]
        key = f"{' ' if conversation is None else conversation}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damage else 9
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(letter for letter in text if letter not in ".!?")
        found += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {(conversation, *expected(in_order(found))) for conversation, found in grouped.items()}


def rows_of(df):
    rows = [tuple(row) for row in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_block_tables_find_the_cheapest_least_edits():
    rng = random.Random(5)
    kinds = [(initial, cut) for initial in "sua?" for cut in (False, True)]

    def both(turns):
        symbols = bytes(turn_tables.MUST_GO if turn is None else turn_tables.symbol(*turn) for turn in turns)
        rows = [("s" if turn is None else turn[0], "", turn is None, bool(turn and turn[1])) for turn in turns]
        cost, audit, _ = cheapest(rows)
        return symbols, (cost, audit)

    for size in range(4):
        for turns in itertools.product([None, *kinds], repeat=size):
            symbols, answer = both(turns)
            assert turn_tables.solved(symbols) == answer
    for _ in range(1000):
        symbols, answer = both(rng.choices([None, *kinds], k=rng.randint(4, 50)))
        assert turn_tables.solved(symbols) == answer
        cuts = [0, *sorted(rng.sample(range(1, len(symbols)), rng.randint(1, 3))), len(symbols)]
        pieces = [symbols[a:b] for a, b in itertools.pairwise(cuts)]
        cost, states = turn_tables.passed([turn_tables.summary(piece) for piece in pieces])
        audits = [turn_tables.traced(piece, a, turn_tables.LEAVE[b])[0] for piece, (a, b) in zip(pieces, states)]
        assert (cost, "".join(audits) + turn_tables.closing(states[-1][1])) == answer


def test_given_conversations(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    found = rows_of(QUERIES["op11_conversation_repair"](spark, sf_dir))
    assert found == all_expected(rows, damage=True)
    assert len({row[7] for row in found}) > 20


@pytest.fixture(scope="module")
def awkward_rows():
    rng = random.Random(2)
    texts = ["", " \n", "Yes.", "No!", "Why?", "cut off", "said. \t", "ends ", None, "x" * 70 + "a.", "x" * 70 + "b.", "z" * 5000]
    roles = ["system", "user", "assistant", "tool", "", None, "unknown", "User"]
    rows = []
    for conversation in [None, *range(40)]:
        rows += [
            (conversation, rng.choice([None, 0, 1, 2, 3, 5, 9, 9]), rng.choice(roles[:3] + roles), rng.choice(texts))
            for _ in range(rng.choice([1, 2, 5, 9, 30]))
        ]
    rows += [(100, turn, ("user", "assistant")[turn % 2], f"Turn {turn // 3}.") for turn in range(300)]
    rows += [(101, 7, "user", "the same row.")] * 250 + [(101, 8, "assistant", "And this?")]
    rows += [(102, None, None, None)]
    return rows + rows[:10]


@pytest.mark.parametrize("limits", [{}, {"long_rows": 3, "piece_rows": 4}, {"long_bytes": 500, "piece_rows": 7}])
def test_awkward_rows_whole_and_in_pieces(spark, monkeypatch, awkward_rows, limits):
    monkeypatch.setattr(conversations, "RANGE_ROWS", 60)
    df = spark.createDataFrame(awkward_rows, SCHEMA).selectExpr("*", "'x' AS range", "1 AS pieces", "2 AS digest")
    for damage in (False, True):
        rows = conversations.damaged(df) if damage else df
        found = rows_of(conversations.digests(conversations.repaired(rows, **limits), df))
        assert found == all_expected(awkward_rows, damage)


def test_long_conversations_are_split(spark, monkeypatch, awkward_rows):
    monkeypatch.setattr(conversations, "RANGE_ROWS", 60)
    df = spark.createDataFrame(awkward_rows, SCHEMA)
    pieces = conversations.repaired(df, long_rows=100, piece_rows=16).collect()
    split = [row for row in pieces if row.conv_id == 100]
    assert len({row.range for row in split}) > 1 and {row.pieces for row in split} == {len(split)}
    assert len([row for row in pieces if row.conv_id == 5]) == 1


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.digests(conversations.repaired(df), df).collect() == []
    one = spark.createDataFrame([(1, 0, "user", "Hello.")], SCHEMA)
    gone = conversations.digests(conversations.repaired(one.limit(0)), one).collect()
    assert [tuple(row) for row in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
