"""Cheapest edits of a row of conversation turns, by tables over blocks of turns (Four Russians).

A turn is a symbol: its role's initial and its fault. Roles of the result form ``(s?(ua)+)?``, an
automaton of four states: nothing yet, after the system turn, after a user turn, after an assistant
turn. The cost to go from each state, less the least of the four, takes only a few values; these
normalised vectors and their transitions over every block of ``BLOCK`` symbols are computed once.
A conversation is then worked from its last block to its first by look-up. Tracing goes forward
through the blocks and expands each one backward from the vector at its end, so that at every
turn all cheapest ways are known and the letter least in ASCII can be taken. Letters leave no
choice of state, so the first smaller letter decides.

A conversation in pieces: a piece is summarised by its cost from each state to each state, and by
the order of the audits that leave from one state. An audit of a piece ends with the letter of its
last turn (turns inserted later count for the next piece), so none begins another, and summaries
suffice to find the states at which the least audit of all passes from piece to piece.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np

NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: More than any cost of a block; a state that cannot be reached.
NEVER = 1 << 40

#: A blank or repeated turn, whole turns and truncated ones by initial (system, user, assistant, other), no turn.
MUST_GO = 0
INITIALS = "sua"
WHOLE, CUT_OFF = 1, 5
NO_TURN = 9
SYMBOLS = 10
BLOCK = 4
TRACES_KEPT = 50_000

#: The state after a user or assistant turn that may follow each state.
AFTER_ANY = (USER, USER, ASSISTANT, USER)
AFTER_KEPT = (
    {"s": SYSTEM, "u": USER},
    {"u": USER},
    {"a": ASSISTANT},
    {"u": USER},
)

Vector = tuple[int, int, int, int]


def symbol(initial: str, truncated: bool) -> int:
    """The symbol of a turn that may stay."""
    at = INITIALS.find(initial) if initial else -1
    return (CUT_OFF if truncated else WHOLE) + (at if at >= 0 else len(INITIALS))


def moves(turn: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of a turn in a state, by letter."""
    found = [("D", DELETE, state)]
    if turn != MUST_GO:
        extra = TRUNCATED if turn >= CUT_OFF else 0
        initial = (INITIALS + "?")[(turn - 1) % 4]
        if initial in AFTER_KEPT[state]:
            found.append(("K", KEEP + extra, AFTER_KEPT[state][initial]))
        found.append(("R", REROLE + extra, AFTER_ANY[state]))
    return found


def with_inserts(costs: list[int]) -> Vector:
    """Costs to go if turns may be inserted first; two at most pay."""
    for _ in range(2):
        costs = [min(cost, INSERT + costs[AFTER_ANY[state]]) for state, cost in enumerate(costs)]
    return tuple(min(cost, NEVER) for cost in costs)


#: Costs at the end of a conversation, and at the end of a piece that has to leave in one state.
END = with_inserts([0, NEVER, NEVER, 0])
LEAVE = [tuple(0 if state == at else NEVER for state in STATES) for at in STATES]


def before(turn: int, after: Vector) -> Vector:
    if turn == NO_TURN:
        return after
    return with_inserts([min(cost + after[to] for _, cost, to in moves(turn, state)) for state in STATES])


def normalised(costs: Vector) -> tuple[Vector, int]:
    least = min(costs)
    return tuple(cost - least if cost < NEVER else NEVER for cost in costs), least


class Tables(NamedTuple):
    """Normalised vectors, and for each (vector, symbols) the vector before them and what is added."""

    vectors: list[Vector]
    numbers: dict[Vector, int]
    before_one: np.ndarray
    added_by_one: np.ndarray
    before_block: np.ndarray
    added_by_block: np.ndarray


@functools.cache
def tables() -> Tables:
    vectors = [END, *LEAVE]
    numbers = {vector: at for at, vector in enumerate(vectors)}
    ones: list[list[tuple[int, int]]] = []
    for vector in vectors:  # grows while new ones are found
        row = []
        for turn in range(SYMBOLS):
            found, added = normalised(before(turn, vector))
            if found not in numbers:
                numbers[found] = len(vectors)
                vectors.append(found)
            row.append((numbers[found], added))
        ones.append(row)
    one, added_by_one = (np.array([[cell[part] for cell in row] for row in ones]) for part in (0, 1))
    block, added = one, added_by_one
    for _ in range(BLOCK - 1):  # a symbol in front of the block
        n = block.shape[1]
        fronts = [(one[block, turn], added + added_by_one[block, turn]) for turn in range(SYMBOLS)]
        block = np.stack([front[0] for front in fronts], axis=1).reshape(len(vectors), SYMBOLS * n)
        added = np.stack([front[1] for front in fronts], axis=1).reshape(len(vectors), SYMBOLS * n)
    return Tables(vectors, numbers, one, added_by_one, block, added)


def blocks(turns: bytes) -> list[int]:
    """Numbers of the blocks of symbols; the last is filled up."""
    filled = np.frombuffer(turns + bytes([NO_TURN]) * (-len(turns) % BLOCK), dtype=np.uint8)
    return (filled.reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK)[::-1])).tolist()


def block_ends(numbers: list[int], end: Vector) -> tuple[list[int], Vector]:
    """The vector at the end of each block, and the costs to go at the beginning."""
    known = tables()
    vector, total = known.numbers[end], 0
    ends = [vector] * len(numbers)
    for at in range(len(numbers) - 1, -1, -1):
        ends[at] = vector
        total += int(known.added_by_block[vector, numbers[at]])
        vector = int(known.before_block[vector, numbers[at]])
    return ends, tuple(min(cost + total, NEVER) for cost in known.vectors[vector])


@functools.lru_cache(TRACES_KEPT)
def expanded(block: int, end: int, state: int) -> tuple[str, int]:
    """The least of the cheapest audits of a block from a state, and the state at its end."""
    turns = [block // SYMBOLS**power % SYMBOLS for power in reversed(range(BLOCK))]
    costs = [tables().vectors[end]]
    for turn in reversed(turns):
        costs.append(before(turn, costs[-1]))
    costs.reverse()
    letters = []
    for at, turn in enumerate(turns):
        while turn != NO_TURN:
            ways = [(letter, cost, to, 1) for letter, cost, to in moves(turn, state)]
            ways.append(("I", INSERT, AFTER_ANY[state], 0))
            letter, _, to, step = min(way for way in ways if way[1] + costs[at + way[3]][way[2]] == costs[at][state])
            letters.append(letter)
            state = to
            if step:
                break
    return "".join(letters), state


def traced(turns: bytes, state: int, end: Vector) -> tuple[str, int]:
    """The least of the cheapest audits from ``state`` to costs ``end``, and the state at the end."""
    numbers = blocks(turns)
    letters = []
    for number, vector in zip(numbers, block_ends(numbers, end)[0]):
        found, state = expanded(number, vector, state)
        letters.append(found)
    return "".join(letters), state


def closing(state: int) -> str:
    """Turns to insert at the end of a conversation."""
    return "I" * {SYSTEM: 2, USER: 1}.get(state, 0)


def solved(turns: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    cost = block_ends(blocks(turns), END)[1][NOTHING]
    letters, state = traced(turns, NOTHING, END)
    return cost, letters + closing(state)


class Summary(NamedTuple):
    """Of a piece: cost from state to state, and the place of its audit among those from the same state."""

    costs: list[list[int]]
    places: list[list[int]]


def summary(turns: bytes) -> Summary:
    numbers = blocks(turns)
    to_go = [block_ends(numbers, end)[1] for end in LEAVE]
    costs = [[min(to_go[to][state], NEVER) for to in STATES] for state in STATES]
    places = []
    for state in STATES:
        audits = {to: traced(turns, state, LEAVE[to])[0] for to in STATES if costs[state][to] < NEVER}
        order = sorted(audits, key=audits.__getitem__)
        places.append([order.index(to) if to in audits else len(order) for to in STATES])
    return Summary(costs, places)


def passed(pieces: list[Summary]) -> tuple[int, list[tuple[int, int]]]:
    """Cost of a conversation in pieces, and the states in which each piece is entered and left."""
    to_go = [END]
    for piece in reversed(pieces):
        to_go.append(tuple(min(NEVER, min(piece.costs[state][to] + to_go[-1][to] for to in STATES)) for state in STATES))
    to_go.reverse()
    state, states = NOTHING, []
    for at, piece in enumerate(pieces):
        cheapest = [to for to in STATES if piece.costs[state][to] + to_go[at + 1][to] == to_go[at][state]]
        to = min(cheapest, key=piece.places[state].__getitem__)
        states.append((state, to))
        state = to
    return to_go[0][NOTHING], states
