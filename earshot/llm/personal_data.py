"""Personal data: base rules, and candidates chosen by gradient-boosted trees.

Base rules find e-mail addresses, IP addresses, card numbers and phone numbers; what they find
stays. Generators with high recall propose further spans, which may overlap: ``number`` for digit
groups beside base spans, whole runs and parts of them between wide separators, and ``secret`` for
keys and assigned values. Of numbers selected on the same digits the one of highest score is added.
Boosted trees judge each candidate by its
format (lengths, digits, separators, letters, entropy) and context (neighbouring characters, words
before it, the line around it); a threshold per kind, calibrated on candidates that the trees have not
seen, selects those that are added. Secrets that their keyword or issuer's prefix confirms are
added whatever the trees say.

The trees are trained here, on every labelled candidate of the table, and on ``GENERATED`` sentences of either
class that are made by rule, so that there is a model for a table of any size. Features are read in the steps of a
fixed grid (``GRID``), and candidates alike in all steps are one counted cell, so that trees cost by the cells.
A level of a tree needs the sums of slopes by node, feature and step: tasks sum their cells, Spark adds
the tasks up, and the driver chooses the cuts. Sums are of whole numbers, so a model does not depend on
how the table is split or on retries. In training the more frequent class of a kind weighs as much as the other.
A hash deals the candidates into two halves. Each half trains trees, and the other calibrates their threshold with the
weight its candidates have in the table, so a rare class isn't taken for a common one. The model is the mean of both, in scores
and thresholds, so every candidate has its part in either. The labels come from what the features do not show: a number
is personal when a base rule confirms it by its checks (phone numbers are shown as they would stand
without ``+``, and without the country's part), a secret when a keyword assigns it or its
issuer's prefix names it. What is written like a phone number without ``+`` is no example of
either class, unless the line before speaks of pages, versions and the like.

Places are code points, end exclusive. A null text counts as empty and has no spans. Rows that
repeat a ``doc_id`` are answered each. An empty table gives no rows. Other columns are ignored by
``found``, kept by ``redacted``.

Texts pass through Python once to be searched; only documents with a digit or an at-sign are looked
at further. Candidates with their features are stored, so training and choosing do not read texts
again. The driver holds the trees, the sums of one level, at most ``CELLS_AT_HAND`` cells (where there are no more,
it sums them itself, without a job for each level), and counts by score.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from earshot.llm.common import ship, stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
ADDED = ("number", "secret")
ORDER = {kind: at for at, kind in enumerate((*KINDS, *ADDED))}
#: Sentences made by rule for each kind and class, beside those of the table.
GENERATED = 150
PRECISION = 0.95
ROUNDS, DEPTH, RATE, CUTS = 40, 3, 0.2, 16
#: Ends of the steps in which each feature is read, as ``features`` lists them; the last step has no end.
NUMBERS = np.unique(np.concatenate([np.arange(25), np.geomspace(26, 2**20, 38).round()]))
SHARES, ENTROPIES, YES = np.arange(32) / 32, np.arange(50) / 8, np.zeros(1)
GRID = [NUMBERS] * 2 + [SHARES] * 2 + [ENTROPIES] + [NUMBERS] * 8 + [YES] * 6 + [NUMBERS]
STEPS = 64
#: Least curvature on either side of a cut, that of 16 candidates at even odds: a label false only says
#: unconfirmed, so no tree may learn a few of them by heart.
LEAST = 4.0
#: Slopes are summed as whole multiples of one part in so many, scores counted by steps of one part in so many.
UNIT, SCORE_UNIT = 1 << 24, 1 << 10
#: Cells that the driver may sum itself, and those that are summed at a time.
CELLS_AT_HAND, CELLS_AT_ONCE = 20_000, 1 << 16

TELLING = re.compile("[0-9@]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/=-]{8,}")
ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\x20]?[=:][\x20]?[\"']?$")
ISSUED = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|glpat-|sk_live_|xox[bp]-)")
VALUE = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\x20]?[=:][\x20]?[\"']?(?=[^\s\"'0-9]*[0-9])([^\s\"']{8,})")
#: Separators at which a run of digits may be several numbers, and the most parts of one number.
WIDE = re.compile(r"[\x20().-]*\x20[\x20().-]*|[().-]{2,}")
PARTS = 5
UNCONFIRMED = re.compile(r"\(?[0-9]{2,4}\)?[\x20.-]{0,2}[0-9]{2,4}[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4})?")
CUES = re.compile(r"(?i)phone|tel|call|fax|mobile|card|visa|account|iban|contact|address|mail|server|host")
RULES = re.compile(r"(?i)version|license|section|chapter|page|year|no\.|isbn|article|figure|table")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    at, begin = text.find("@"), 0
    while at >= 0:
        start = at
        while start > begin and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        begin = domain.end() if domain else at + 1
        if domain:
            yield "email", start, begin
        at = text.find("@", begin)


def _addresses(text: str) -> Iterator[Span]:
    for chain in DOTTED.finditer(text):
        parts, place = chain[0].split("."), chain.start()
        for at in range(0, len(parts) - 3, 4):
            four = parts[at : at + 4]
            size = sum(map(len, four)) + 3
            if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in four):
                yield "ip", place, place + size
            place += size + 1


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """What the base rules find, by start and then kind."""
    spans = []
    if "@" in text:
        spans += _emails(text)
    spans += _addresses(text)
    spans += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(spans, key=lambda span: (span[1], ORDER[span[0]]))


def features(text: str, start: int, end: int, begin: int | None = None) -> list[float]:
    """Format of a span, and its context; what is between ``begin`` and ``start`` is not shown."""
    begin = start if begin is None else begin
    span, before, after = text[start:end], text[max(0, begin - 40) : begin], text[end : end + 1]
    size = len(span)
    digits = sum("0" <= c <= "9" for c in span)
    upper = sum(c.isupper() for c in span)
    groups = [len(group) for group in re.findall("[0-9]+", span)]
    marks = Counter(c for c in span if not c.isalnum())
    entropy = -sum(n / size * math.log2(n / size) for n in Counter(span).values())
    line = before.rpartition("\n")[2]
    previous = before[-1:]
    return [
        size, digits, digits / size, upper / size, entropy,
        len(groups), max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0,
        marks["."], marks["-"], marks[" "], marks["("] + marks[")"],
        float(previous.isspace() or not previous), float(previous.isalnum()), float(after.isspace() or not after),
        float(after.isalnum()), float(bool(CUES.search(line))), float(bool(RULES.search(line))), len(line),
    ]


def _refuted(text: str, start: int) -> bool:
    """Whether the line before names pages, versions and the like, where checks are passed by chance."""
    line = text[max(0, start - 40) : start].rpartition("\n")[2]
    return bool(RULES.search(line)) and not CUES.search(line)


def candidates(text: str, base: list[Span]) -> list[tuple[str, int, int, list[float], bool | None, bool]]:
    """(kind, start, end, features, label or None if it is no example, whether a base span covers part of it)."""
    covered = sorted((start, end) for _, start, end in base)
    begins, reach = [a for a, _ in covered], list(itertools.accumulate((b for _, b in covered), max))

    def near(start: int, end: int) -> list[tuple[int, int]]:
        """The base spans that may overlap, in order."""
        return covered[bisect.bisect_right(reach, start) : bisect.bisect_left(begins, end)]

    found = []
    for kind, start, end in base:
        if kind in ("card", "phone"):
            label = None if kind == "card" and _refuted(text, start) else True
            for own in _without_plus(text, start, end) if kind == "phone" else [start]:
                found.append(("number", own, end, features(text, own, end, start), label, True))
    for match in NUMBER.finditer(text):
        for start, end in _alternatives(text, *match.span(), near(*match.span())):
            like = UNCONFIRMED.fullmatch(text, start, end) and not _refuted(text, start)
            found.append(("number", start, end, features(text, start, end), None if like else False, False))
    values = {}  # whole values after a keyword, by start
    for match in VALUE.finditer(text):
        values[match.start(1)] = match.end(1)
    for match in TOKEN.finditer(text):
        start, end = match.span()
        name, mark, value = match[0].rpartition("=")
        named = bool(mark and value and ASSIGNED.search(name + mark))
        start += len(name) + 1 if named else 0
        if end - start < 8:
            continue
        if named or ASSIGNED.search(text[max(0, start - 20) : start]):
            values.setdefault(start, end)
            continue
        issued = next((m.start() for m in ISSUED.finditer(text, start, end) if m.start() == start or text[m.start() - 1] in "=/+"), None)
        if issued is not None and end - issued >= 8:
            values.setdefault(issued, end)
        elif not any(a < end and start < b for a, b in near(start, end)):
            found.append(("secret", start, end, features(text, start, end), False, False))
    for start, end in values.items():
        inside = any(a <= start and end <= b for a, b in near(start, end))
        found.append(("secret", start, end, features(text, start, end), True, inside))
    return found


def _without_plus(text: str, start: int, end: int) -> list[int]:
    """Where a phone number starts without its ``+``, and without the country's part if the rest is long enough."""
    country = re.compile(r"[0-9]{1,3}[\x20.-]*(?=[(0-9])").match(text, start + 1, end)
    own = [start + 1]
    if country and country.end() < end and not text[country.end() - 1].isdigit() and NUMBER.match(text, country.end(), end):
        own.append(country.end())
    return own


def _alternatives(text: str, start: int, end: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of a run of digits may be a number: it without base spans, and up to ``PARTS`` parts of it in a row."""
    free, at = [], start
    for a, b in covered:
        if a < end and at < b:
            free.append((at, a))
            at = b
    spans = {}
    for a, b in [*free, (at, end)]:
        for run in NUMBER.finditer(text, a, b) if b - a >= 7 else ():
            spans[run.span()] = True
            edges = [m.span() for m in WIDE.finditer(text, *run.span())]
            starts = [run.start(), *(m_end - (text[m_end - 1] == "(") for _, m_end in edges)]
            ends = [*(m_start for m_start, _ in edges), run.end()]
            for first, begin in enumerate(starts):
                for stop in ends[first : first + PARTS]:
                    if stop - begin >= 7 and NUMBER.fullmatch(text, begin, stop):
                        spans[begin, stop] = True
    return list(spans)


SEARCHED = (
    "base array<struct<kind: string, start: int, end: int>>, "
    "more array<struct<kind: string, start: int, end: int, features: array<double>, label: boolean, taken: boolean>>"
)


def searched(docs: DataFrame) -> DataFrame:
    """``doc_id``, spans of the base rules and candidates of every document."""
    ship(docs.sparkSession)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            base = [base_spans(text) if TELLING.search(text) else [] for text in frame["text"]]
            more = [candidates(text, spans) if TELLING.search(text) else [] for text, spans in zip(frame["text"], base)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "base": base, "more": more})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(search, f"doc_id {kind}, {SEARCHED}")


class Trees(NamedTuple):
    """Trees of equal depth: feature and cut of inner nodes, level by level, and values of the leaves, one row a tree."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def and_then(self, more: Trees) -> Trees:
        return Trees(*map(np.concatenate, zip(self, more)))


def _stumps(n: int) -> Trees:
    """Trees that do not cut yet: all rows go to the first leaf."""
    inner = 2**DEPTH - 1
    return Trees(np.zeros((n, inner), np.int64), np.full((n, inner), np.inf), np.zeros((n, 2**DEPTH)))


def _nodes(trees: Trees, x: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row in each tree at a depth, from the left."""
    tree, row = np.arange(len(trees.cut)), np.arange(len(x))[:, None]
    node = np.zeros((len(x), len(tree)), np.int64)
    for level in range(depth):
        inner = 2**level - 1 + node
        node = 2 * node + (x[row, trees.feature[tree, inner]] > trees.cut[tree, inner])
    return node


def score(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Log-odds."""
    total, tree = np.zeros(len(x)), np.arange(len(trees.cut))
    for at in range(0, len(x), 4096):
        part = slice(at, at + 4096)
        total[part] = RATE * trees.value[tree, _nodes(trees, x[part], DEPTH)].sum(axis=1)
    return total


def steps(x: np.ndarray, grid: list[np.ndarray]) -> np.ndarray:
    """The step of every feature: the first whose end is not below it."""
    return np.stack([np.searchsorted(ends, x[:, at], "left") for at, ends in enumerate(grid)], axis=1).astype(np.uint8)


def level_sums(trees: Trees, tree: Trees, depth: int, x: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of slope and curvature of the logistic loss by node, label, feature and step, in parts of ``UNIT``."""
    p = 1 / (1 + np.exp(-score(trees, x)))
    node, width = _nodes(tree, x, depth)[:, 0], x.shape[1]
    key = ((node * 2 + label)[:, None] * width + np.arange(width)) * STEPS + x
    out = np.zeros((2, 2**depth * 2 * width * STEPS), np.int64)
    for own, values in zip(out, (label - p, p * (1 - p))):
        np.add.at(own, key.ravel(), np.repeat(np.rint(values * UNIT).astype(np.int64) * n, width))
    return out


def _cut(tree: Trees, depth: int, sums: np.ndarray) -> None:
    """Give the nodes at ``depth`` their best cuts; ``sums`` are slope and curvature by node, feature and step."""
    low = sums.cumsum(axis=3)
    total = low[..., -1:]
    high = total - low
    gain = low[0] ** 2 / (low[1] + 1) + high[0] ** 2 / (high[1] + 1)
    gain[np.minimum(low[1], high[1]) < LEAST] = 0
    for node in range(2**depth):
        feature, step = divmod(int(gain[node].argmax()), STEPS)
        if gain[node, feature, step] <= total[0, node, 0, 0] ** 2 / (total[1, node, 0, 0] + 1) + 1e-6:
            feature, step = 0, STEPS - 1  # not cut: all rows are below or at the last step
        else:
            tree.feature[0, 2**depth - 1 + node], tree.cut[0, 2**depth - 1 + node] = feature, step
        if depth == DEPTH - 1:
            for leaf, (slope, curve) in enumerate((low[:, node, feature, step], high[:, node, feature, step])):
                tree.value[0, 2 * node + leaf] = slope / (curve + 1)


#: Kind, trees so far, the tree that grows and its depth, to the result of ``level_sums`` over all rows of the kind.
Ask = Callable[[dict[str, Trees], dict[str, Trees], int], dict[str, np.ndarray]]


def boosted(ask: Ask, counts: dict[str, tuple[int, int]], grid: list[np.ndarray]) -> dict[str, Trees]:
    """Trees for the logistic loss for each kind; ``counts`` of rows of either label, which weigh the same in all."""
    trees = {kind: _stumps(0) for kind in counts}
    for _ in range(ROUNDS):
        growing = {kind: _stumps(1) for kind in counts}
        for depth in range(DEPTH):
            for kind, sums in ask(trees, growing, depth).items():
                least = min((n for n in counts[kind] if n), default=1)
                weights = np.array([least / max(n, 1) for n in counts[kind]])
                by_label = sums.reshape(2, 2**depth, 2, len(grid), STEPS) / UNIT
                _cut(growing[kind], depth, (by_label * weights[:, None, None]).sum(axis=2))
        trees = {kind: trees[kind].and_then(growing[kind]) for kind in counts}
    return trees


def with_cuts(trees: Trees, grid: list[np.ndarray]) -> Trees:
    """Trees on steps as trees on features."""
    ends = np.array([np.append(own, np.full(STEPS - len(own), np.inf)) for own in grid])
    step = np.where(np.isfinite(trees.cut), trees.cut, STEPS - 1).astype(np.int64)
    return trees._replace(cut=ends[trees.feature, step])


def boost(x: np.ndarray, y: np.ndarray, grid: list[np.ndarray] | None = None) -> Trees:
    """Trees for rows at hand; without a grid their own quantiles are the cuts."""
    grid = grid or [np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 2)[1:-1])) for column in x.T]
    rows = steps(x, grid), y.astype(np.int64), np.ones(len(y), np.int64)
    one = boosted(lambda trees, growing, depth: {"": level_sums(trees[""], growing[""], depth, *rows)}, {"": (int((y == 0).sum()), int((y == 1).sum()))}, grid)
    return with_cuts(one[""], grid)


def threshold(scores: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The least score from which isotonic calibration gives ``PRECISION``."""
    weights = np.ones(len(y)) if weights is None else weights
    blocks: list[list[float]] = []  # sum of labels, number, least score; means ascend
    different, at = np.unique(scores, return_inverse=True)
    for labels, n, score_ in zip(np.bincount(at, weights * y), np.bincount(at, weights), different):
        blocks.append([float(labels), float(n), float(score_)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            labels, n, _ = blocks.pop()
            blocks[-1][0] += labels
            blocks[-1][1] += n
    return next((least for labels, n, least in blocks if labels >= PRECISION * n), math.inf)


def _sentence(rng: random.Random, personal: bool) -> tuple[str, int, int]:
    """A sentence with a number written as a country writes its phone numbers, or as anything else; and its place."""

    def digits(n: int) -> str:
        return "".join(rng.choices("0123456789", k=n))

    if personal:
        before = rng.choice(["call ", "phone ", "tel. ", "mobile: ", "my fax is ", "contact us at ", "reach me on ", "ask at ", ""])
        number = rng.choice([
            f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}",
            f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)} {digits(3)} {digits(3)}", f"({digits(2)}) {digits(4)}-{digits(4)}",
        ])
    else:
        before = rng.choice(["version ", "page ", "in the year ", "isbn ", "section ", "article ", "row ", "id ", "about ", "code-", "x"])
        number = rng.choice([
            f"19{digits(2)} 19{digits(2)} 20{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}.{digits(4)}", f"20{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}",
            f"{digits(3)}-{digits(4)}", digits(rng.randint(7, 20)), f"{digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"978{digits(10)}",
            f"{digits(1)}.{digits(7)}", f"100-{digits(3)} 110-{digits(3)}", f"{digits(4)}.{digits(4)}.{digits(6)}",
        ])
    after = rng.choice([" now", " today.", ".", "", ", please", " and so on"])
    words = " ".join(rng.choices(["as", "said", "there", "the", "list", "shows", "it", "we", "had"], k=rng.randint(0, 5)))
    lead = words + " " if words else ""
    return lead + before + number + after, len(lead) + len(before), len(lead) + len(before) + len(number)


def generated(kind: str) -> tuple[list[list[float]], list[bool]]:
    """Features and labels of candidates in sentences made by rule, the same ones every time."""
    rng = random.Random(kind)
    x, y = [], []
    for at in range(2 * GENERATED):
        personal = at % 2 == 0
        if kind == "number":
            text, start, end = _sentence(rng, personal)
        else:
            letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
            word = rng.choice(["chapter", "section", "covid", "file", "item", "step", "img", "row"])
            token = "".join(rng.choices(letters, k=rng.randint(16, 40))) + "7" if personal else f"{word}{rng.randint(1, 99)}-{word}"
            lead = rng.choice(["use ", "see ", "the ", "it was ", ""])
            text, start, end = f"{lead}{token} here", len(lead), len(lead) + len(token)
        for own, begin, stop, features_, _, taken in candidates(text, base_spans(text)):
            inside = begin < end and start < stop
            if own == kind and not taken and (not personal or not inside or (begin, stop) == (start, end)):
                x.append(features_)
                y.append(personal and inside)
    return x, y


CELLS = "kind string, label boolean, held boolean, steps binary"


def cells(found: DataFrame) -> DataFrame:
    """``kind, label, held, steps, n``: all labelled candidates of the result of ``searched``, and generated ones, counted."""
    rows = found.select("doc_id", F.explode("more").alias("one")).select("doc_id", "one.*").filter("label IS NOT NULL")
    held = F.xxhash64("doc_id", "start", "end", "kind").bitwiseAND(1) == 1
    made = [
        (kind, label, at // 4 % 2 == 1, list(map(float, values)))
        for kind in ADDED
        for at, (values, label) in enumerate(zip(*generated(kind)))
    ]
    made = found.sparkSession.createDataFrame(made, "kind string, label boolean, held boolean, features array<double>").coalesce(1)

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(steps=[row.tobytes() for row in steps(np.stack(frame.pop("features")), GRID)])

    every = rows.select("kind", "label", held.alias("held"), "features").unionByName(made)
    return every.mapInPandas(step, CELLS).groupBy("kind", "label", "held", "steps").agg(F.count("*").alias("n"))


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]  # steps, labels, numbers


def _at_once(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Cells]]:
    """Kind, and up to about ``CELLS_AT_ONCE`` of its cells."""
    waiting, size = [], 0
    for frame in itertools.chain(frames, [None]):
        if frame is not None:
            waiting.append(frame)
            size += len(frame)
        if size >= CELLS_AT_ONCE or (frame is None and size):
            for kind, own in pd.concat(waiting).groupby("kind"):
                x = np.frombuffer(b"".join(own["steps"]), np.uint8).reshape(len(own), -1)
                yield kind, (x, own["label"].to_numpy(np.int64), own["n"].to_numpy(np.int64))
            waiting, size = [], 0


def _score_steps(trees: Trees, x: np.ndarray) -> np.ndarray:
    return np.floor(score(trees, x) * SCORE_UNIT).clip(-(1 << 15), 1 << 15).astype(np.int64)


def train(found: DataFrame) -> dict[str, tuple[Trees, float]]:
    """Trees of one half and their threshold on the other, for each kind, from the stored result of ``searched``."""
    return _trained(found, True)


def cross_trained(found: DataFrame) -> dict[str, tuple[Trees, float]]:
    """The mean of the models that either half trains and the other calibrates, for each kind."""
    one, other = train(found), _trained(found, False)
    models = {}
    for kind in ADDED:
        trees = one[kind][0].and_then(other[kind][0])
        models[kind] = trees._replace(value=trees.value / 2), (one[kind][1] + other[kind][1]) / 2
    return models


def _trained(found: DataFrame, out: bool) -> dict[str, tuple[Trees, float]]:
    """Trees of the candidates whose ``held`` is not ``out``, and their threshold on the others."""
    ship(found.sparkSession)
    stored_cells = stored(cells(found).select("kind", "label", "held", "steps", "n"), "personal-data-cells")
    sizes = stored_cells.groupBy("kind", "label", "held").agg(F.sum("n").alias("n"), F.count("*").alias("cells")).collect()
    counts = {kind: tuple(sum(r.n for r in sizes if (r.kind, r.label, r.held) == (kind, label, not out)) for label in (False, True)) for kind in ADDED}
    learned, kept_out = (stored_cells.filter(F.col("held") == held).drop("held") for held in (not out, out))
    if sum(row.cells for row in sizes) <= CELLS_AT_HAND:
        at_hand = {kind: own for kind, own in _at_once(iter([learned.toPandas()]))}
        trees = boosted(lambda trees, growing, depth: {kind: level_sums(trees[kind], growing[kind], depth, *at_hand[kind]) for kind in ADDED}, counts, GRID)
    else:
        trees = boosted(lambda trees, growing, depth: _summed(learned, trees, growing, depth), counts, GRID)

    def score_steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for kind, (x, label, n) in _at_once(frames):
            yield pd.DataFrame({"kind": kind, "label": label, "at": _score_steps(trees[kind], x), "n": n})

    by_score = kept_out.mapInPandas(score_steps, "kind string, label bigint, at bigint, n bigint")
    by_score = by_score.groupBy("kind", "label", "at").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # bounded by the steps of scores
    models = {}
    for kind in ADDED:
        own = by_score[by_score["kind"] == kind]
        y, n = own["label"].to_numpy(np.float64), own["n"].to_numpy(np.float64)
        models[kind] = with_cuts(trees[kind], GRID), threshold(own["at"].to_numpy() / SCORE_UNIT, y, n)
    return models


def _summed(learned: DataFrame, trees: dict[str, Trees], growing: dict[str, Trees], depth: int) -> dict[str, np.ndarray]:
    """``level_sums`` over the stored cells of each kind: tasks sum what they hold."""
    shape = 2, 2**depth * 2 * len(GRID) * STEPS

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for kind, own in _at_once(frames):
            sums[kind] = sums.get(kind, 0) + level_sums(trees[kind], growing[kind], depth, *own)
        for kind, (slope, curve) in sums.items():
            at = np.flatnonzero((slope != 0) | (curve != 0))
            yield pd.DataFrame({"kind": kind, "at": at, "slope": slope[at], "curve": curve[at]})

    parts = learned.mapInPandas(step, "kind string, at bigint, slope bigint, curve bigint")
    rows = parts.groupBy("kind", "at").agg(F.sum("slope").alias("slope"), F.sum("curve").alias("curve")).toArrow().to_pandas()
    out = {kind: np.zeros(shape, np.int64) for kind in ADDED}
    for kind, own in rows.groupby("kind"):
        out[kind][:, own["at"].to_numpy()] = own[["slope", "curve"]].to_numpy().T
    return out


def chosen(more, models: dict[str, tuple[Trees, float]]) -> list[Span]:
    """The candidates to add: confirmed ones, and those that the trees select."""
    more = [one for one in more if not one["taken"]]
    added = [(one["kind"], one["start"], one["end"]) for one in more if one["label"]]
    for kind, (trees, least) in models.items():
        own = [one for one in more if one["kind"] == kind and not one["label"]]
        if own:
            scores = score(trees, np.array([list(one["features"]) for one in own]))
            selected = sorted((-s, one["start"] - one["end"], one["start"], one["end"]) for one, s in zip(own, scores) if s >= least)
            added += [(kind, start, end) for start, end in _apart([span[2:] for span in selected])]
    return added


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none before them."""
    kept: list[tuple[int, int]] = []
    for start, end in spans:
        at = bisect.bisect(kept, (start, end))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
            kept.insert(at, (start, end))
    return kept


def joined_spans(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2])))


def found(docs: DataFrame) -> DataFrame:
    """``doc_id``, number of spans by base kind, ``base_sha256`` and all ``spans`` of every document."""
    candidates_of = stored(searched(docs), "personal-data")
    models = cross_trained(candidates_of)

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            base = [[(s["kind"], s["start"], s["end"]) for s in spans] for spans in frame["base"]]
            every = [spans + chosen(more, models) for spans, more in zip(base, frame["more"])]
            out = {"doc_id": frame["doc_id"]}
            out |= {f"n_{kind}": [sum(s[0] == kind for s in spans) for spans in base] for kind in KINDS}
            out["base_sha256"] = [hashlib.sha256(joined_spans(spans).encode()).hexdigest() for spans in base]
            out["spans"] = list(map(joined_spans, every))
            yield pd.DataFrame(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    return candidates_of.mapInPandas(answer, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind that starts first."""
    parts, end = [], 0
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2])):
        if start >= end:
            parts += [text[end:start], f"<{kind}>"]
        end = max(end, stop)
    return "".join([*parts, text[end:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced by ``<kind>``; null texts stay null."""
    models = cross_trained(stored(searched(docs).filter(F.size("more") > 0).select("doc_id", "more"), "pii-candidates"))
    schema: StructType = docs.schema

    def clean(text: str | None) -> str | None:
        if not text or not TELLING.search(text):
            return text
        base = base_spans(text)
        names = ("kind", "start", "end", "features", "label", "taken")
        more = [dict(zip(names, one)) for one in candidates(text, base)]
        return redact(text, base + chosen(more, models))

    def answer(frames):
        import pyarrow as pa

        for batch in frames:
            at = batch.schema.get_field_index("text")
            texts = pa.array([clean(text) for text in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(answer, schema)
