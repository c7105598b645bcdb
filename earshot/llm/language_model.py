"""Scores of documents under a masked language model trained on the corpus itself.

Every word is predicted from the words on both sides of it: the sum over a document of the
conditional log-probabilities is its pseudo-log-likelihood. The model is a small network in numpy:
embeddings of the ``WINDOW`` words to the left and to the right, a hidden layer, and a softmax in
two levels over groups of words, which share the low bits of their hash. The last level, the word
in its group, is the word's share of the group's occurrences in a vocabulary counted over all
documents. The number of groups grows with the vocabulary (one for at most ``PER_GROUP`` words,
from ``WORDS`` to ``MOST_WORDS``), the vocabulary without limit.

The vocabulary is a stored table of 64-bit word hashes and counts. Words that are over one in
``COMMON`` of all occurrences, fewer than ``COMMON`` by that, are sent to the tasks; all others
meet the vocabulary in a join, in which no word is hot.

Training reads all documents once. They are dealt into ``ROUNDS`` parts by a hash; in each round
every task continues from the common weights with its own documents of that part (Adagrad steps
over batches of positions), and the weights of all tasks, in proportion to their positions, become
the next common ones. Task weights are averaged as a tree of groups of ``FAN_IN``, so what meets in
one task or the driver is a bounded number of weight vectors (150 kB to 4.4 MB each). A task that is
run again gives the same weights; other splits of the input give a slightly different model.

Words are runs without white space, lower-cased. A null text or one without words has no tokens and
a score of 0. Rows that repeat a ``doc_id`` are scored each. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import ship, stored, text_or_empty
from earshot.session import shared_folder

CLASSES, PER_CLASS = 32, 32
WORDS = CLASSES * PER_CLASS
MOST_WORDS = 32_768
PER_GROUP = 2_048
COMMON = 65_536
WINDOW = 3
HIDDEN = 16
ROUNDS = 4
FAN_IN = 32
BATCH = 4096
#: Words that are looked up at a time, or one document.
WORDS_AT_ONCE = 1 << 18
RATE = 0.1
SEED = 11



def shapes(size: int) -> dict[str, tuple[int, ...]]:
    """Shapes of the weights for ``size`` groups of words, a power of two."""
    per_class = 1 << (size.bit_length() - 1) // 2
    return {
        "left": (size + 1, HIDDEN),
        "right": (size + 1, HIDDEN),
        "shift": (HIDDEN,),
        "to_class": (HIDDEN, size // per_class),
        "class_bias": (size // per_class,),
        "to_word": (HIDDEN, per_class),
        "word_bias": (size // per_class, per_class),
    }


def sizes(size: int) -> dict[str, int]:
    return {name: int(np.prod(shape)) for name, shape in shapes(size).items()}


SIZES = sizes(WORDS)
#: Groups of words by the length of a weight vector.
GROUPS = {sum(sizes(WORDS << k).values()): WORDS << k for k in range((MOST_WORDS // WORDS).bit_length())}
#: Weight of the word at distance 1, 2, ... in the sum of its side.
NEARNESS = np.array([1 / (1 + at) for at in range(WINDOW)], dtype=np.float32)

Weights = dict[str, np.ndarray]


def split_weights(flat: np.ndarray) -> Weights:
    size = GROUPS[len(flat)]
    parts = np.split(flat, np.cumsum(list(sizes(size).values()))[:-1])
    return {name: part.reshape(shape) for (name, shape), part in zip(shapes(size).items(), parts)}


def first_weights(size: int = WORDS) -> np.ndarray:
    flat = np.random.default_rng(SEED).normal(0, 0.1, sum(sizes(size).values())).astype(np.float32)
    weights = split_weights(flat)
    weights["left"][size] = weights["right"][size] = 0  # what stands beyond the ends
    return flat


def word_hashes(text: str) -> np.ndarray:
    words = text.lower().encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def groups_of(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes % np.uint64(size)).astype(np.uint16)


def word_numbers(text: str) -> np.ndarray:
    return groups_of(word_hashes(text), WORDS)


def padded(documents: list[np.ndarray], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Documents in a row with ends between them, and the places of their words."""
    gap = np.full(WINDOW, size, np.uint16)
    line = np.concatenate([gap, *(part for words in documents for part in (words, gap))])
    return line, np.flatnonzero(line < size)


def _stretch(line: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of a line that is seen from ascending places, and where they are in it less the first ``WINDOW`` positions."""
    first = int(places[0]) - WINDOW
    return line[first : int(places[-1]) + WINDOW + 1], places - int(places[0])


def _outputs(weights: Weights) -> np.ndarray:
    """Weights of all classes and of all words of a class side by side; the bias of classes is the last row."""
    bias = np.concatenate([weights["class_bias"], np.zeros(len(weights["to_word"].T), np.float32)])
    return np.concatenate([np.concatenate([weights["to_class"], weights["to_word"]], axis=1), bias[None]])


def forward(weights: Weights, line: np.ndarray, places: np.ndarray):
    """Hidden values and a one; scores of all classes and then of all words of the right class; class and word of each place.

    Sides are summed over the whole stretch, in which few positions are no places, by moving it along itself.
    """
    stretch, inside = _stretch(line, places)
    left, right = weights["left"].take(stretch, axis=0), weights["right"].take(stretch, axis=0)
    size = len(stretch) - 2 * WINDOW
    total = left[WINDOW - 1 :][:size] + right[WINDOW + 1 :][:size]
    total += weights["shift"]
    for at, near in enumerate(NEARNESS[1:], 2):
        side = left[WINDOW - at :][:size] + right[WINDOW + at :][:size]
        side *= near
        total += side
    hidden = np.ones((len(places), HIDDEN + 1), total.dtype)
    np.tanh(total if len(places) == size else total.take(inside, axis=0), out=hidden[:, :HIDDEN])
    kind, word = np.divmod(line[places], np.uint16(weights["to_word"].shape[1]))
    values = hidden @ _outputs(weights)
    values[:, len(weights["class_bias"]) :] += weights["word_bias"].take(kind, axis=0)
    return hidden, values, kind, word


def _exponentials(values: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the scores, and their sums over classes and over words; maxima are taken off ``values`` where they could overflow."""
    if max(values.max(), -values.min()) > 40:
        for part in (values[:, :classes], values[:, classes:]):
            part -= part.max(axis=1, keepdims=True)
    powers = np.exp(values)
    of_class = np.arange(values.shape[1]) < classes
    return powers, powers @ np.stack([of_class, ~of_class], axis=1).astype(powers.dtype)


def log_probabilities(weights: Weights, line: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of each word given those around it."""
    _, values, kind, word = forward(weights, line, places)
    classes, row = len(weights["class_bias"]), np.arange(len(places))
    _, totals = _exponentials(values, classes)
    return values[row, kind] + values[row, classes + word.astype(np.int64)] - np.log(totals).sum(axis=1)


def _sums(size: int, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of each key."""
    out = np.zeros((size, values.shape[1]), np.float32)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    out[keys[starts]] = np.add.reduceat(values.take(order, axis=0), starts, axis=0)
    return out


def gradient(weights: Weights, line: np.ndarray, places: np.ndarray) -> Weights:
    """Of the mean log-probability."""
    hidden, values, kind, word = forward(weights, line, places)
    classes, row, ends = len(weights["class_bias"]), np.arange(len(places)), len(weights["left"]) - 1
    slopes, totals = _exponentials(values, classes)
    totals = -1 / (totals * np.float32(len(places)))
    slopes[:, :classes] *= totals[:, :1]
    slopes[:, classes:] *= totals[:, 1:]
    slopes[row, kind] += np.float32(1 / len(places))
    slopes[row, classes + word.astype(np.int64)] += np.float32(1 / len(places))
    inner = hidden[:, :HIDDEN]
    back = slopes @ _outputs(weights)[:HIDDEN].T
    back *= 1 - inner * inner
    stretch, inside = _stretch(line, places)
    size = len(stretch) - 2 * WINDOW
    spread = np.zeros((size, HIDDEN), back.dtype)  # nothing comes back from what is no place
    spread[inside] = back
    left, right = np.zeros((2, len(stretch), HIDDEN), back.dtype)  # sides of a place
    for at, near in enumerate(NEARNESS, 1):
        share = near * spread
        left[WINDOW - at :][:size] += share
        right[WINDOW + at :][:size] += share
    sides = _sums(ends + 1, stretch, np.concatenate([left, right], axis=1))
    sides[ends] = 0
    outputs = hidden.T @ slopes
    return {
        "left": sides[:, :HIDDEN],
        "right": sides[:, HIDDEN:],
        "shift": back.sum(axis=0),
        "to_class": outputs[:HIDDEN, :classes],
        "class_bias": outputs[HIDDEN, :classes],
        "to_word": outputs[:HIDDEN, classes:],
        "word_bias": _sums(classes, kind, slopes[:, classes:]),
    }


def trained(flat: np.ndarray, lines: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, int]:
    """Weights after one step for each batch of positions, and the number of positions."""
    flat = flat.copy()
    weights, seen, count = split_weights(flat), np.full(len(flat), 1e-6, np.float32), 0
    squares = split_weights(seen)
    for line, places in lines:
        for at in range(0, len(places), BATCH):
            part = places[at : at + BATCH]
            all_rows = 4 * len(part) > len(weights["left"])
            met = None if all_rows else np.unique(_stretch(line, part)[0])  # all others have no slope
            for name, slope in gradient(weights, line, part).items():
                rows = slice(None) if all_rows or name not in ("left", "right") else met
                slope = slope[rows]
                squares[name][rows] += slope * slope
                weights[name][rows] += slope * (np.float32(RATE) / np.sqrt(squares[name][rows]))
            count += len(part)
    return flat, count


def _documents(column: pd.Series, groups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lines of at least ``BATCH`` words, as far as there are so many."""
    waiting, size = [], 0
    for packed in column:
        waiting.append(groups_of(np.frombuffer(packed, np.uint64), groups))
        size += len(waiting[-1])
        if size >= BATCH:
            yield padded(waiting, groups)
            waiting, size = [], 0
    if size:
        yield padded(waiting, groups)


def numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, part, words`` (packed hashes); ``part`` is the round that trains on it."""
    ship(docs.sparkSession)

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(words=[word_hashes(text).tobytes() for text in frame.pop("text")])

    kind = docs.schema["doc_id"].dataType.simpleString()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).cast("int")
    return docs.select("doc_id", part.alias("part"), text_or_empty().alias("text")).mapInPandas(
        number, f"doc_id {kind}, part int, words binary"
    )


WEIGHTED = "task bigint, positions bigint, weights binary"


def _averaged(vectors: DataFrame, tasks: int) -> np.ndarray | None:
    """The mean of all weight vectors, in proportion to their positions."""

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        share = frame["positions"].to_numpy(np.float64) / frame["positions"].sum()
        frame = frame.assign(share=share).sort_values("task")
        total = sum(s * np.frombuffer(w, np.float32).astype(np.float64) for s, w in zip(frame["share"], frame["weights"]))
        return pd.DataFrame(
            {"task": [frame["task"].min() // FAN_IN], "positions": [frame["positions"].sum()], "weights": [total.astype(np.float32).tobytes()]}
        )

    while tasks > 1:
        vectors = vectors.groupBy(F.floor(F.col("task") / FAN_IN)).applyInPandas(mean, WEIGHTED)
        tasks = -(-tasks // FAN_IN)
    found = vectors.collect()  # one row, or none without words
    return np.frombuffer(found[0].weights, np.float32) if found else None


def train(words: DataFrame, size: int = WORDS) -> np.ndarray:
    """Weights for ``size`` groups from the stored result of ``numbered``."""
    flat = first_weights(size)
    for number in range(ROUNDS):
        part = words.filter(F.col("part") == number).select("words")

        def step(frames: Iterator[pd.DataFrame], flat: np.ndarray = flat) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            own, count = trained(flat, (line for frame in frames for line in _documents(frame["words"], size)))
            if count:
                yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "positions": [count], "weights": [own.tobytes()]})

        vectors = stored(part.mapInPandas(step, WEIGHTED), "task-weights")
        last = vectors.agg(F.max("task")).first()[0]
        if last is not None:
            flat = _averaged(vectors, max(2, last + 1))
    return flat


def scores(words: DataFrame, flat: np.ndarray) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood`` of the groups of words under the weights."""
    return _with_mean(_group_scores(words.select("doc_id", "words"), flat))


def _with_mean(scored: DataFrame) -> DataFrame:
    return scored.withColumn("mean_log_likelihood", F.col("log_likelihood") / F.greatest("n_tokens", F.lit(1)))


def group_sums(weights: Weights, documents: list[np.ndarray], size: int) -> np.ndarray:
    """The log-probability of each document's groups; short documents share a batch."""
    sums, at = np.zeros(len(documents)), 0
    while at < len(documents):
        end, n_words = at, 0
        while end < len(documents) and (end == at or n_words < BATCH):
            n_words += len(documents[end])
            end += 1
        line, places = padded([groups_of(hashes, size) for hashes in documents[at:end]], size)
        owner = np.repeat(np.arange(end - at), [len(hashes) for hashes in documents[at:end]])
        for first in range(0, len(places), BATCH):
            part = slice(first, first + BATCH)
            found = log_probabilities(weights, line, places[part])
            sums[at:end] += np.bincount(owner[part], weights=found, minlength=end - at)
        at = end
    return sums


def _group_scores(words: DataFrame, flat: np.ndarray) -> DataFrame:
    """``n_tokens, log_likelihood`` in place of ``words``."""
    size = GROUPS[len(flat)]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = split_weights(flat)
        for frame in frames:
            documents = [np.frombuffer(packed, np.uint64) for packed in frame.pop("words")]
            yield frame.assign(n_tokens=list(map(len, documents)), log_likelihood=group_sums(weights, documents, size))

    kept = ", ".join(f"{name} {kind}" for name, kind in words.dtypes if name != "words")
    return words.mapInPandas(score, f"{kept}, n_tokens bigint, log_likelihood double")


def vocabulary(words: DataFrame) -> DataFrame:
    """``word, n``: hash and occurrences of every word of the result of ``numbered``."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            word, n = np.unique(np.frombuffer(b"".join(frame["words"]), np.int64), return_counts=True)
            yield pd.DataFrame({"word": word, "n": n})

    return words.select("words").mapInPandas(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def groups_for(n_words: int) -> int:
    """Groups for a vocabulary of so many words."""
    size = WORDS
    while size < MOST_WORDS and size * PER_GROUP < n_words:
        size *= 2
    return size


def _weighed(words: DataFrame, counted: DataFrame, size: int, flat: np.ndarray | None) -> DataFrame:
    """``row, doc_id, n_tokens, value``: a row's words by their share of their group, and its groups under ``flat``.

    ``words`` has the columns of ``numbered`` and a unique ``row``, ``counted`` is its stored vocabulary.
    """
    totals = np.zeros(size)
    for group in counted.groupBy(F.col("word").bitwiseAND(size - 1).alias("at")).agg(F.sum("n").alias("n")).collect():  # at most MOST_WORDS
        totals[group["at"]] = group["n"]
    often = counted.filter(F.col("n") * COMMON > int(totals.sum())).orderBy("word").collect()  # fewer than COMMON
    common = np.array([row["word"] for row in often], np.int64)
    logs, log_totals = np.log(np.array([row["n"] for row in often], np.float64)), np.log(np.maximum(totals, 1))

    def weigh(documents: list[np.ndarray], weights: Weights | None) -> tuple[np.ndarray, ...]:
        """Values of documents; and of words that were not sent, the document, the word and how often it is there."""
        owner = np.repeat(np.arange(len(documents)), list(map(len, documents)))
        word = np.concatenate([np.zeros(0, np.int64), *documents])
        value = -log_totals[word & (size - 1)]
        known = np.zeros(len(word), bool)
        if len(common):
            at = np.minimum(np.searchsorted(common, word), len(common) - 1)
            known = common[at] == word
            value[known] += logs[at[known]]
        values = np.bincount(owner, weights=value, minlength=len(documents))
        if weights is not None:
            values += group_sums(weights, [hashes.view(np.uint64) for hashes in documents], size)
        owner, word = owner[~known], word[~known]
        order = np.lexsort((word, owner))
        owner, word = owner[order], word[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])])[: len(word)])
        return values, owner[first], word[first], np.diff(np.append(first, len(word)))

    kind = words.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, n_tokens bigint, word bigint, n bigint, value double"
    arrow = words.sparkSession.createDataFrame([], schema).toArrow().schema

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = None if flat is None else split_weights(flat)
        for whole in batches:
            documents = [np.frombuffer(packed, np.int64) for packed in whole.column(2).to_pylist()]
            sizes = np.array(list(map(len, documents)))
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // WORDS_AT_ONCE, prepend=-1))
            for at, end in zip(cuts, [*cuts[1:], len(documents)]):
                batch = whole.slice(at, end - at)
                values, owner, word, n = weigh(documents[at:end], weights)
                rare, none = pa.array(owner), np.zeros(len(word))
                columns = [
                    pa.concat_arrays([batch.column(0), batch.column(0).take(rare)]),
                    pa.concat_arrays([batch.column(1), pa.nulls(len(word), batch.column(1).type)]),
                    np.concatenate([sizes[at:end], none]).astype(np.int64),
                    np.concatenate([np.zeros(end - at, np.int64), word]),
                    np.concatenate([np.zeros(end - at, np.int64), n]),
                    np.concatenate([values, none]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], schema=arrow)

    found = stored(words.select("row", "doc_id", "words").mapInArrow(look_up, schema), "word-lookups")
    rare = found.filter("n > 0").select("row", "word", "n").join(counted.withColumnRenamed("n", "of_all"), "word")
    of_rare = rare.select("row", (F.col("n") * F.ln("of_all")).alias("value"))
    parts = found.filter("n = 0").select("row", "doc_id", "n_tokens", "value").unionByName(of_rare, allowMissingColumns=True)
    return parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("value").alias("value"))


def word_shares(words: DataFrame, counted: DataFrame, size: int) -> DataFrame:
    """``row, of_words``: the sum over a row's words of the logarithm of their share of their group."""
    return _weighed(words, counted, size, None).select("row", F.col("value").alias("of_words"))


def _by_part(words: DataFrame) -> DataFrame:
    """``words`` stored in a folder for each part, so that a round of training reads its own."""
    path = shared_folder(words.sparkSession, "numbered-words")
    words.write.partitionBy("part").parquet(path)
    return words.sparkSession.read.schema(words.schema).parquet(path)


def scored(docs: DataFrame) -> DataFrame:
    """Every document under the model of all of them: ``doc_id, n_tokens, log_likelihood, mean_log_likelihood``."""
    words = _by_part(numbered(docs).withColumn("row", F.monotonically_increasing_id()))
    counted = stored(vocabulary(words), "vocabulary")
    size = groups_for(counted.count())
    found = _weighed(words, counted, size, train(words, size))
    return _with_mean(found.select("doc_id", "n_tokens", F.col("value").alias("log_likelihood")))
