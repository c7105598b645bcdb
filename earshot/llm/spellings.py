"""Spelling variants: words of a corpus that differ by one code point, and the common form of each.

The vocabulary is sorted twice, forward and with every word reversed. Two words one edit apart
share either the first half of the longer one or its last half, so each word is looked for among
the words with its first half in one list and those with its last half in the other. A scan runs
down the sorted words and keeps one row of the edit matrix per code point of the word at hand, in a
band of three; the rows of the prefix that the next word shares with it stay. A row without an
entry of at most one edit ends the word, and all words that share its prefix are skipped.

Each list is cut into ranges of about ``RANGE_WORDS`` words, however many share a prefix. A word
is scanned in its own range, and as a guest in others that hold its half and whose shared prefix
is still within one edit of it; their bounds, one row per range, are all that is sent to every
task. Guests of a crowded range are spread over copies of it. Results leave a range as one row a
word, the count of its near words and the best of them.

A null text has no words; a null ``doc_id`` is written as nothing. Rows are counted each, repeated
ones too; an empty table gives no rows; other columns are ignored. Equal counts: the form is the
first in code-point order. Words are compared as code points, not as letters with marks.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import narrow, ship, stored, text_or_empty

MIN_LENGTH = 5
MIN_COUNT = 3
#: A form is at least so many times as frequent.
RATIO = 2
#: One run in so many loses a code point.
DAMAGED_RUN = 97
#: Words of a range of a sorted list, and guests of one copy of it.
RANGE_WORDS = 10_000
GUESTS = 10_000
#: Different words that a task counts before it passes them on.
COUNTED = 400_000

#: Maximal runs of a-z and U+00C0 to U+00FF that are long enough, in UTF-8.
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % MIN_LENGTH)
#: Above every code point of a word.
LAST = "\U0010ffff"


def words(documents: DataFrame) -> DataFrame:
    """``word, n`` of the damaged runs of all texts."""
    ship(documents.sparkSession)
    texts = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_or_empty().alias("text"))

    def damaged(run: bytes, crc: int) -> bytes:
        letters = run.decode()
        at = crc % len(letters)
        return (letters[:at] + letters[at + 1 :]).encode()

    def passed(counts: Counter) -> pa.RecordBatch:
        found = [(word, n) for word, n in zip(map(bytes.decode, counts), counts.values()) if len(word) >= MIN_LENGTH]
        return pa.RecordBatch.from_pydict({"word": [word for word, _ in found], "n": pa.array([n for _, n in found], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                began = zlib.crc32(f"{doc_id}:".encode())
                for found in RUNS.finditer(text.as_buffer().to_pybytes().lower()):  # bytes lower A-Z only
                    run = found[0]
                    crc = zlib.crc32(run, began)
                    counts[run if crc % DAMAGED_RUN else damaged(run, crc)] += 1
                if len(counts) > COUNTED:
                    yield passed(counts)
                    counts = Counter()
        yield passed(counts)

    parts = texts.mapInArrow(count, "word string, n bigint").groupBy("word")
    return parts.agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def shared(one: str, other: str) -> int:
    """Length of the common prefix."""
    for at, (letter, against) in enumerate(zip(one, other)):
        if letter != against:
            return at
    return min(len(one), len(other))


#: Edits of a prefix of a listed word against the prefixes of the sought word one shorter, as long, one longer.
Row = tuple[int, int, int]
SAME: Row = (1, 0, 1)
#: Stands behind a sought word, where no letter agrees.
PADDING = "\0\0\0"


def next_row(row: Row, depth: int, letter: str, padded: str) -> Row:
    """The row after ``letter``, number ``depth`` (from 0) of the listed word, for a sought word and its padding.

    Places over one behind the end of the sought word never hold less than two edits.
    """
    shorter, equal, longer = row
    shorter = min(equal + 1, shorter + (padded[depth - 1] != letter))
    equal = min(equal + (padded[depth] != letter), longer + 1, shorter + 1)
    longer = min(longer + (padded[depth + 1] != letter), equal + 1)
    return shorter, equal, longer


class Sorted:
    """Sorted words with the lengths of the prefixes that neighbours share."""

    def __init__(self, listed: list[str]) -> None:
        self.words = listed
        self.shared = [0, *(shared(one, other) for one, other in zip(listed, listed[1:])), 0]

    def near(self, word: str, begin: int) -> Iterator[int]:
        """Places of words one edit from ``word`` that share its first ``begin`` code points."""
        listed, common, size, padded = self.words, self.shared, len(word), word + PADDING
        at = bisect_left(listed, word[:begin])
        end = bisect_left(listed, word[:begin] + LAST, at)
        rows = [SAME] * (begin + 1)
        while at < end:
            other, depth = listed[at], len(rows) - 1
            if not -1 <= len(other) - size <= 1:  # no row need be made for it
                at += 1
                del rows[common[at] + 1 :]
                continue
            shorter, equal, longer = rows[depth]
            # next_row, written out: this loop is most of the work
            for letter in other[depth:]:
                here = shorter + (padded[depth - 1] != letter)
                shorter = here if here <= equal else equal + 1
                here = equal + (padded[depth] != letter)
                if longer < here:
                    here = longer + 1
                equal = here if here <= shorter else shorter + 1
                depth += 1
                here = longer + (padded[depth] != letter)
                longer = here if here <= equal else equal + 1
                if shorter > 1 and equal > 1 and longer > 1:
                    break
                rows.append((shorter, equal, longer))
            else:
                if (longer, equal, shorter)[len(other) - size + 1] == 1:
                    yield at
                depth += 1  # no word is skipped
            at += 1
            while common[at] >= depth and at < end:  # the same dead prefix
                at += 1
            del rows[common[at] + 1 :]

    def reaches(self, word: str, begin: int) -> bool:
        """Whether a range from the first to the last of these words may hold a near word with the same beginning."""
        first, last = self.words[0], self.words[-1]
        if last < word[:begin] or first > word[:begin] + LAST:
            return False
        row, padded = SAME, word + PADDING
        for depth, letter in enumerate(first[: shared(first, last)]):
            if depth >= begin:
                row = next_row(row, depth, letter, padded)
                if min(row) > 1:
                    return False
        return True


def half(word: str) -> int:
    return len(word) // 2


def counts_here(word: str, other: str, reverse: bool) -> bool:
    """Whether a near pair, given as listed, belongs to this list: each pair to one of the two."""
    middle = max(len(word), len(other)) // 2
    if not reverse:
        return shared(word, other) >= middle
    return shared(word[::-1], other[::-1]) < middle


def near_words(vocabulary: DataFrame, range_words: int = RANGE_WORDS, guests: int = GUESTS) -> DataFrame:
    """``word, n_near, form_n, form`` (of the best near word) for each word that has any."""
    spark = vocabulary.sparkSession
    ship(spark)
    both = vocabulary.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("reverse"), "word", "n")
    key = F.when(F.col("reverse"), F.reverse("word")).otherwise(F.col("word")).alias("key")
    n_ranges = max(1, ceil(2 * vocabulary.count() / range_words))
    ranged = both.select("reverse", key, "n").repartitionByRange(n_ranges, "reverse", "key")
    listed = stored(ranged.withColumn("range", F.spark_partition_id()), "sorted-words")
    bounds = [
        (row.range, row.reverse, Sorted([row.first, row.last]))
        for row in listed.groupBy("range", "reverse").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()
    ]
    sent = spark.sparkContext.broadcast([(at, reverse, bound.words) for at, reverse, bound in bounds])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = {}
        for reverse in (False, True):
            found = sorted((ends, at) for at, side, ends in sent.value if side == reverse)
            lists[reverse] = ([at for _, at in found], [Sorted(ends) for ends, _ in found], [ends[1] for ends, _ in found])
        for frame in batches:
            rows = []
            for reverse, key, n, own in zip(frame["reverse"], frame["key"], frame["n"], frame["range"]):
                numbers, ranges, lasts = lists[reverse]
                prefix = key[: half(key)]
                for at in range(bisect_left(lasts, prefix), len(ranges)):
                    if ranges[at].words[0] > prefix + LAST:
                        break
                    if numbers[at] != own and ranges[at].reaches(key, half(key)):
                        rows.append((numbers[at], reverse, key, n))
            yield pd.DataFrame(rows, columns=["range", "reverse", "key", "n"])

    schema = "range int, reverse boolean, key string, n bigint"
    visits = stored(listed.select("reverse", "key", "n", "range").mapInPandas(route, schema), "visiting-words")
    crowds = visits.groupBy("range", "reverse").count().withColumn("copies", F.ceil(F.col("count") / guests)).drop("count")
    crowded = narrow(stored(crowds.where("copies > 1"), "crowded-ranges"))
    spread = [F.coalesce("copies", F.lit(1)).alias("copies")]
    own = listed.join(crowded, ["range", "reverse"], "left").select("range", "reverse", "key", "n", *spread)
    own = own.select("range", "reverse", "key", "n", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(False).alias("guest"))
    away = visits.join(crowded, ["range", "reverse"], "left").select("range", "reverse", "key", "n", *spread)
    away = away.select(
        "range", "reverse", "key", "n", F.pmod(F.xxhash64("key"), F.col("copies")).alias("copy"), F.lit(True).alias("guest")
    )

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        reverse, copy = bool(group["reverse"].iloc[0]), int(group["copy"].iloc[0])
        home = group[~group["guest"]].sort_values("key", kind="stable")
        known, counts = Sorted(home["key"].tolist()), home["n"].tolist()
        rows = []
        for key, guest in zip(group["key"], group["guest"]):
            if not guest and copy:  # scanned in the first copy
                continue
            found = [at for at in known.near(key, half(key)) if counts_here(key, known.words[at], reverse)]
            if found:
                best = min(found, key=lambda at: (-counts[at], known.words[at][::-1] if reverse else known.words[at]))
                rows.append((key, len(found), counts[best], known.words[best]))
        frame = pd.DataFrame(rows, columns=["word", "n_near", "form_n", "form"])
        if reverse:
            frame["word"], frame["form"] = frame["word"].str[::-1], frame["form"].str[::-1]
        return frame

    schema = "word string, n_near bigint, form_n bigint, form string"
    group = ["range", "reverse", "copy"]  # few bytes and much work: an explicit number of tasks is not merged
    found = own.unionByName(away).repartition(2 * n_ranges, *group).groupBy(*group).applyInPandas(scan, schema)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: the last of the forms that follow one another.

    Counts at least double from form to form, so there are no rings and chains are short; every
    step doubles the part of a chain that is known.
    """
    pointers = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = pointers.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = pointers.join(onward, F.col("root") == F.col("_word"), "left")
        step = stored(step.select("word", F.coalesce("_root", "root").alias("root"), F.isnotnull("_root").alias("moved")), "variant-roots")
        pointers = step.drop("moved")
        if step.where("moved").isEmpty():
            return pointers


def variants(documents: DataFrame, **limits: int) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word."""
    vocabulary = stored(words(documents), "vocabulary")
    near = near_words(vocabulary, **limits)
    common = F.col("form_n") >= RATIO * F.col("n")
    formed = stored(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(common, F.col("form")).alias("form"), F.when(common, F.col("form_n")).alias("form_n"),
        ),
        "variant-forms",
    )
    found = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
