"""Near words against all pairs with a full edit matrix, in one range and in many."""

import random
import re
import zlib
from collections import Counter

import pytest
from texts import AWKWARD

from earshot.llm import spellings


def edits(one, other):
    rows = [list(range(len(other) + 1))]
    for at, letter in enumerate(one):
        row = [at + 1]
        for to, against in enumerate(other):
            row.append(min(rows[-1][to] + (letter != against), rows[-1][to + 1] + 1, row[to] + 1))
        rows.append(row)
    return rows[-1][-1]


def counted(documents):
    counts = Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if crc % 97 == 0:
                run = run[: crc % len(run)] + run[crc % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 5 and n >= 3}


def expected(counts):
    near = {word: [] for word in counts}
    by_length = sorted(counts, key=len)
    for at, one in enumerate(by_length):
        for other in by_length[at + 1 :]:
            if len(other) > len(one) + 1:
                break
            if edits(one, other) == 1:
                near[one].append(other)
                near[other].append(one)
    forms = {}
    for word, found in near.items():
        best = min(found, key=lambda other: (-counts[other], other), default=None)
        forms[word] = best if best is not None and counts[best] >= 2 * counts[word] else None
    rows = set()
    for word, n in counts.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        rows.add((word, n, len(near[word]), forms[word], counts.get(forms[word]), root))
    return rows


def rows_of(df):
    rows = [(row.word, row.n, row.n_near, row.form, row.form_n, row.root) for row in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def documents():
    """Words of few letters, many with one beginning or one end, chains of rarer and rarer variants."""
    rng = random.Random(4)
    words = []
    for _ in range(60):
        words.append("".join(rng.choices("abé", k=rng.randint(4, 7))))
        words.append("shared" + "".join(rng.choices("abc", k=rng.randint(1, 5))))
        words.append("".join(rng.choices("abÿ", k=rng.randint(1, 5))) + "ending")
    chain = ["counted", "coumted", "coumtet", "coumte", "koumte"]
    text = [word for word in words for _ in range(rng.choice([1, 3, 4, 9]))]
    text += [word for at, word in enumerate(chain) for _ in range(3 * 2 ** (len(chain) - at))]
    rng.shuffle(text)
    rows = [(at, " ".join(text[at::20])) for at in range(20)]
    rows += [(at, text) for at, text in enumerate(AWKWARD)] * 3
    rows += [(None, "ÀÉÈ École ÉCOLE x×y÷zab " * 9), (7, "one-TWO three4five sıx ſeven " * 5)]
    return rows


def test_rows_of_the_edit_matrix():
    rng = random.Random(8)
    listed = sorted({"".join(rng.choices("ab", k=rng.randint(1, 8))) for _ in range(300)})
    known = spellings.Sorted(listed)
    for word in listed:
        for begin in (0, len(word) // 2):
            found = [listed[at] for at in known.near(word, begin)] if begin else None
            if found is not None:
                assert found == [other for other in listed if other[:begin] == word[:begin] and edits(word, other) == 1]


def test_rows_written_out_are_those_of_the_function():
    rng = random.Random(9)
    for _ in range(300):
        word, other = ("".join(rng.choices("abc", k=rng.randint(5, 9))) for _ in range(2))
        other = word[: len(word) // 2] + other
        row, begin = spellings.SAME, len(word) // 2
        for depth in range(begin, len(other)):
            row = spellings.next_row(row, depth, other[depth], word + spellings.PADDING)
            if min(row) > 1:
                break
        found = min(row) <= 1 and abs(len(other) - len(word)) <= 1 and row[1 - len(other) + len(word)] == 1
        assert list(spellings.Sorted([other]).near(word, begin)) == [0] * found
        assert found == (edits(word, other) == 1)


@pytest.mark.parametrize("limits", [{}, {"range_words": 40}, {"range_words": 9, "guests": 3}])
def test_variants(spark, documents, limits):
    df = spark.createDataFrame(documents, "doc_id bigint, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS range")
    found = rows_of(spellings.variants(df.repartition(5), **limits))
    assert found == expected(counted(documents))
    chain = {row[0]: row for row in found}
    assert chain["koumte"][5] == chain["coumtet"][5] == "counted"


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spellings.variants(df).collect() == []
    assert spellings.variants(spark.createDataFrame([(1, None), (2, "")], df.schema)).collect() == []
