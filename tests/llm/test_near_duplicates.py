"""Near copies against all pairs, compared one by one."""

import random
import re

import pytest
from texts import AWKWARD

from earshot.llm import near_duplicates
from earshot.llm.registry import QUERIES


def shingle_set(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    width = min(5, len(words))
    return frozenset(tuple(words[at : at + width]) for at in range(len(words) - width + 1))


def brute_components(texts):
    """(doc_id, set size, component) by comparing all pairs that share a shingle."""
    sets = {doc_id: shingle_set(text) for doc_id, text in texts.items()}
    root = {doc_id: doc_id for doc_id in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = {}
    for doc_id, found in sorted(sets.items()):
        common = {}
        for shingle in found:
            for other in having.setdefault(shingle, []):
                common[other] = common.get(other, 0) + 1
            having[shingle].append(doc_id)
        for other, shared in common.items():
            if 100 * shared >= 75 * (len(found) + len(sets[other]) - shared):
                low, high = sorted((find(doc_id), find(other)))
                root[high] = low
    return {(doc_id, len(found), find(doc_id)) for doc_id, found in sets.items()}


def rows_of(df):
    rows = df.collect()
    assert all(row.kept == (row.doc_id == row.component_id) for row in rows)
    return {(row.doc_id, row.n_shingles, row.component_id) for row in rows}


def test_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {row.doc_id: row.text for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = rows_of(QUERIES["op2_minhash"](spark, sf_dir))
    assert found == brute_components(texts)
    assert len({component for *_, component in found}) < len(texts)


@pytest.fixture(scope="module")
def family_texts():
    """Families of edited copies of all degrees, boilerplate with short own parts, and awkward texts."""
    rng = random.Random(3)
    vocabulary = [f"w{at}" for at in range(3000)]
    texts = list(AWKWARD)
    for size, copies, most in ((146, 120, 12), (40, 40, 3), (300, 60, 30), (9, 20, 1)):
        base = rng.choices(vocabulary, k=size)
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, most)):
                words[rng.randrange(size)] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    passage = rng.choices(vocabulary, k=30)
    for _ in range(80):
        texts.append(" ".join(passage + rng.choices(vocabulary, k=rng.randint(0, 25))))
    for size in range(1, 8):
        texts += [" ".join(vocabulary[:size]), " ".join(vocabulary[:size]).upper(), "\n".join(vocabulary[:size])]
    texts += [" ".join(rng.choices(vocabulary, k=30)) for _ in range(60)]
    return dict(enumerate(texts))


def test_families(spark, family_texts):
    docs = spark.createDataFrame([(i, text, 1, "x") for i, text in family_texts.items()], "doc_id bigint, text string, a int, shared string")
    assert rows_of(near_duplicates.components(docs)) == brute_components(family_texts)
    left = near_duplicates.without_near_copies(docs)
    assert left.columns == docs.columns
    assert {row.doc_id for row in left.collect()} == {component for *_, component in brute_components(family_texts)}


def test_rows_without_id_repeated_rows_and_no_rows(spark):
    text = " ".join(f"w{at}" for at in range(30))
    rows = [(7, text), (7, text), (None, text), (None, "another text of its own"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(map(tuple, near_duplicates.components(docs).collect()), key=str)
    assert found == sorted(
        [(7, 26, 7, True), (7, 26, 7, True), (None, 26, 7, True), (None, 1, None, True), (9, 0, 9, True)], key=str
    )
    assert near_duplicates.components(docs.limit(0)).collect() == []
