"""Packing, encoding and counting against the tokenizers library, document by document."""

import hashlib
import random
import zlib
from bisect import insort

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import AWKWARD
from tokenizers import Tokenizer

from earshot.llm import bpe, packing, token_counts
from earshot.llm.registry import QUERIES
from earshot.llm.tokens import byte_encoder

SF_DIR = "/root/testdata/sf0.001"
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id bigint, text string, ids string, length string, row string"


def ids_of(text):
    return BYTES.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(at, text, "x", "y", None) for at, text in enumerate(AWKWARD)] + [(3, AWKWARD[3], "x", "y", None), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return {row.doc_id: row.text for row in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def best_fit_decreasing(lengths, capacity):
    """Number of sequences of the textbook algorithm, piece by piece."""
    open_, opened = [], 0
    for length in sorted(lengths, reverse=True):
        fit = next((at for at, room in enumerate(open_) if room >= length), None)
        room = open_.pop(fit) if fit is not None else capacity
        opened += fit is None
        if room > length:
            insort(open_, room - length)
    return opened


def check_packing(rows, texts, capacity=1024):
    by_doc, by_sequence = {}, {}
    for row in rows:
        by_doc.setdefault(row.doc_id, []).append(row)
        by_sequence.setdefault(row.sequence_id, []).append(row)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids, at = [*ids_of(text), 2], 0
        for k, row in enumerate(sorted(by_doc[doc_id], key=lambda row: row.piece)):
            part = np.array(ids[at : at + row.length], dtype="<u4").tobytes()
            assert (row.piece, row.start, row.ids_crc32) == (k, at, zlib.crc32(part))
            assert row.length == capacity or k == 0
            at += row.length
        assert at == len(ids)
    for found in by_sequence.values():
        end = 0
        for row in sorted(found, key=lambda row: row.offset):
            assert row.offset == end
            end += row.length
        assert end <= capacity
    assert len(by_sequence) == best_fit_decreasing([row.length for row in rows], capacity)


def test_packing_of_documents(spark, documents):
    check_packing(QUERIES["op1_best_fit_packing"](spark, SF_DIR).collect(), documents)


def test_packing_of_awkward_texts(spark, awkward):
    cut = packing.pieces(awkward)
    rows = packing.pack(cut).collect()
    texts = [text for _, text, *_ in awkward.collect()]
    assert sum(row.length for row in rows) == sum(len(ids_of(text)) + 1 for text in texts)
    assert packing.pack(packing.pieces(awkward.limit(0))).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {length: lengths.count(length) for length in set(lengths)}
    fill = {}
    steps = sorted(packing.plan(counts, 40))
    for (length, rank, first, each, offset), after in zip(steps, [*steps[1:], (None, 0)]):
        end = after[1] if after[0] == length else counts[length]
        for nth in range(end - rank):
            fill.setdefault(first + nth // each, []).append((offset + nth % each * length, length))
    for places in fill.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 40
    assert sum(map(len, fill.values())) == len(lengths)
    assert len(fill) == best_fit_decreasing(lengths, 40)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab '\n .1é́")), max_size=60))
def test_chunks_give_the_ids_of_the_library(text):
    assert list(np.frombuffer(byte_encoder().encode(text), "<u4")) == ids_of(text)
    ids = WORDS.encode(text, add_special_tokens=False).ids
    assert list(np.frombuffer(bpe.word_encoder().encode(text), "<u4")) == ids
    assert bpe.word_encoder().decode(ids) == WORDS.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abcthein  'sA1.é́你<|"), max_size=200), st.integers(3, 30), st.integers(2, 5))
def test_tree_gives_the_ids_of_the_whole(text, leaf, window):
    encoder = bpe.word_encoder()
    leaves = [bpe.encoded(encoder, part) for part in bpe.halves(text, leaf)]
    found = leaves[0]
    for part in leaves[1:]:
        found = bpe.join(encoder, found, part, window)
    whole = bpe.encoded(encoder, text)
    assert found.ids.tolist() == whole.ids.tolist()
    assert found.starts.tolist() == whole.starts.tolist()
    tree = bpe.joined(encoder, [bpe.encoded(encoder, part) for part in bpe.halves(text, leaf)])
    assert tree.ids.tolist() == whole.ids.tolist()


def check_bpe(rows, texts):
    expected = []
    for doc_id, text in texts:
        ids = WORDS.encode(text or "", add_special_tokens=False).ids
        decoded = WORDS.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        expected.append((doc_id, len(ids), *sha))
    key = lambda row: (row[0] is None, row)
    assert sorted((tuple(row) for row in rows), key=key) == sorted(expected, key=key)


def test_bpe_of_documents(spark, documents):
    check_bpe(QUERIES["op9_bpe"](spark, SF_DIR).collect(), documents.items())


@pytest.mark.parametrize("leaf", [bpe.LEAF, 100])
def test_bpe_of_awkward_texts(spark, awkward, leaf):
    rows = bpe.digests(bpe.decode(bpe.encode(awkward, leaf=leaf))).collect()
    check_bpe(rows, [(row.doc_id, row.text) for row in awkward.collect()])
    assert bpe.digests(bpe.decode(bpe.encode(awkward.limit(0)))).collect() == []


def brute_sections(text, ends):
    """Tokens by section from the library's offsets in bytes, one token after the other."""
    counts, at = [0] * len(ends), 0
    for token in ids_of(text):
        end = at + int(byte_encoder().byte_lengths[token])
        shared = [max(0, min(end, b) - max(at, a)) for a, b in zip([0, *ends], ends)]
        counts[shared.index(max(shared))] += 1
        at = end
    assert at == len((text or "").encode())
    return counts


def test_token_counts(spark, awkward):
    texts = {at: text or "" for at, text in enumerate(AWKWARD)}
    rows = token_counts.by_line(awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()
    for doc_id, text in texts.items():
        found = sorted((row for row in rows if row.doc_id == doc_id), key=lambda row: row.section)
        lines = text.split("\n")
        parts = [line + "\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        assert [text[row.start : row.end] for row in found] == parts
        ends = np.cumsum([len(part.encode()) for part in parts]).tolist()
        assert [row.n_tokens for row in found] == brute_sections(text, ends)
    assert token_counts.by_line(awkward.limit(0)).collect() == []


def test_token_counts_by_field(spark):
    docs = spark.createDataFrame([(1, "A title", None, "some body\n\ntext"), (2, "", "", "")], "doc_id bigint, a string, b string, c string")
    rows = token_counts.by_field(docs, ["a", "b", "c"], "\n\n").orderBy("doc_id", "section").collect()
    whole = "A title\n\n\n\nsome body\n\ntext"
    assert [row.n_tokens for row in rows[:3]] == brute_sections(whole, [9, 11, len(whole)])
    assert [(row.start, row.end) for row in rows[:3]] == [(0, 9), (9, 11), (11, len(whole))]
    assert sum(row.n_tokens for row in rows[3:]) == len(ids_of("\n\n\n\n"))


def test_crossing_tokens_go_to_the_larger_part():
    rng = random.Random(5)
    for _ in range(200):
        size = rng.randint(1, 40)
        tokens = sorted({*rng.sample(range(1, size + 1), rng.randint(1, size)), size})
        sections = sorted([*rng.choices(range(size + 1), k=rng.randint(0, 6)), size])
        expected = [0] * len(sections)
        for a, b in zip([0, *tokens], tokens):
            shared = [max(0, min(b, d) - max(a, c)) for c, d in zip([0, *sections], sections)]
            expected[shared.index(max(shared))] += 1
        assert token_counts.allocate(np.array(tokens), np.array(sections)).tolist() == expected
