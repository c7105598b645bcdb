"""The masked language model: exact scores, slopes, and what it learns."""

import random
import time

import numpy as np
from texts import AWKWARD

from earshot.llm import language_model as lm
from earshot.llm.registry import QUERIES


def slow_score(weights, words):
    """The sum of log-probabilities, word by word."""
    total = 0.0
    for at, word in enumerate(words):
        hidden = weights["shift"].astype(np.float64)
        for distance in range(1, lm.WINDOW + 1):
            left = words[at - distance] if at >= distance else lm.WORDS
            right = words[at + distance] if at + distance < len(words) else lm.WORDS
            hidden = hidden + float(lm.NEARNESS[distance - 1]) * (weights["left"][left] + weights["right"][right])
        hidden = np.tanh(hidden)
        kind, inside = divmod(int(word), lm.PER_CLASS)
        for logits, chosen in (
            (hidden @ weights["to_class"] + weights["class_bias"], kind),
            (hidden @ weights["to_word"] + weights["word_bias"][kind], inside),
        ):
            total += logits[chosen] - np.log(np.exp(logits).sum())
    return total


def test_slopes():
    rng = np.random.default_rng(2)
    flat = lm.first_weights().astype(np.float64)
    line, places = lm.padded([rng.integers(0, lm.WORDS, n).astype(np.uint16) for n in (9, 1, 4)])
    slopes = lm.gradient(lm.split_weights(flat), line, places)
    offset = 0
    for name, size in lm.SIZES.items():
        for at in np.argsort(-np.abs(slopes[name].ravel()))[:4]:
            ends = []
            for step in (1e-4, -1e-4):
                moved = flat.copy()
                moved[offset + at] += step
                ends.append(lm.log_probabilities(lm.split_weights(moved), line, places).mean())
            assert abs((ends[0] - ends[1]) / 2e-4 - slopes[name].ravel()[at]) < 1e-4
        offset += size


def test_scores_of_documents(spark):
    docs = spark.createDataFrame(list(enumerate(AWKWARD)) + [(None, "no id"), (4, "a")], "doc_id bigint, text string")
    words = lm.numbered(docs)
    flat = lm.first_weights()
    rows = lm.scores(words, flat).collect()
    assert len(rows) == len(AWKWARD) + 2
    for row in rows:
        text = AWKWARD[row.doc_id] if row.doc_id is not None else "no id"
        expected = slow_score(lm.split_weights(flat), lm.word_numbers(text or ""))
        assert abs(row.log_likelihood - expected) < 1e-3 * (1 + abs(expected))
        assert row.n_tokens == len((text or "").lower().encode().split())
    assert lm.scored(docs.limit(0)).collect() == []


def test_learns_the_order_of_words(spark):
    rng = random.Random(4)
    after = {word: rng.sample(range(60), 3) for word in range(60)}

    def sentence():
        words = [rng.randrange(60)]
        for _ in range(150):
            words.append(rng.choice(after[words[-1]]))
        return [f"word{w}" for w in words]

    held = [sentence() for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(sentence())) for i in range(1500)], "doc_id bigint, text string").repartition(3)
    words = lm.numbered(docs).cache()
    flat = lm.train(words)
    shuffled = [rng.sample(words_, len(words_)) for words_ in held]
    asked = spark.createDataFrame(
        [(i, " ".join(w)) for i, w in enumerate(held)] + [(100 + i, " ".join(w)) for i, w in enumerate(shuffled)], "doc_id bigint, text string"
    )
    mean = {row.doc_id: row.mean_log_likelihood for row in lm.scores(lm.numbered(asked), flat).collect()}
    assert sum(mean[i] > mean[100 + i] for i in range(40)) >= 38


def test_averages_are_weighted(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=8).astype(np.float32) for _ in range(70)]
    table = spark.createDataFrame([(i, i + 1, bytearray(v.tobytes())) for i, v in enumerate(vectors)], lm.WEIGHTED)
    expected = np.average(vectors, axis=0, weights=np.arange(1, 71))
    assert np.allclose(lm._averaged(table, 70), expected, atol=1e-5)


def test_query_scores_every_document(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = QUERIES["op3_language_model"](spark, sf_dir).collect()
    texts = {row.doc_id: row.text for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {row.doc_id for row in rows} == set(texts)
    assert all(row.log_likelihood < 0 for row in rows if texts[row.doc_id].strip())


def test_rare_words_of_a_group_score_below_common_ones(spark):
    """Words that share a group are told apart by their counts over all documents."""
    group = {}
    for at in range(5000):
        group.setdefault(int(lm.word_numbers(f"w{at}")[0]), []).append(f"w{at}")
    common, rare = next(names for names in group.values() if len(names) > 1)[:2]
    docs = spark.createDataFrame([(i, f"a b {common} c d") for i in range(200)] + [(900, f"a b {rare} c d"), (900, None)], "doc_id bigint, text string")
    rows = lm.scored(docs.repartition(3)).collect()
    assert len(rows) == 202
    score = {row.doc_id: row.log_likelihood for row in rows if row.n_tokens}
    assert abs(score[0] - score[900] - np.log(200)) < 1e-3


def test_words_of_the_join_count_as_the_sent_ones(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j % (i + 1)}" for j in range(50))) for i in range(40)] + [(3, "w1 w1"), (None, "")], "doc_id bigint, text string")
    words = lm.stored(lm.numbered(docs).withColumn("row", lm.F.monotonically_increasing_id()), "words")
    counted = lm.stored(lm.vocabulary(words), "vocabulary")
    n = {row["word"]: row["n"] for row in counted.collect()}
    assert sum(n.values()) == 2002
    for size in (lm.WORDS, 2 * lm.WORDS):
        total = {}
        for word, k in n.items():
            total[word % size] = total.get(word % size, 0) + k
        expected = {
            row["row"]: sum(np.log(n[w] / total[w % size]) for w in np.frombuffer(row["words"], np.int64).tolist()) for row in words.collect()
        }
        for most in (1, 20, 65_536):
            monkeypatch.setattr(lm, "COMMON", most)
            found = {row["row"]: row.of_words for row in lm.word_shares(words, counted, size).collect()}
            assert set(found) == set(expected) and all(abs(found[i] - expected[i]) < 1e-6 for i in found)


def test_more_groups_for_more_words():
    assert [lm.groups_for(n) for n in (0, 2_097_152, 2_097_153, 10**9)] == [1024, 1024, 2048, 32_768]
    for size in (2048, lm.MOST_WORDS):
        flat = lm.first_weights(size)
        line, places = lm.padded([lm.groups_of(lm.word_hashes("a b c d"), size)], size)
        after, count = lm.trained(flat, [(line, places)] * 20)
        assert count == 80
        before = lm.log_probabilities(lm.split_weights(flat), line, places).sum()
        assert lm.log_probabilities(lm.split_weights(after), line, places).sum() > before


def plain_log_probabilities(weights, line, places):
    """Gathered side by side, each softmax by the maximum of its row."""
    total = np.zeros((len(places), lm.HIDDEN), np.float32) + weights["shift"]
    for at, near in enumerate(lm.NEARNESS, 1):
        total += near * (weights["left"][line[places - at]] + weights["right"][line[places + at]])
    hidden = np.tanh(total)
    kind, word = np.divmod(line[places].astype(np.int64), lm.PER_CLASS)
    found = 0
    for values, right in ((hidden @ weights["to_class"] + weights["class_bias"], kind), (hidden @ weights["to_word"] + weights["word_bias"][kind], word)):
        values = values - values.max(axis=1, keepdims=True)
        values = values - np.log(np.exp(values).sum(axis=1, keepdims=True))
        found = found + values[np.arange(len(places)), right]
    return found


def test_sums_over_a_stretch_are_those_of_each_place():
    """Short and long documents in one line, small scores and some that would overflow; and for less time."""
    rng = np.random.default_rng(6)
    flat = lm.first_weights()
    line, places = lm.padded([rng.integers(0, lm.WORDS, n).astype(np.uint16) for n in (1, 2, 3, 700, 1, 40, 3000, 349)])
    took = {}
    for times in (1, 500):
        weights = lm.split_weights(flat * np.float32(times))
        for part in (places, places[1:7], places[3:4]):
            right = plain_log_probabilities(weights, line, part)
            assert np.allclose(lm.log_probabilities(weights, line, part), right, rtol=1e-4, atol=1e-4 * times)
    weights = lm.split_weights(flat)
    for own in (plain_log_probabilities, lm.log_probabilities) * 25:
        begin = time.process_time()
        own(weights, line, places)
        took[own] = min(took.get(own, 1e9), time.process_time() - begin)
    assert took[lm.log_probabilities] < 0.8 * took[plain_log_probabilities]
