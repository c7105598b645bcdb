"""The quality model: slopes, pieces, what it may not see, and accuracy on documents held out."""

import zlib

import numpy as np
import pytest
from texts import AWKWARD

from earshot.llm import attention, passages, quality_model
from earshot.llm.registry import QUERIES

SF_DIR = "/root/testdata/sf0.1"
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def bags():
    rng = np.random.default_rng(3)
    counts = np.array([1, 4, 2, 7])
    return rng.standard_normal((counts.sum(), passages.FEATURES)), counts, np.array([0.0, 1.0, 1.0, 0.0])


def test_slopes_against_differences(bags):
    x, counts, labels = bags
    net = attention.started(x)
    net = net._replace(output=np.linspace(-1, 1, attention.HIDDEN), output_bias=np.array([0.2]))
    _, found = attention.slopes(net, x, counts, labels)
    rng = np.random.default_rng(1)
    for name in attention.LEARNED:
        part = getattr(net, name)
        for at in rng.integers(part.size, size=4):
            step = np.zeros(part.size)
            step[at] = 1e-5
            step = step.reshape(part.shape)
            up, down = (attention.slopes(net._replace(**{name: part + by}), x, counts, labels)[0] for by in (step, -step))
            assert found[name].ravel()[at] == pytest.approx((up - down) / 2e-5, abs=1e-7)


def test_bags_merge_as_one_softmax(bags):
    x, counts, labels = bags
    net = attention.trained(x, counts, labels)
    whole = attention.scores(net, attention.bags(net, x, counts))
    pieces = attention.bags(net, x, np.ones(len(x), dtype=int))
    assert attention.scores(net, attention.merged(pieces, counts)) == pytest.approx(whole)
    h, t, s, _ = attention._forward(net, x[1:5])
    gate = np.exp((t * s) @ net.attention)
    by_hand = attention.sigmoid((gate / gate.sum()) @ h @ net.output + net.output_bias[0])
    assert whole[1] == pytest.approx(by_hand)
    assert ((whole >= 0.5) == (labels == 1)).all()


def test_passages_of_many_texts_are_those_of_each():
    texts = ["" if text is None else text for text in AWKWARD]
    x, counts = passages.encoded(texts)
    alone = [passages.encoded([text]) for text in texts]
    assert counts.tolist() == [int(n[0]) for _, n in alone]
    words = [len([word for word in text.replace("\x85", "x").split() if word]) for text in texts[:12]]
    assert counts[:12].tolist() == [max(1, -(-n // passages.PASSAGE_WORDS)) for n in words]
    assert (x == np.concatenate([x for x, _ in alone])).all()
    shout, calm = passages.encoded(["BUY!! NOW!! BUY!! NOW!!"])[0][0], passages.encoded(["Buy now, or later."])[0][0]
    assert shout[passages.CLASSES**2 + 5] == 1 and calm[passages.CLASSES**2 + 5] == 0


def test_long_texts_are_read_in_pieces(monkeypatch, bags):
    net = attention.trained(*bags)
    texts = ["short one", "long " * 300, "", "x" * 1500, "end"]
    whole = np.concatenate([attention.scores(net, bag) for bag in quality_model.bags_of(net, texts)])
    monkeypatch.setattr(quality_model, "AT_ONCE", 100)
    assert np.concatenate([attention.scores(net, bag) for bag in quality_model.bags_of(net, texts)]) == pytest.approx(whole)
    monkeypatch.setattr(passages, "PIECE", 5 * passages.PASSAGE_WORDS)
    cut = np.concatenate([attention.scores(net, bag) for bag in quality_model.bags_of(net, texts)])
    assert cut == pytest.approx(whole, abs=0.05)


def test_held_out_documents(spark):
    labels = {row.doc_id: row.quality for row in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = QUERIES["op12_quality_classifier"](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) for row in rows)
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.5) for row in rows)
    for quality in (0, 1):
        unseen = [row.predicted == quality for row in rows if row.held_out and labels.get(row.doc_id) == quality]
        assert len(unseen) > 100 and sum(unseen) / len(unseen) > 0.97


def test_held_out_labels_and_other_columns_are_not_seen(spark):
    sf_dir = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 3 = 1, 1 - quality, quality) AS quality", "1 - toxic AS toxic")
    blind = documents.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "1 AS label", "2 AS place", "0.1D AS score")
    one = quality_model.train(documents, labels)
    two = quality_model.train(blind, other)
    assert all((a == b).all() for a, b in zip(one, two))
    assert sorted(quality_model.scored(documents, one).collect()) == sorted(quality_model.scored(blind, two).collect())


def test_awkward_texts_and_labels(spark):
    rows = [(at, text) for at, text in enumerate(AWKWARD)] + [(None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, SCHEMA)
    given = [(at, at % 2) for at in range(14)] + [(1, 0), (2, None), (None, 1), (77, 1)]
    labels = spark.createDataFrame(given, "doc_id bigint, quality int")
    found = quality_model.scored(df, quality_model.train(df, labels)).collect()
    assert len(found) == len(rows) and all(0 < row.score < 1 for row in found)
    assert len({row.score for row in found if row.doc_id == 3}) == 2
    unknown = quality_model.scored(df, quality_model.train(df, labels.limit(0))).collect()
    assert {row.score for row in unknown} == {0.5} and {row.predicted for row in unknown} == {1}
    assert quality_model.scored(df.limit(0), quality_model.train(df.limit(0), labels)).collect() == []
