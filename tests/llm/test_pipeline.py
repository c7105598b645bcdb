"""The pipeline against brute force over the same documents."""

import re

import numpy as np
from pyspark.sql import functions as F
from test_near_duplicates import brute_components
from test_personal_data import plain_spans
from test_tokens import check_packing
from texts import AWKWARD

import corpus_pipeline
from earshot.llm import packing, personal_data, quality
from earshot.llm.common import stored

SF_DIR = "/root/testdata/sf0.01"


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {row.doc_id: row for row in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), "stage")
        after = {row.doc_id: row for row in docs.collect()}
        assert docs.columns == columns and len(after) == docs.count()
        texts = {doc_id: row.text for doc_id, row in before.items()}
        if name == "quality rules":
            kept = {row.doc_id for row in quality.quality(spark.read.parquet(f"{SF_DIR}/documents.parquet")).filter("kept").collect()}
        elif name == "exact dedup":
            first = {}
            for doc_id, text in sorted(texts.items(), key=lambda item: (-len(item[1] or ""), item[0])):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), doc_id)
            kept = set(first.values())
        elif name == "near dedup":
            kept = {component for *_, component in brute_components(texts)}
        else:
            kept = set(before)
            for doc_id, text in texts.items():
                new = after[doc_id].text
                assert not personal_data.base_spans(new) and len(new) == after[doc_id].n_chars
                if not re.search("[0-9@]", text):
                    assert new == text
                assert len(re.findall("<(?:email|ip|card|phone|number|secret)>", new)) <= len(plain_spans(text)) + len(re.findall("[0-9]{1,}", text))
        assert set(after) == kept, name
        if name != "personal data":
            assert all(after[doc_id] == before[doc_id] for doc_id in after)
        sizes.append(len(after))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0
    name, stage = corpus_pipeline.STAGES[-1]
    check_packing(stage(spark, docs, SF_DIR).collect(), {row.doc_id: row.text for row in docs.collect()})


def test_run_packs_every_kept_document(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len({row.doc_id for row in rows}) > 100
    assert {"sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_take_awkward_repeated_and_no_rows_and_any_column_names(spark):
    story = " ".join(f"word{at}" for at in range(120))
    rows = [(at, text) for at, text in enumerate(AWKWARD)] + [(None, story), (None, None), (3, story + " end"), (3, "short"), (3, "short")]
    rows += [(70, story.upper() + f" last{at}") for at in range(3)] + [(71, story + " mail me: someone@example.org or 10.1.2.3")]
    names = ["copy_id", "bad_id", "hash", "before", "rank", "nth", "bucket", "digest", "text_md5", "group_size", "keep_id", "label", "host"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", *[f"1 AS {name}" for name in names]
    )
    for given in (docs, docs.limit(0), docs.drop("n_chars")):
        left = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stored(stage(spark, left, ""), "stage")
            assert left.columns == given.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, left, "").collect()
        texts = [row.text for row in left.collect()]
        if given.isEmpty():
            assert texts == [] and packed == []
            continue
        assert "short" not in texts and "" not in texts and None not in texts
        # one of the near copies, and the row without an id, which is a copy of none
        assert sum(text.lower().startswith(story) for text in texts) == 2
        assert {row.doc_id for row in packed} == {row.doc_id for row in left.collect()}


def test_packing_keeps_columns_of_any_name(spark):
    rows = [(at, 0, 5 + at, 1, 2, 3, 4, 5) for at in range(9)]
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint, hash int, before int, rank int, n int, bucket int")
    packed = packing.pack(pieces, 16)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    assert {tuple(row)[:8] for row in packed.collect()} == set(rows)


def test_redaction_learns_from_every_candidate_it_is_given(spark, monkeypatch):
    """More than one sample held, however the rows are split; and the models are those of the operator alone."""
    texts = [" ".join(f"row{at}x{k}-{'abcde'[k % 5] * (1 + at % 7)}" for k in range(20)) for at in range(300)]
    texts += [f"password={'k7Q' * (3 + at % 5)} or call +1 (202) 555-{at:04d}" for at in range(50)] + ["no digits", None]
    labels = [one[4] for text in texts if text for one in personal_data.candidates(text, personal_data.base_spans(text)) if one[0] == "secret"]
    assert labels.count(False) > 4_000
    made = personal_data.generated("secret")[1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    trained, train = [], personal_data.train

    def watched(found):
        read = {row.label: row.n for row in personal_data.cells(found).filter("kind = 'secret'").groupBy("label").agg(F.sum("n").alias("n")).collect()}
        trained.append((read, train(found)))
        return trained[-1][1]

    monkeypatch.setattr(personal_data, "ROUNDS", 3)
    monkeypatch.setattr(personal_data, "train", watched)
    stages = dict(corpus_pipeline.STAGES)
    for parts in (1, 5):
        stages["personal data"](spark, docs.repartition(parts), SF_DIR).collect()
    personal_data.found(docs).collect()
    for read, models in trained:
        assert read == {label: labels.count(label) + made.count(label) for label in (False, True)}
        for kind, (trees, least) in models.items():
            assert least == trained[0][1][kind][1] and all(map(np.array_equal, trees, trained[0][1][kind][0]))


def test_every_candidate_trains_trees_and_sets_thresholds(spark, monkeypatch):
    """Of the candidates that the redaction stage is given, none is kept out of the trees, and none out of the thresholds."""
    texts = [" ".join(f"row{at}x{k}-{'abcde'[k % 5] * (1 + at % 7)}" for k in range(20)) for at in range(100)]
    texts += [f"password={'k7Q' * (3 + at % 5)} or call +1 (202) 555-{at:04d} on page {at}-{at:07d}" for at in range(50)]
    every = [one for text in texts for one in personal_data.candidates(text, personal_data.base_spans(text))]
    right = {}
    for kind in personal_data.ADDED:
        labels = [one[4] for one in every if one[0] == kind] + personal_data.generated(kind)[1]
        right[kind] = labels.count(False), labels.count(True)
    trained, calibrated, boosted, threshold = [], [], personal_data.boosted, personal_data.threshold

    def grown(ask, counts, grid):
        trained.append(counts)
        return boosted(ask, counts, grid)

    def weighed(scores, y, weights):
        calibrated.append((float(weights[y == 0].sum()), float(weights[y == 1].sum())))
        return threshold(scores, y, weights)

    monkeypatch.setattr(personal_data, "ROUNDS", 3)
    monkeypatch.setattr(personal_data, "boosted", grown)
    monkeypatch.setattr(personal_data, "threshold", weighed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert dict(corpus_pipeline.STAGES)["personal data"](spark, docs, SF_DIR).count() == len(texts)
    for at, kind in enumerate(personal_data.ADDED):
        assert tuple(sum(counts[kind][label] for counts in trained) for label in (0, 1)) == right[kind]
        assert tuple(map(sum, zip(*calibrated[at :: len(personal_data.ADDED)]))) == right[kind]
        # what the one half's trees have not seen is what they are calibrated by
        for counts, unseen in zip(trained, calibrated[at :: len(personal_data.ADDED)]):
            assert tuple(map(sum, zip(counts[kind], unseen))) == right[kind]


def test_redaction_scores_by_the_mean_of_both_halves(spark, monkeypatch):
    """Trees of either half, as numpy grows them from that half's candidates alone."""
    texts = [" ".join(f"row{at}x{k}-{'abcde'[k % 5] * (1 + at % 7)}" for k in range(20)) + f" secret: {'k7Q' * (3 + at % 5)}" for at in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(personal_data, "ROUNDS", 3)
    found = stored(personal_data.searched(docs), "searched")
    rows = found.select("doc_id", F.explode("more").alias("one")).select("doc_id", "one.*").filter("kind = 'secret' AND label IS NOT NULL")
    rows = rows.withColumn("half", F.xxhash64("doc_id", "start", "end", "kind").bitwiseAND(1)).collect()
    made = list(zip(*personal_data.generated("secret")))
    x = np.array([row.features for row in rows] + [values for values, _ in made])
    y = np.array([row.label for row in rows] + [label for _, label in made], float)
    half = np.array([row.half for row in rows] + [at // 4 % 2 for at in range(len(made))])
    scores = [personal_data.score(personal_data.boost(x[half == own], y[half == own], personal_data.GRID), x) for own in (0, 1)]
    steps = [np.floor(own * personal_data.SCORE_UNIT) / personal_data.SCORE_UNIT for own in scores]
    least = [personal_data.threshold(steps[own][half != own], y[half != own]) for own in (0, 1)]
    for most in (personal_data.CELLS_AT_HAND, 0):
        monkeypatch.setattr(personal_data, "CELLS_AT_HAND", most)
        trees, mean = personal_data.cross_trained(found)["secret"]
        assert np.allclose(personal_data.score(trees, x), (scores[0] + scores[1]) / 2)
        assert mean == sum(least) / 2
