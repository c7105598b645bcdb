"""Quality of whole texts, learned from labels of documents by attention over their passages.

Every passage of ``PASSAGE_WORDS`` words becomes a vector (``passages``); a network with gated
attention (``attention``) weighs the passages of a text and scores the weighted one, so that a document is
judged by the passages that tell most. Only labels of whole documents are needed.

The network is trained in one task on a sample of the labelled documents: about ``SAMPLE`` of them,
chosen by a hash of the id, up to ``SAMPLE_PASSAGES`` passages. All documents are scored in one pass; a long text is
read in pieces of 2^20 code points (words and passages end there), whose bags of passages are merged.

A null or empty text has one passage without words and is scored like any other. Labels of one
``doc_id`` are averaged, null ones left out; without any label every score is one half. Rows of
documents are scored each, repeated ones too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.attention import Bag, Network, bags, merged, scores, trained
from earshot.llm.common import ship, stored, text_or_empty
from earshot.llm.passages import FEATURES, encoded, pieces

#: Labelled documents, and their passages, to train with.
SAMPLE = 20_000
SAMPLE_PASSAGES = 200_000
#: Code points encoded at once.
AT_ONCE = 1 << 17
#: Share of the crc32 of the id that is held out: remainder 1 of 3.
FOLDS, HELD_OUT_FOLD = 3, 1


def held_out() -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name) % FOLDS == HELD_OUT_FOLD


def in_batches(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Passages, their number for each piece, and the number of pieces of the next text or texts."""
    waiting: list[str] = []
    size = 0
    for text in texts:
        if len(text) > AT_ONCE or size + len(text) > AT_ONCE:
            if waiting:
                yield *encoded(waiting), 1
            waiting, size = [], 0
        if len(text) > AT_ONCE:
            parts = pieces(text)
            for part in parts[:-1]:
                yield *encoded([part]), 0
            yield *encoded(parts[-1:]), 1
        else:
            waiting.append(text)
            size += len(text)
    if waiting:
        yield *encoded(waiting), 1


def bags_of(net: Network, texts: list[str]) -> Iterator[Bag]:
    """Bags of whole texts, in order."""
    open_bags: list[Bag] = []
    for x, counts, closed in in_batches(texts):
        found = bags(net, x, counts)
        if open_bags:
            open_bags.append(found)
            found = merged(Bag(*map(np.concatenate, zip(*open_bags))), np.array([len(open_bags)]))
            open_bags = []
        if closed:
            yield found
        else:
            open_bags = [found]


def sampled_labels(labels: DataFrame, sample: int) -> DataFrame:
    """``doc_id, label`` to learn from: about ``sample`` documents, none of them held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    known = known.withColumn("place", F.xxhash64(F.col("doc_id").cast("string")))
    share = min(1.0, sample / max(1, known.count()))
    return known.where(F.col("place").cast("double") <= (2 * share - 1) * 2.0**63)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_passages: int = SAMPLE_PASSAGES) -> Network:
    """The network learned from ``labels`` (``doc_id, quality``); of the table, only these columns are read."""
    ship(documents.sparkSession)
    chosen = F.broadcast(stored(sampled_labels(labels, sample), "quality-labels"))  # about `sample` rows of 24 bytes
    text = documents.select("doc_id", text_or_empty().alias("text")).join(chosen, "doc_id").select("place", "label", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, label, text in zip(*(column.to_pylist() for column in batch.columns)):
                parts = [x for x, _, _ in in_batches([text])]
                row = {"place": [place], "label": [label], "n": [sum(map(len, parts))], "x": [np.concatenate(parts).tobytes()]}
                yield pa.RecordBatch.from_pydict(row, pa.schema([("place", pa.int64()), ("label", pa.float64()), ("n", pa.int64()), ("x", pa.binary())]))

    seen = stored(text.mapInArrow(encode, "place bigint, label double, n bigint, x binary"), "quality-passages")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "label", "x"])
        group = group[group["n"].cumsum() <= sample_passages]
        x = np.frombuffer(b"".join(group["x"]), dtype=np.float32).reshape(-1, FEATURES)
        net = trained(x, group["n"].to_numpy(), group["label"].to_numpy())
        return pd.DataFrame({"name": net._fields, "shape": [list(part.shape) for part in net], "part": [part.ravel().tolist() for part in net]})

    schema = "name string, shape array<int>, part array<double>"
    parts = {row.name: np.array(row.part).reshape(row.shape) for row in seen.groupBy().applyInPandas(fit, schema).collect()}
    return Network(**parts) if parts else trained(np.zeros((0, FEATURES)), np.zeros(0, dtype=np.int64), np.zeros(0))


def scored(documents: DataFrame, net: Network) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, score double"
    arrow = documents.sparkSession.createDataFrame([], schema).toArrow().schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(net, bag).round(9) for bag in bags_of(net, batch.column(2).to_pylist())]
            columns = [batch.column(0), batch.column(1), pa.array(np.concatenate(found) if found else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    texts = documents.select("doc_id", held_out().alias("held_out"), text_or_empty().alias("text"))
    return texts.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
