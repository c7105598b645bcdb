"""BPE encoding and decoding of whole texts with a tokenizers file, exact also for very long texts.

Texts of ordinary length are encoded as they are, word by word from memory. Longer ones are cut in
halves again and again, whatever stands at the cut; the leaves are encoded in parallel as rows of
their own, and a tree of concatenations puts them together. At each join a window of text around
it is encoded anew and grows until its ids agree with those of both sides, on tokens with the same
place: a sequence of merged tokens is right when every two neighbours are, and so it may change
from one side to the window, and from the window to the other side, within tokens on which both
agree. When a window has grown to both whole sides its own ids are the answer.

A null text counts as empty and has no ids. Rows that repeat a ``doc_id`` are encoded each; an
empty table gives no rows; other columns are ignored. The texts of special tokens become these
tokens, as in the library.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import ship, stored, text_or_empty
from earshot.llm.tokens import Remembered, chunks, pack_ids, public_path

VOCABULARY = "word_bpe_49k.json"
#: Code points; longer texts are encoded as a tree.
LEAF = 65_536
#: Rows that a worker holds as lists of words or ids.
AT_ONCE = 128
#: Tokens on either side of a join in its first window.
WINDOW = 16
#: Neighbouring tokens that must agree on either side.
AGREEING = 2


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


#: Chunks of plain words, marks and line ends, and their parts.
PLAIN = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]|[.,!?;:\n])*")
PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,!?;:]+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it shows, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(byte) if byte in shown else chr(next(hidden)) for byte in range(256)]


class WordEncoder:
    """Ids and token texts of a tokenizers file, words remembered.

    A chunk of plain Latin words and marks is cut where the library's pre-tokenizer cuts it and
    goes to its merges word by word; every other chunk passes the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        self.tokens = np.full(max(vocabulary.values()) + 1, "", dtype=object)
        self.tokens[list(vocabulary.values())] = list(vocabulary)
        self.letters = byte_letters()
        self.parts = Remembered(self._merged)
        self.chunks = Remembered(self._of_chunk)

    def _merged(self, part: str) -> bytes:
        return pack_ids([token.id for token in self.library.model.tokenize("".join(map(self.letters.__getitem__, part.encode())))])

    def _of_chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk):
            return b"".join(map(self.parts.__getitem__, PARTS.findall(chunk.lower())))
        return pack_ids(self.library.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Packed ids."""
        return b"".join(map(self.chunks.__getitem__, chunks(text)))

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """As the library's decode, which joins tokens by spaces where a file names no decoder."""
        if self.library.decoder is not None:
            return self.library.decode(list(map(int, ids)), skip_special_tokens=False)
        return " ".join(self.tokens[np.asarray(ids, dtype=np.int64)].tolist())


@functools.cache
def word_encoder(path: str | None = None) -> WordEncoder:
    return WordEncoder(path or public_path(VOCABULARY))


class Encoded(NamedTuple):
    """Ids of a stretch of text and the code points where each token starts and ends."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def encoded(encoder: WordEncoder, text: str) -> Encoded:
    found = encoder.library.encode(text, add_special_tokens=False)
    spans = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
    return Encoded(text, np.array(found.ids, dtype=np.int64), spans[:, 0], spans[:, 1])


def _agreement(side: Encoded, shift: int, window: Encoded, offset: int, last: bool) -> tuple[int, int] | None:
    """First (or last) places in ``side`` and ``window`` from which ``AGREEING`` tokens are the same.

    ``shift`` is where the side starts in the joined text and ``offset`` where the window does.
    """
    known = {
        (int(start) + shift, int(end) + shift, int(number)): at
        for at, (start, end, number) in enumerate(zip(side.starts, side.ends, side.ids))
    }
    same = [
        known.get((int(start) + offset, int(end) + offset, int(number)))
        for start, end, number in zip(window.starts, window.ends, window.ids)
    ]
    places = range(len(same) - AGREEING + 1)
    for at in reversed(places) if last else places:
        here = same[at]
        if here is not None and all(same[at + k] == here + k for k in range(1, AGREEING)):
            return here, at
    return None


def join(encoder: WordEncoder, left: Encoded, right: Encoded, window: int = WINDOW) -> Encoded:
    """The encoding of both texts together."""
    cut, text = len(left.text), left.text + right.text
    while True:
        from_start, to_end = window >= len(left.ids), window >= len(right.ids)
        begin = 0 if from_start else int(left.starts[-window])
        end = len(text) if to_end else cut + int(right.ends[window - 1])
        middle = encoded(encoder, text[begin:end])
        before = (0, 0) if from_start else _agreement(left, 0, middle, begin, last=False)
        after = (len(right.ids), len(middle.ids)) if to_end else _agreement(right, cut, middle, begin, last=True)
        if before and after and before[1] <= after[1]:
            parts = [
                [x[: before[0]], y[before[1] : after[1]] + begin * place, z[after[0] :] + cut * place]
                for place, (x, y, z) in enumerate_places(left, middle, right)
            ]
            return Encoded(text, *map(np.concatenate, parts))
        window *= 2


def enumerate_places(left: Encoded, middle: Encoded, right: Encoded):
    """Ids (place 0, never shifted), then starts and ends (place 1) of the three stretches."""
    return zip((0, 1, 1), zip(left[1:], middle[1:], right[1:]))


def joined(encoder: WordEncoder, leaves: list[Encoded]) -> Encoded:
    """A tree of joins over neighbouring stretches."""
    while len(leaves) > 1:
        pairs = [join(encoder, *leaves[at : at + 2]) for at in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[2 * len(pairs) :]
    return leaves[0]


def halves(text: str, leaf: int) -> list[str]:
    """The text cut in halves until no stretch is longer than ``leaf``."""
    if len(text) <= leaf:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], leaf) + halves(text[middle:], leaf)


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``doc_id, ids`` of every document."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_or_empty().alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in few_rows(batches):
            packed = [encoder.encode(text) for text in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *(len(ids) // 4 for ids in packed)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row, doc_id, text in frame.itertuples(index=False):
                parts = halves(text, leaf)
                yield pd.DataFrame({"row": row, "doc_id": doc_id, "leaf": range(len(parts)), "text": parts})

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(path)
        for frame in frames:
            found = [encoded(encoder, text) for text in frame["text"]]
            for name in ("ids", "starts", "ends"):
                frame[name] = [getattr(x, name) for x in found]
            yield frame

    def tree(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("leaf")
        parts = [Encoded(*row) for row in frame[["text", "ids", "starts", "ends"]].itertuples(index=False)]
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[:1], "ids": [joined(word_encoder(path), parts).ids]})

    short = texts.filter(F.length("text") <= leaf).mapInArrow(whole, f"doc_id {kind}, ids array<int>")
    long = stored(texts.filter(F.length("text") > leaf).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    spans = "row bigint, doc_id {0}, leaf int, text string".format(kind)
    of_leaves = (
        long.select("row", "doc_id", "text")
        .mapInPandas(cut, spans)
        .repartition("row", "leaf")
        .mapInPandas(leaves, f"{spans}, ids array<bigint>, starts array<bigint>, ends array<bigint>")
    )
    return short.unionByName(of_leaves.groupBy("row").applyInPandas(tree, f"doc_id {kind}, ids array<int>"))


def decode(encoded_docs: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded_docs`` with the text that ``ids`` stand for as ``decoded``; special tokens are kept."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in few_rows(batches):
            found = [encoder.decode(ids.values.to_numpy()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["doc_id", "ids", "decoded"])

    ship(encoded_docs.sparkSession)
    kind = encoded_docs.schema["doc_id"].dataType.simpleString()
    return encoded_docs.select("doc_id", "ids").mapInArrow(texts, f"doc_id {kind}, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """Number of tokens, and digests of the ids in decimal and of the decoded text."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
