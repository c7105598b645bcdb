"""Token counts of sections and fields, from one encoding of the whole text.

A document is encoded once. The byte lengths of its tokens give their places in the text, and an
interval join inside the row (two sorted lists, binary search) gives each token its section. A
token that crosses boundaries counts for the section that holds most of its bytes, and of equal
parts for the first. So the counts of a document's sections add up to its tokens, which encoding
section by section would not give.

Sections are lines, each with its line end, or fields of a record in a given order, each with the
separator behind it. A null text or field counts as empty. An empty text has one empty section with
no tokens; so has every empty field. Rows that repeat a ``doc_id`` are counted each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import ship, text_or_empty
from earshot.llm.tokens import byte_encoder


def allocate(token_ends: np.ndarray, section_ends: np.ndarray) -> np.ndarray:
    """Tokens of each section; both lists of ends ascend and close at the same place."""
    if not len(token_ends):
        return np.zeros(len(section_ends), dtype=np.int64)
    token_starts = np.concatenate([[0], token_ends[:-1]])
    section_starts = np.concatenate([[0], section_ends[:-1]])
    section = np.searchsorted(section_ends, token_starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    for at in np.flatnonzero(last > section):  # a token crosses few sections, and each is looked at for it alone
        crossed = slice(section[at], last[at] + 1)
        part = np.minimum(section_ends[crossed], token_ends[at]) - np.maximum(section_starts[crossed], token_starts[at])
        section[at] += int(np.argmax(part))
    return np.bincount(section, minlength=len(section_ends))


def line_ends(data: bytes) -> np.ndarray:
    """Byte positions at which the lines of a text end."""
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def code_points(data: bytes) -> np.ndarray:
    """Code points that begin before each byte position, 0 to the length."""
    begins = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(begins)])


def _count(texts: DataFrame, by_field: bool, tokenizer: dict[str, str]) -> DataFrame:
    """Counts for ``doc_id, text`` and, by field, ``ends`` in bytes."""
    ship(texts.sparkSession)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(**tokenizer)
        for batch in batches:
            row, section, starts, ends, tokens = [], [], [], [], []
            given = batch.column(2).to_pylist() if by_field else [None] * batch.num_rows
            for at, (text, of_fields) in enumerate(zip(batch.column(1).to_pylist(), given)):
                data = text.encode()
                ids = np.frombuffer(encoder.encode(text), dtype="<u4")
                section_ends = np.array(of_fields, dtype=np.int64) if by_field else line_ends(data)
                points = code_points(data)[section_ends]
                row.append(np.full(len(section_ends), at))
                section.append(np.arange(len(section_ends)))
                starts.append(np.concatenate([[0], points[:-1]]))
                ends.append(points)
                tokens.append(allocate(np.cumsum(encoder.byte_lengths[ids]), section_ends))
            if row:
                columns = [np.concatenate(x).astype(np.int64) for x in (row, section, starts, ends, tokens)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0])), pa.array(columns[1].astype(np.int32)), *map(pa.array, columns[2:])],
                    names=["doc_id", "section", "start", "end", "n_tokens"],
                )

    return texts.mapInArrow(count, f"doc_id {kind}, section int, start bigint, end bigint, n_tokens bigint")


def by_line(docs: DataFrame, **tokenizer: str) -> DataFrame:
    """``doc_id, section, start, end, n_tokens`` of every line; places in code points."""
    return _count(docs.select("doc_id", text_or_empty().alias("text")), False, tokenizer)


def by_field(docs: DataFrame, fields: list[str], separator: str = "\n", **tokenizer: str) -> DataFrame:
    """The same with one section per field, in order, of the fields joined by ``separator``."""
    values = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in fields]
    closed = [F.concat(value, F.lit(separator)) for value in values[:-1]] + values[-1:]
    ends = [sum((F.octet_length(part).cast("long") for part in closed[: k + 1]), F.lit(0).cast("long")) for k in range(len(closed))]
    return _count(docs.select("doc_id", F.concat(*closed).alias("text"), F.array(*ends).alias("ends")), True, tokenizer)
