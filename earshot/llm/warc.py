"""WARC archives as a Spark data source (``format("warc")``): write records, read them back.

Writing: each task writes gzip archives, one member per record, and starts a new file when one has
reached ``file_bytes``. A member carries its own length in the ``sl`` extra field. Files count only
once the job's manifest names them, so attempts that failed or ran twice leave nothing behind.

Reading: one partition per file, or per group of small ones. Predicates on record type and headers
are pushed down (set ``spark.sql.python.filterPushdown.enabled``). Headers are inflated first; the
payload of a record that a predicate excludes is skipped by the member's length, or inflated
without being kept if the archive doesn't give lengths. Option ``payload`` ``false`` leaves all
payloads undecoded. Archives are read and written through ``pyarrow.fs``, so a path may be in any
store that it knows.

Revisits: of records with equal payloads of at least ``least_bytes``, the one with the largest id
is the response and the others revisit it, without a payload of their own; the HTTP header that
they keep tells its length. A null payload is empty. Rows that repeat an id and a payload are
all responses (or all revisits) alike; a null id is a response. Line ends in a URI are
percent-encoded, and a null URI leaves its header out. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from earshot.llm.common import narrow, ship, stored
from earshot.session import shared_folder

VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
#: Column and the header it comes from.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
SCHEMA = ", ".join(f"{name} string" for name in HEADERS) + ", payload_bytes bigint, intact boolean, payload binary"
ARROW = pa.schema(
    [(name, pa.string()) for name in HEADERS]
    + [("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())]
)
#: A reader hands over records when it holds this much payload.
BATCH_BYTES = 8 << 20
CHUNK = 1 << 16


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _in_store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(values: dict) -> bytes:
    """The bytes of a record: headers, HTTP header, payload unless it is a revisit."""
    payload = values.get("payload") or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if values["record_type"] == "revisit" else http + payload
    own = {**values, "payload_digest": f"sha1:{base32_sha1(payload)}"}
    own["date"] = own.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = [f"{header}: {_one_line(own[name])}" for name, header in HEADERS.items() if own.get(name) is not None]
    if values["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member that tells its compressed and plain length (extra field ``sl``)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    length = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, length, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


class Names(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("file_bytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Names:
        store, folder = _in_store(self.path)
        store.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            columns = batch.schema.names
            for at in range(batch.num_rows):
                data = member(record({name: batch.column(k)[at].as_py() for k, name in enumerate(columns)}))
                if out is None or size > self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Names(names)

    def commit(self, messages: list[Names | None]) -> None:
        store, folder = _in_store(self.path)
        store.create_dir(folder, recursive=True)
        names = [name for message in messages if message for name in message.names]
        if not self.overwrite and store.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            with store.open_input_stream(f"{folder}/{MANIFEST}") as before:
                names = json.loads(before.read()) + names
        with store.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Names | None]) -> None:
        store, folder = _in_store(self.path)
        for name in (name for message in messages if message for name in message.names):
            store.delete_file(f"{folder}/{name}")


class Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(None)
        self.files = files


class Archive:
    """Records of one archive, read forwards, with headers before anything else."""

    def __init__(self, stream):
        self.stream, self.buffer, self.at, self.begins = stream, b"", 0, 0

    def _more(self) -> bool:
        data = self.stream.read(CHUNK)
        self.buffer, self.begins, self.at = self.buffer[self.at :] + data, self.begins + self.at, 0
        return bool(data)

    def _need(self, count: int) -> bytes:
        while len(self.buffer) - self.at < count and self._more():
            pass
        return self.buffer[self.at : self.at + count]

    def skip_to(self, place: int) -> None:
        """Go on at a place of the file, over bytes that are not read."""
        if place - self.begins <= len(self.buffer):
            self.at = place - self.begins
        else:
            self.stream.seek(place)
            self.buffer, self.at, self.begins = b"", 0, place

    def _plain(self):
        """Pieces of an uncompressed archive."""
        while self._need(1):
            piece, self.at = self.buffer[self.at :], len(self.buffer)
            yield piece

    def _length(self) -> int | None:
        """The member's length, if its header tells."""
        head = self._need(12)
        if len(head) < 12 or not head[3] & 4:
            return None
        extra = self._need(12 + struct.unpack("<H", head[10:])[0])[12:]
        while len(extra) >= 4:
            size = struct.unpack("<H", extra[2:4])[0]
            if extra[:2] == b"sl" and size == 8:
                return struct.unpack("<I", extra[4:8])[0]
            extra = extra[4 + size :]
        return None

    def _inflated(self):
        """Pieces of one gzip member, stopping behind it."""
        unpack = zlib.decompressobj(zlib.MAX_WBITS | 16)
        while not unpack.eof:
            given = self._need(1) and self.buffer[self.at :]
            # a small bite first, so that little is inflated before the headers are known
            piece = unpack.decompress(given, 2048 if self.first else CHUNK)
            self.first = False
            self.at = len(self.buffer) - len(unpack.unused_data or unpack.unconsumed_tail)
            if not given and not piece:
                return
            yield piece

    def records(self, wanted) -> Iterator[tuple[dict, bytes | None]]:
        """Headers, and the block of each record for which ``wanted(headers)`` holds.

        ``wanted`` answers ``None`` to leave the record out, ``False`` to leave its block out.
        """
        if self._need(2) != b"\x1f\x8b":
            yield from self._records_of(self._plain(), wanted)
            return
        while self._need(2) == b"\x1f\x8b":
            place, length, self.first = self.begins + self.at, self._length(), True
            for headers, block in self._records_of(self._inflated(), wanted, known=length is not None):
                if headers is not None:
                    yield headers, block
            if length is not None:
                self.skip_to(place + length)

    @staticmethod
    def _records_of(pieces: Iterator[bytes], wanted, known: bool = False) -> Iterator[tuple[dict, bytes | None]]:
        """``known``: the rest need not be inflated to find the next record."""
        have = b""
        for piece in pieces:
            have = (have + piece).lstrip(b"\r\n")
            while have.startswith(b"WARC/") and (end := have.find(b"\r\n\r\n")) >= 0:
                lines = have[:end].decode("utf-8", "replace").strip().split("\r\n")[1:]
                headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
                size = int(headers.get("content-length", 0))
                keep = wanted(headers)
                if not keep and known:
                    yield (headers if keep is not None else None), None
                    return
                have = have[end + 4 :]
                parts, got = [have], len(have)
                while got < size + 4 and (piece := next(pieces, None)) is not None:
                    got += len(piece)
                    parts = [*parts, piece] if keep else [piece[-(got - size) :] if got > size else b""]
                rest = b"".join(parts)
                block = rest[:size] if keep else None
                have = rest[len(rest) - (got - size) :].lstrip(b"\r\n") if got > size else b""
                if keep is not None:
                    yield headers, block


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 16 << 20))
        self.equal: dict[str, set] = {}
        self.prefixes: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]):
        for one in filters:
            column = getattr(one, "attribute", ("",))[0]
            if column in HEADERS and isinstance(one, (EqualTo, In)):
                values = {one.value} if isinstance(one, EqualTo) else set(one.value) - {None}  # no header equals null
                self.equal[column] = self.equal.get(column, values) & values
            elif column in HEADERS and isinstance(one, StringStartsWith):
                self.prefixes.append((column, one.value))
            else:
                yield one

    def partitions(self) -> list[Files]:
        store, folder = _in_store(self.path)
        found = {
            info.base_name: info for info in store.get_file_info(fs.FileSelector(folder)) if info.type == fs.FileType.File
        }
        if MANIFEST in found:
            with store.open_input_stream(found[MANIFEST].path) as named:
                chosen = [found[name] for name in json.loads(named.read())]
        else:
            chosen = [info for name, info in sorted(found.items()) if name.endswith((".warc", ".warc.gz"))]
        groups, size = [[]], 0
        for info in chosen:
            if groups[-1] and size + info.size > self.partition_bytes:
                groups, size = [*groups, []], 0
            groups[-1].append(info.path)
            size += info.size
        return [Files(group) for group in groups]

    def _values(self, headers: dict) -> dict:
        return {name: headers.get(header.lower()) for name, header in HEADERS.items()}

    def _wanted(self, headers: dict) -> bool | None:
        values = self._values(headers)
        if any(values[name] not in allowed for name, allowed in self.equal.items()):
            return None
        if any(values[name] is None or not values[name].startswith(prefix) for name, prefix in self.prefixes):
            return None
        return self.payload or values["record_type"] == "revisit"

    def _row(self, headers: dict, block: bytes | None) -> dict:
        row = {**self._values(headers), "payload_bytes": None, "intact": None, "payload": None}
        if block is None:
            return row
        if "application/http" in headers.get("content-type", ""):
            http, _, payload = block.partition(b"\r\n\r\n")
            told = [line for line in http.decode("latin-1").lower().split("\r\n") if line.startswith("content-length:")]
        else:
            payload, told = block, []
        if row["record_type"] == "revisit":
            return row | {"payload_bytes": int(told[0].split(":")[1]) if told else None}
        digest = row["payload_digest"]
        algorithm, _, value = (digest or "").rpartition(":")
        known = digest is not None and algorithm.lower() in ("", "sha1")
        matches = value.upper() == base32_sha1(payload) if known else None
        return row | {"payload_bytes": len(payload), "intact": matches, "payload": payload}

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _in_store(self.path)
        rows, size = [], 0
        for file in partition.files:
            with store.open_input_file(file) as stream:
                for headers, block in Archive(stream).records(self._wanted):
                    rows.append(self._row(headers, block))
                    size += 500 + len(block or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; ``path`` is a folder."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``id, target_uri, payload`` with ``record_type`` and ``refers_to`` (an id).

    Only digests are shuffled; payloads meet the groups of equal ones, which a join of bare
    exchanges splits when one group is very large.
    """
    payload = F.coalesce("payload", F.lit(b""))
    marked = records.select("id", "target_uri", payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    large = F.octet_length("payload") >= least_bytes
    groups = (
        marked.filter(large).groupBy("digest").agg(F.max("id").alias("latest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    again = large & (F.col("id") < F.col("latest"))
    return marked.join(narrow(stored(groups, "equal-payloads")), "digest", "left").select(
        "id",
        "target_uri",
        "payload",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("latest")).alias("refers_to"),
    )


def write(records: DataFrame, path: str, file_bytes: int = 64 << 20) -> None:
    """Archive ``id, target_uri, payload, record_type, refers_to`` into a folder."""
    register(records.sparkSession)

    def urn(name: str):
        return F.when(F.col(name).isNotNull(), F.format_string("<urn:record:%s>", F.col(name).cast("string")))

    records.select(
        F.coalesce(urn("id"), F.lit("<urn:record:>")).alias("record_id"),
        "record_type",
        "target_uri",
        F.lit(None).cast("string").alias("date"),
        urn("refers_to").alias("refers_to"),
        "payload",
    ).write.format("warc").mode("overwrite").option("path", path).option("file_bytes", file_bytes).save()


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a folder of archives; see ``SCHEMA``."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archived(pages: DataFrame) -> DataFrame:
    """Pages through archives and back: identifiers, types, sizes and digests of the records."""
    path = shared_folder(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType
    records = pages.select(F.col("page_id").alias("id"), F.col("url").alias("target_uri"), F.encode("html", "UTF-8").alias("payload"))
    write(with_revisits(records), path)

    def number(column: str):
        return F.nullif(F.regexp_extract(column, "^<urn:record:(.*)>$", 1), F.lit("")).cast(kind)

    return read(pages.sparkSession, path).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        "intact",
    )
