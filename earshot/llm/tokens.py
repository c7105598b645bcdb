"""Encoders for whole texts that remember the words they have met.

Both tokenizers cut a text before they merge, and a single space between two other characters is
always such a cut. So a text is the concatenation of its space-separated chunks, each encoded once
and looked up afterwards. For byte-level vocabularies a whole Latin text is one call of the rank table, which
costs less than the look-ups; other texts go chunk by chunk. Texts with special tokens and chunks beyond
Latin letters go to the tokenizers library as they are.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import struct

import numpy as np

#: Chunks that one Python worker remembers, twice (about 30 MB in all).
REMEMBERED = 60_000
LONGEST_REMEMBERED = 40
DOUBLE_SPACE = re.compile(r"\s\s")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A word with marks behind it: the tokenizer cuts between them.
MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]+)")
#: Chunks for which the rank table gives the library's ids without further checks.
LATIN = re.compile("[\n -~¡-ɏ]*")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def chunks(text: str) -> list[str]:
    """The text cut at, and without, every single space between two characters that aren't spaces."""
    return LONE_SPACE.split(text) if DOUBLE_SPACE.search(text) else text.split(" ")


class Remembered(dict):
    """``make(key)`` by key, kept for short keys.

    When full, what is held becomes the elder half, from which keys that come up again return.
    """

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.elder: dict = {}

    def __missing__(self, key: str):
        value = self.elder.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.elder = dict(self)
                self.clear()
            self[key] = value
        return value


class ByteEncoder:
    """Byte-level BPE of a tokenizers file: packed ids of a text, and bytes of each id.

    ``ranks_path`` names the same vocabulary as a rank table, which encodes new words faster.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.by_rank = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.path = path
        with open(path, "rb") as file:
            self.special = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
        self.any_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        size = max(max(ranks.values()), *self.special.values(), 0) + 1
        self.byte_lengths = np.zeros(size, dtype=np.int64)
        for token, rank in ranks.items():
            self.byte_lengths[rank] = len(token)
        for token, number in self.special.items():
            self.byte_lengths[number] = len(token.encode())
        self.marks = Remembered(self._fresh)
        self.words = Remembered(self._spaced)

    @functools.cached_property
    def library(self):
        """Loaded when a text asks for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _fresh(self, chunk: str) -> bytes:
        if LATIN.fullmatch(chunk):
            return pack_ids(self.by_rank.encode_ordinary(chunk))
        return pack_ids(self.library.encode(chunk, add_special_tokens=False).ids)

    def _spaced(self, word: str) -> bytes:
        """Ids of a word with a space before it."""
        if marked := MARKED.fullmatch(word):
            return self.words[marked[1]] + self.marks[marked[2]]
        return self._fresh(" " + word)

    def encode(self, text: str) -> bytes:
        if self.any_special.search(text):
            return pack_ids(self.library.encode(text, add_special_tokens=False).ids)
        if LATIN.fullmatch(text):
            return self.by_rank.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        first, *rest = chunks(text)
        return self._fresh(first) + b"".join(map(self.words.__getitem__, rest))


@functools.cache
def byte_encoder(path: str | None = None, ranks_path: str | None = None, pattern: str | None = None) -> ByteEncoder:
    """One encoder per worker; by default the 50k byte-level vocabulary."""
    import public_tokenizers

    return ByteEncoder(
        path or public_path("byte_bpe_50k.json"),
        ranks_path or public_path("byte_bpe_50k.tiktoken"),
        pattern or public_tokenizers.PATTERN,
    )
