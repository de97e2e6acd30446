"""BPE encoding and decoding by forced boundaries (operator 5).

A pair of bytes that occurs side by side inside no token of the vocabulary can
never be joined by a merge, so a piece may be cut there, the fragments encoded
one by one and the ids concatenated. Fragments recur far more often than
pieces, so their ids are kept.

Defined results: null text counts as empty text; empty text has no ids and
decodes to empty text. A text of any length is processed whole: pieces and
fragments are short-lived and the caches are bounded. Equal texts get equal
ids. Other columns pass through untouched, whatever their names; the results
go to the column that the caller names.
"""

from __future__ import annotations

import ctypes
import gc
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.llm.common import arrow_udf, col

# Fixed value: the public pre-token pattern of byte-level BPE tokenizers.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces and fragments that a worker remembers, and the longest it does. A machine has several workers, and
#: each may come to hold a coder.
KEPT, KEPT_LENGTH = 120_000, 48
#: Characters from which a text's pieces are walked instead of listed.
LONG_TEXT = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


@lru_cache(maxsize=1)
def _unassigned() -> tuple[re.Pattern, re.Pattern]:
    """Code points without a category here, which libraries of other Unicode versions may class otherwise.

    The first pattern is fast: all from the first such code point on.
    """
    parts, start = [], None
    for cp in range(0x110001):
        free = cp < 0x110000 and unicodedata.category(chr(cp)) == "Cn"
        if free and start is None:
            start = cp
        elif not free and start is not None:
            parts.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return re.compile("[" + parts[0][:10] + "-\\U0010ffff]"), re.compile("[" + "".join(parts) + "]")


def _odd(text: str, start: int = 0) -> bool:
    some, exact = _unassigned()
    return not text.isascii() and bool(some.search(text, start)) and bool(exact.search(text, start))


class ForcedCutBPE:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import models, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        before = spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer or prefix space is supported")
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens with stripping or matching options are not supported")
        self._letters = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(self._letters)}
        size = 1 + max([*model["vocab"].values(), *added.values()])
        self.table: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.table[i] = bytes(byte_of[c] for c in token)
        #: Pairs of bytes that are neighbours in some token.
        self.inside = {pair for token in self.table for pair in zip(token, token[1:])}
        for content, i in added.items():
            self.table[i] = content.encode()
        self._added = {c: struct.pack("<I", i) for c, i in added.items()}
        self._added_at = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._model = models.BPE(vocab=model["vocab"], merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], cache_capacity=0)
        self._split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.pattern = regex.compile(PIECES)
        self._pieces = _Memory(self._encode_piece)
        self._fragments = _Memory(self._encode_fragment)
        #: Tokens of each piece; no piece of ordinary text equals an added token.
        self.counts = _Memory(lambda piece: 1 if piece in self._added else len(self._encode_piece(piece)) >> 2)
        #: Characters of the longest added token.
        self.longest_added = max(map(len, added), default=0)

    def fragments(self, piece: bytes) -> list[bytes]:
        """Cut where the bytes on both sides are neighbours in no token."""
        if self.inside.issuperset(zip(piece, piece[1:])):
            return [piece]
        inside, start, out = self.inside, 0, []
        for i, pair in enumerate(zip(piece, piece[1:]), 1):
            if pair not in inside:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def _encode_fragment(self, fragment: bytes) -> bytes:
        letters = self._letters
        ids = [t.id for t in self._model.tokenize("".join([letters[b] for b in fragment]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_piece(self, piece: str) -> bytes:
        parts = self.fragments(piece.encode())
        if len(parts) == 1:
            return self._encode_fragment(parts[0])
        return b"".join(map(self._fragments.__getitem__, parts))

    def pieces(self, text: str) -> Iterator[str] | list[str]:
        """Pre-tokens of ordinary text, as the vocabulary's own pre-tokenizer cuts them."""
        if _odd(text):
            return [text[a:b] for _, (a, b) in self._split.pre_tokenize_str(text)]
        if len(text) > LONG_TEXT:
            return (m.group() for m in self.pattern.finditer(text))
        return self.pattern.findall(text)

    def pieces_from(self, text: str, start: int = 0, special: bool = False) -> Iterator[str]:
        """Pre-tokens of ``text`` from the boundary ``start`` on, found as they are asked for; with ``special``, added tokens are pieces."""
        if special and self.has_added(text):
            return self._with_added(text, start)
        return self._plain_from(text, start, len(text))

    def has_added(self, text: str) -> bool:
        return any(c in text for c in self._added)

    def _plain_from(self, text: str, start: int, end: int) -> Iterator[str]:
        if _odd(text, start):
            return iter(self.pieces(text[start:end]))
        return (m.group() for m in self.pattern.finditer(text, start, end))

    def _with_added(self, text: str, start: int) -> Iterator[str]:
        for m in self._added_at.finditer(text, start):
            yield from self._plain_from(text, start, m.start())
            yield m.group()
            start = m.end()
        yield from self._plain_from(text, start, len(text))

    def _encode_plain(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; strings of added tokens become those tokens."""
        if self.has_added(text):
            return b"".join(self._added[part] if part in self._added else self._encode_plain(part) for part in self._added_at.split(text) if part)
        return self._encode_plain(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, _unpacked(ids))).decode("utf-8", "replace")

    def count(self, pieces: list[str]) -> int:
        return sum(map(self.counts.__getitem__, pieces))


class _Memory(dict):
    """A bounded cache: forgets the older half when full, never keeps long keys."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key):
        value = self._make(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                for old in list(islice(self, (KEPT + 1) // 2)):
                    del self[old]
            self[key] = value
        return value


def _unpacked(ids: bytes) -> array:
    out = array("I")
    out.frombytes(ids)
    if struct.pack("=I", 1) != struct.pack("<I", 1):
        out.byteswap()
    return out


@lru_cache(maxsize=4)
def coder(path: str) -> ForcedCutBPE:
    """One coder per vocabulary and worker process."""
    return ForcedCutBPE(path)


def release() -> None:
    """Give a coder's memory back when a task ends: idle workers stay, and the next stage needs the room. Loading it again takes half a second."""
    coder.cache_clear()
    gc.collect()
    with suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)


def encoded(text: Column, path: str | None = None) -> Column:
    """Ids of ``text`` as binary: unsigned 32-bit little-endian integers."""
    path = path or default_vocabulary()

    @arrow_udf("binary")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coder(path)
        for part in parts:
            yield pa.array([own.encode(x or "") for x in part.to_pylist()], pa.binary())

    return encode(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """Text of ids packed by ``encoded``; special tokens are kept; null counts as no ids."""
    path = path or default_vocabulary()

    @arrow_udf("string")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coder(path)
        for part in parts:
            yield pa.array([own.decode(x or b"") for x in part.to_pylist()], pa.string())

    return decode(ids)


def encode_documents(df: DataFrame, *, text: str = "text", into: str = "token_ids", path: str | None = None) -> DataFrame:
    """``df`` and a binary column ``into`` with each whole text's ids."""
    return df.withColumn(into, encoded(col(text), path))


def decode_documents(df: DataFrame, *, ids: str = "token_ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` and a string column ``into`` with the text of ``ids``."""
    return df.withColumn(into, decoded(col(ids), path))


def round_trip(df: DataFrame, *, text: str = "text", ids: str = "token_ids", back: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the ids of each whole text and their text, by one pass through the workers."""
    path = path or default_vocabulary()

    @arrow_udf("struct<ids: binary, text: string>")
    def there_and_back(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coder(path)
        for part in parts:
            packed = pa.array([own.encode(x or "") for x in part.to_pylist()], pa.binary())
            yield pa.StructArray.from_arrays([packed, pa.array([own.decode(x.as_py()) for x in packed], pa.string())], names=["ids", "text"])
        del own
        release()

    return df.withColumn(ids, there_and_back(col(text))).withColumn(back, F.col(f"{ids}.text")).withColumn(ids, F.col(f"{ids}.ids"))
