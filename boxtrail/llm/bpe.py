"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until a part has at most `leaf` characters; leaves are encoded on their own and
neighbours are joined. A join re-encodes a window around the boundary that grows on either side until
it ends where the tokens outside can't change:

* between a character that isn't white space and a blank or line feed: no match of the pattern has white
  space after another character, so every encoding of every text has a token boundary there;
* inside one match without such a place (a run of thousands of letters): between two tokens whose joint
  bytes encode to just these two. A sequence of tokens in which all neighbours are like that is the
  encoding of its bytes, so the tokens outside such a window stay.

Nulls are empty texts; an empty text has no tokens. Equal rows give equal rows. Only the id and text
columns are read, so other columns of any name do no harm; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "n_tokens long, ids binary, decoded binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeCodec:
    """Encoder and decoder over the ranks of one vocabulary; leaf: characters, run: bytes of one match."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = 4096, run: int = 256):
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pattern, self.leaf, self.run = regex.compile(pattern), leaf, run
        self.spelled = {i: b for b, i in ranks.items()}

    # --- encoding -------------------------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self._flat(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        if self._last_stable(left) is None and self._first_stable(right) is None:
            return self._whole(text)
        return self._join(left, self.encode(left), right, self.encode(right))

    def _flat(self, text: str) -> np.ndarray:
        """A window of any length; long matches get the tree of their bytes."""
        if len(text) <= 4 * self.run or regex.search(rf"\S{{{self.run},}}|\s{{{self.run},}}", text) is None:
            return np.array(self.core.encode_ordinary(text), np.uint32)
        return self._whole(text)

    def _whole(self, text: str) -> np.ndarray:
        """Match by match, for texts with runs in which nothing is stable."""
        out: list[int] = []
        for m in self.pattern.finditer(text):
            out += self._piece(m[0].encode())
        return np.array(out, np.uint32)

    def _join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        i, j = self._last_stable(left) or 0, self._first_stable(right)
        tail, head = left[i:], right[: len(right) if j is None else j]
        keep_a = len(a) - len(self._flat(tail)) if i else 0
        skip_b = len(self._flat(head)) if j is not None else len(b)
        return np.concatenate((a[:keep_a], self._flat(tail + head), b[skip_b:]))

    @staticmethod
    def _first_stable(text: str) -> int | None:
        """The first place after a character that isn't white space and before a blank or line feed."""
        size = 64
        while True:
            window = text[:size]
            for i in range(1, len(window)):
                if window[i] in " \n" and not window[i - 1].isspace():
                    return i
            if size >= len(text):
                return None
            size *= 4

    @staticmethod
    def _last_stable(text: str) -> int | None:
        size = 64
        while True:
            base = max(0, len(text) - size)
            for i in range(len(text) - 1, base, -1):
                if text[i] in " \n" and not text[i - 1].isspace():
                    return i
            if not base:
                return None
            size *= 4

    def _piece(self, piece: bytes) -> list[int]:
        """The tokens of one match of the pattern."""
        if len(piece) <= self.run:
            return self.core.encode_single_piece(piece)
        middle = len(piece) // 2
        return self._join_tokens(self._piece(piece[:middle]), self._piece(piece[middle:]))

    def _stable(self, a: int, b: int) -> bool:
        return self.core.encode_single_piece(self.spelled[a] + self.spelled[b]) == [a, b]

    def _join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        size = 2
        while True:
            i, j = min(size, len(a)), min(size, len(b))
            window = b"".join(self.spelled[t] for t in a[len(a) - i :] + b[:j])
            if len(window) > self.run and i == len(a) and j == len(b):
                return self.core.encode_single_piece(window)
            mid = self.core.encode_single_piece(window)
            if (i == len(a) or self._stable(a[-i - 1], mid[0])) and (j == len(b) or self._stable(mid[-1], b[j])):
                return a[: len(a) - i] + mid + b[j:]
            size *= 2

    # --- decoding -------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.core.decode_bytes(ids.tolist())
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 4096) -> DataFrame:
    """A row for each row of docs: id, n_tokens, ids (little-endian unsigned 32-bit) and decoded (the bytes that
    decoding those ids gives). The rank file is read on the driver and broadcast: its size is the vocabulary's."""
    ranks = docs.sparkSession.sparkContext.broadcast((load_ranks(ranks_path), pattern))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(*ranks.value, leaf=leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([codec.decode(x) for x in ids], pa.binary())],
                    [id_col, "n_tokens", "ids", "decoded"],
                )

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
