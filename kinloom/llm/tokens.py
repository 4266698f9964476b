"""Problem 8: the corpus as token ids of a public byte-level tokenizer.

Texts up to ``LEAF`` characters are encoded at once.  A longer text is halved down
to such leaves; two neighbours are joined by encoding a window around their seam
again.  The window grows on either side until it ends at a place where, whatever
stands around it, the splitting pattern must break: between a letter and a
non-letter, a digit and a non-digit, or other printed text and white space.  Tokens
beyond such a place depend only on the text beyond it, so they stay.  The join is
associative; decoding concatenates the bytes of the tokens up the same tree.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

LEAF = 8192
_WINDOW = 32
#: Classes of characters whose properties have not changed since the first versions of Unicode.
_LETTER = r"A-Za-zÀ-ÖØ-öø-ÿぁ-ゖァ-ヺ一-龥"
_DIGIT = "0-9"
_SPACE = r" \t\r\n　"
_OTHER = r"!-/:-@\[-`{-~、。《-】‘-”…！（），：；？"
_BREAK = regex.compile(
    rf"(?<=[{_LETTER}])(?=[{_DIGIT}{_SPACE}{_OTHER}])|(?<=[{_DIGIT}])(?=[{_LETTER}{_SPACE}{_OTHER}])|(?<=[{_OTHER}])(?=[{_SPACE}])"
)


class Tokenizer:
    """Byte-level BPE from a rank file; ``encode`` and ``decode`` are exact inverses on text."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {i: b for b, i in ranks.items()}
        self._size = np.zeros(max(self._bytes) + 1, np.int64)
        for i, b in self._bytes.items():
            self._size[i] = len(b)

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        """Token ids of ``text``, which is taken exactly as it is."""
        return self._node(text, 0, len(text), max(2, leaf))

    def _leaf(self, text: str) -> np.ndarray:
        return np.asarray(self._encoding.encode_ordinary(text), np.int32)

    def _node(self, text: str, start: int, end: int, leaf: int) -> np.ndarray:
        if end - start <= leaf:
            return self._leaf(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._node(text, start, middle, leaf), self._node(text, middle, end, leaf))

    def _join(self, text: str, start: int, middle: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = _last_break(text, start, middle), _first_break(text, middle, end)
        keep = _tokens_of(self._size[left[::-1]], len(text[a:middle].encode()))
        skip = _tokens_of(self._size[right], len(text[middle:b].encode()))
        return np.concatenate([left[: len(left) - keep], self._leaf(text[a:b]), right[skip:]])

    def decode(self, ids) -> str:
        """Text of token ids: halves decode on their own and their bytes are put together."""
        return self._decode(list(ids)).decode()

    def _decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self._bytes.__getitem__, ids))
        half = len(ids) // 2
        return self._decode(ids[:half]) + self._decode(ids[half:])


def _last_break(text: str, start: int, middle: int) -> int:
    """The last sure break in text[start:middle], or ``start``."""
    width = _WINDOW
    while True:
        low = max(start, middle - width)
        found = None
        for m in _BREAK.finditer(text, low, middle):
            if low < m.start() < middle:
                found = m.start()
        if found is not None or low == start:
            return start if found is None else found
        width *= 2


def _first_break(text: str, middle: int, end: int) -> int:
    """The first sure break in text[middle:end], or ``end``."""
    width = _WINDOW
    while True:
        high = min(end, middle + width)
        for m in _BREAK.finditer(text, middle, high):
            if middle < m.start() < high:
                return m.start()
        if high == end:
            return end
        width *= 2


def _tokens_of(sizes: np.ndarray, size: int) -> int:
    """How many leading tokens make up exactly ``size`` bytes."""
    if not size:
        return 0
    upto = np.cumsum(sizes)
    k = int(np.searchsorted(upto, size))
    if upto[k] != size:
        raise AssertionError("a sure break must be a token boundary")
    return k + 1


@cache
def tokenizer(ranks_path: str, pattern: str) -> Tokenizer:
    """One tokenizer per worker process."""
    return Tokenizer(ranks_path, pattern)


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file ``byte_bpe_50k`` and the splitting pattern, from the installed vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(text: Column, vocabulary: tuple[str, str] | None = None) -> Column:
    """Token ids without special tokens; null and empty text give an empty list.

    Strings that look like control tokens are ordinary text.
    """
    path, pattern = vocabulary or default_vocabulary()

    def run(values: pa.Array) -> pa.Array:
        t = tokenizer(path, pattern)
        parts = [t.encode(v) if v else np.empty(0, np.int32) for v in values.to_pylist()]
        ends = np.cumsum([0, *map(len, parts)])
        flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return F.arrow_udf(run, ArrayType(IntegerType()))(text)


def count_tokens(text: Column, vocabulary: tuple[str, str] | None = None) -> Column:
    """Number of tokens; 0 for null and empty text."""
    path, pattern = vocabulary or default_vocabulary()

    def run(values: pa.Array) -> pa.Array:
        t = tokenizer(path, pattern)
        return pa.array([len(t.encode(v)) if v else 0 for v in values.to_pylist()], pa.int64())

    return F.arrow_udf(run, LongType())(text)


def decode(ids: Column, vocabulary: tuple[str, str] | None = None) -> Column:
    """Text of token ids; null stays null, an empty list gives an empty text."""
    path, pattern = vocabulary or default_vocabulary()

    def run(values: pa.Array) -> pa.Array:
        t = tokenizer(path, pattern)
        return pa.array([None if v is None else t.decode(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())(ids)
