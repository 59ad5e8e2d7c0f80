"""Byte-pair encoding of whole texts by longest matches with backtracking.

The bytes of a piece are read as Latin-1 characters, so an Aho-Corasick automaton over the vocabulary finds all tokens in
one pass. From the left the longest token is tried that is compatible with the one before it; where none is, the last
choice is taken back. Two tokens are compatible if the merges, applied to both together, give back just these two; a
sequence is the encoding of its bytes exactly if all neighbours are compatible. The answer for a pair is remembered. As
every prefix has only one encoding, a position that once led nowhere is never entered again, which makes it linear time.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the public pattern that cuts a text into pieces before the merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEPT_PIECES, KEPT_LENGTH, KEPT_PAIRS = 400_000, 48, 2_000_000


class _Pieces(dict):
    """Encodings of the pieces met so far; short ones are kept, up to a bound."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self._encode(piece)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class BytePairEncoder:
    """Encoder for a vocabulary of ranks, one ``base64 rank`` a line; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES):
        self._ranks = ranks
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._find = regex.compile(pattern).findall
        self._pairs: dict[tuple[int, int], bool] = {}
        self._automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) == 1 or self.merge(token) == [rank]:  # a token that merges never reach can't occur
                self._automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self._automaton.make_automaton()
        self._known = _Pieces(self._encode_piece)

    @classmethod
    def from_lines(cls, raw: bytes, pattern: str = PIECES) -> BytePairEncoder:
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}, pattern)

    def merge(self, raw: bytes) -> list[int]:
        """The encoding by definition: the pair of least rank is merged until none is left."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self._ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self._ranks[p] for p in parts]

    def _compatible(self, left: int, right: int) -> bool:
        if (answer := self._pairs.get((left, right))) is None:
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            answer = self._pairs[left, right] = self.merge(self._bytes[left] + self._bytes[right]) == [left, right]
        return answer

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        if (whole := self._ranks.get(raw)) is not None and (len(raw) == 1 or self.merge(raw) == [whole]):
            return (whole,)
        starting: list[list[tuple[int, int]]] = [[] for _ in raw]
        for end, token in self._automaton.iter(raw.decode("latin-1")):
            starting[end - token[1] + 1].append(token)  # shorter ones come first
        ids: list[int] = []
        untried = [len(starting[0])]  # for each token chosen and the next one: how many of its candidates are left
        places = [0]
        dead = bytearray(len(raw) + 1)
        while places[-1] < len(raw):
            at, left = places[-1], untried[-1]
            while left:
                left -= 1
                token, length = starting[at][left]
                if not dead[at + length] and (not ids or self._compatible(ids[-1], token)):
                    untried[-1] = left
                    ids.append(token)
                    places.append(at + length)
                    untried.append(len(starting[at + length]) if at + length < len(raw) else 0)
                    break
            else:
                dead[at] = 1
                places.pop()
                untried.pop()
                ids.pop()
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._known.__getitem__, self._find(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self._known.__getitem__, self._find(text))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self._bytes[i] for i in ids).decode("utf-8", "replace")


_encoders: dict[int, BytePairEncoder] = {}


def _shared(vocabulary) -> BytePairEncoder:
    """One encoder a worker process and vocabulary."""
    raw = vocabulary.value
    if (key := hash(raw)) not in _encoders:
        _encoders[key] = BytePairEncoder.from_lines(raw)
    return _encoders[key]


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast: its size is fixed (about 1 MB), so executors need no file."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def token_ids(spark: SparkSession, text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Token ids of a text column, without special tokens; their strings in a text are ordinary text.

    Null and empty texts give an empty list. Texts are encoded whole, whatever their length.
    """
    shared = _vocabulary(spark, vocabulary)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        encoder = _shared(shared)
        each = [encoder.encode(t) if t else [] for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, each)])
        flat = np.fromiter(chain.from_iterable(each), np.int32, ends[-1])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return encode(text)


def token_count(spark: SparkSession, text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Number of tokens of a text column; 0 for null and empty texts."""
    shared = _vocabulary(spark, vocabulary)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        encoder = _shared(shared)
        return pa.array([encoder.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count(text)
