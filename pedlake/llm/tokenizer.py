"""Encoding of a corpus with a public byte-level BPE vocabulary, by dynamic programming over prefixes.

For every byte prefix of a piece there is exactly one token that can end its BPE encoding: the token t
whose forerunner u, the last token of the prefix before it, stays apart from t (the merges turn the
bytes of u and t into just u and t). Storing that last token per prefix gives the whole encoding by
walking back, lets bytes be appended exactly, and confines an edit to its neighbourhood.

Scale: a narrow map over Arrow batches, no shuffle unless a table has fewer splits than cores. The
vocabulary file (under 1 MB, of fixed size) is broadcast as bytes; pieces and token pairs are cached
per worker in dictionaries that are emptied at a fixed size.

Cases: null and empty texts have an empty list; white space is text; strings of special tokens are
ordinary text; ids are those of the vocabulary's ranks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from pedlake.sources.tables import spread

#: Place of the public vocabulary: a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value of the public vocabulary: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES, PAIRS = 200_000, 500_000


class Vocabulary:
    """Ranks of byte strings, and which two tokens may stand side by side."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.longest = max(map(len, self.ranks))
        self.apart: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE of a few bytes: the adjacent pair of least rank is merged until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, u: bytes, t: bytes) -> bool:
        known = self.apart.get((u, t))
        if known is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            known = self.apart[u, t] = self.merge(u + t) == [u, t]
        return known


class Prefixes:
    """The last token's length for every prefix of a piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [0]
        self.append(data)

    def _next(self, i: int) -> int:
        """Length of the token that ends the encoding of the first i bytes."""
        data, last, ranks = self.data, self.last, self.v.ranks
        for n in range(min(i, self.v.longest), 0, -1):
            t = data[i - n : i]
            if t in ranks and (n == i or self.v.stay_apart(data[i - n - last[i - n] : i - n], t)):
                return n
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Exact: prefixes that are there already keep their last token."""
        start = len(self.data)
        self.data += more
        for i in range(start + 1, len(self.data) + 1):
            self.last.append(self._next(i))

    def edit(self, begin: int, end: int, new: bytes) -> int:
        """Puts ``new`` for the bytes begin..end; the number of prefixes that were computed again.

        A last token depends on the last tokens of the ``longest`` prefixes before it only. Once so
        many in a row agree with the old ones after the edit, the rest is copied.
        """
        tail, shift = self.last[end + 1 :], len(new) - (end - begin)
        self.data = self.data[:begin] + new + self.data[end:]
        del self.last[begin + 1 :]
        alike, done = 0, 0
        for i in range(begin + 1, len(self.data) + 1):
            old = i - shift - end - 1
            if alike > 2 * self.v.longest and old >= 0:
                self.last += tail[old:]
                break
            n = self._next(i)
            self.last.append(n)
            done += 1
            alike = alike + 1 if old >= 0 and tail[old] == n else 0
        return done

    def tokens(self) -> list[bytes]:
        out, i = [], len(self.data)
        while i:
            out.append(self.data[i - self.last[i] : i])
            i -= self.last[i]
        return out[::-1]


class Encoder(dict):
    """Text to ids; as a dictionary, the ids of pieces met so far."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        super().__init__()
        self.vocabulary, self.pattern = Vocabulary(data), regex.compile(pattern)
        self.split = self.pattern.findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ranks = self.vocabulary.ranks
        ids = tuple(ranks[t] for t in Prefixes(self.vocabulary, piece.encode("utf-8", "surrogatepass")).tokens())
        if len(self) >= PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []


class EncodedText:
    """A text with its pieces and ids, which an edit or an append changes near the edit only, and exactly.

    Pieces are found from left to right, each by what stands at its start and at most two characters behind its end (blanks
    leave the last one to a word). So pieces that end before an edit stay, and once a new piece starts where an old one behind the edit did, the rest stays too.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.pieces = encoder.split(text)

    def edit(self, begin: int, end: int, new: str) -> int:
        """Puts ``new`` for the characters begin..end; the number of pieces that were split again."""
        keep, at = 0, 0
        while keep < len(self.pieces) and at + len(self.pieces[keep]) + 1 < begin:
            at += len(self.pieces[keep])
            keep += 1
        tail, place = {}, at
        for k in range(keep, len(self.pieces)):  # where old pieces behind the edit will start
            if place >= end:
                tail[place + len(new) - (end - begin)] = k
            place += len(self.pieces[k])
        self.text = self.text[:begin] + new + self.text[end:]
        fresh, rest = [], []
        for m in self.encoder.pattern.finditer(self.text, at):
            if m.start() in tail and m.start() >= begin + len(new):
                rest = self.pieces[tail[m.start()] :]
                break
            fresh.append(m.group())
        self.pieces = [*self.pieces[:keep], *fresh, *rest]
        return len(fresh)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(map(self.encoder.__getitem__, self.pieces)))


_encoders: dict[bytes, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    key = hashlib.blake2b(data, digest_size=16).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


def ship(df: DataFrame, vocabulary: str) -> Broadcast:
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row."""
    data = ship(documents, vocabulary)
    rows = spread(documents.select(key, text), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(data.value)
        for b in batches:
            ids = [e.encode(t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return rows.mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, ids array<int>")


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and n_tokens for every row."""
    data = ship(documents, vocabulary)
    rows = spread(documents.select(*keep, text), keep[0])
    types = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(data.value)
        for b in batches:
            n = [sum(len(e[p]) for p in e.split(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return rows.mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keep) + ", n_tokens long")
