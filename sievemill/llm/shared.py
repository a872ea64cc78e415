"""Helpers that several operators use: lineage cuts, distributed positions, word hashing in NumPy."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..places import cut, free_name, position, shared_folder  # noqa: F401

#: Characters of text that one NumPy step holds at most, unless a single text is longer.
CHUNK = 2_000_000


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """How many partitions hold `rows` rows at about `each`, with work for every core."""
    return int(max(spark.sparkContext.defaultParallelism, -(-rows // each)))


def crc_mod(col: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo `modulus`; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


# -- words ------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 .. n-1 at least, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096), _BASE)]))
    return _powers


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts (UTF-8 bytes), A-Z lower-cased, as flat arrays.

    start, end: byte offsets in `data`; doc: index of the text; hash: 64 bits, the same everywhere;
    first: for each text, the index of its first word (one more entry closes the last).
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.data = _LOWER[raw]
        self.base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        blank = np.concatenate([[True], _SPACE[raw]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.base)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        size = self.end - self.start
        if len(size):
            at = np.concatenate([[0], np.cumsum(size)])
            letters = self.data[~blank[1:]]
            inside = np.arange(len(letters)) - np.repeat(at[:-1], size)
            each = _BYTE[letters] * powers(int(size.max()))[inside]
            self.hash = mix(np.add.reduceat(each, at[:-1]) + size.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbouring entries of h (len(h) - k + 1 of them, none if h is shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * powers(k)[k - 1 - j]
    return mix(out)


def chunks(batches: Iterator[pa.RecordBatch], text: str | int = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of the batches of about CHUNK bytes of text, with the texts as UTF-8 (null: empty). Texts become Python's a piece at a
    time, and what Arrow holds beyond its batches is given back after each, as workers outlive their tasks."""
    for batch in batches:
        column = batch.column(text).cast(pa.large_binary())
        total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy())
        start = 0
        while start < len(total):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + CHUNK, "right")))
            yield batch.slice(start, stop - start), [t or b"" for t in column.slice(start, stop - start).to_numpy(zero_copy_only=False)]
            start = stop
        del batch, column
        pa.default_memory_pool().release_unused()


# -- ids of units -----------------------------------------------------------------------------------------

#: Bytes that a worker's memo holds at most, about: some 600,000 words with their ids.
MEMO_BYTES = 160_000_000


class Memo(dict):
    """Ids of units (words, say), each worked out by `learn` once and then remembered.

    `learn` takes a list of new units and returns all their ids, and where each unit's start (one more entry closes the last).
    Beyond `limit` bytes, the units that were met most often stay, up to half of the limit; the others are learnt again when
    they come back. So the memo stays warm however many units there are, and no result depends on what it holds.
    A key's value is its number in the arrays.
    """

    def __init__(self, learn: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = MEMO_BYTES):
        super().__init__()
        self.learn, self.limit = learn, limit
        self.new: list = []
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.met, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, unit) -> int:
        self.new.append(unit)
        self[unit] = n = len(self)
        return n

    def ids(self, units: list, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, one after the other, and where each unit's start (one more entry closes the last); with `at`, of the
        units at these places of the list."""
        if self.bytes.sum() > self.limit:
            self.shrink()
        number = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
        number = number if at is None else number[at]
        if self.new:
            ids, start = self.learn(self.new)
            size = np.array([sys.getsizeof(u) for u in self.new])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.start = np.concatenate([self.start, self.start[-1] + start[1:]])
            self.bytes = np.concatenate([self.bytes, size + 4 * np.diff(start) + 160])  # an entry of the dict, a number, array cells
            self.new = []
        self.met = np.bincount(number, minlength=len(self)) + np.concatenate([self.met, np.zeros(len(self) - len(self.met), np.int64)])
        size = self.start[number + 1] - self.start[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[number] - ends[:-1], size)], ends

    def shrink(self) -> None:
        best = np.argsort(-self.met, kind="stable")
        kept = np.sort(best[: np.searchsorted(np.cumsum(self.bytes[best]), self.limit // 2)])
        units = list(self)
        self.clear()
        self.update((units[k], n) for n, k in enumerate(kept.tolist()))
        size = np.diff(self.start)[kept]
        start = np.concatenate([[0], np.cumsum(size)])
        self.flat = self.flat[np.arange(start[-1]) + np.repeat(self.start[kept] - start[:-1], size)]
        self.start, self.bytes = start, self.bytes[kept]
        self.met = self.met[kept] // 2  # what was frequent long ago fades
