"""Token counts by a two-tier lookup of pre-token lengths on the map side."""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import steps_of
from .shared import chunks

#: Documents that the frequent pre-tokens are drawn from, and distinct pre-tokens that one of them gives at most. The table only saves
#: time: counts are the same whatever it holds.
SAMPLE_DOCS, SAMPLE_EACH = 1024, 256
#: Entries of the broadcast table, and code points of its longest: under 2 MB, whatever the corpus.
FREQUENT, FREQUENT_CHARS = 16_384, 24
#: Bytes of a worker's cache, about, and code points of the longest pre-token it keeps.
CACHE_BYTES, CACHE_CHARS = 96_000_000, 256
#: Texts longer than this are cut into pre-tokens block by block.
LONG, BLOCK = 4_000_000, 200_000
# fixed values: byte-level pre-tokens
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PARTS = PARTS.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")


def packed(lengths: dict[str, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as it is broadcast: keys one after the other in UTF-8, the bytes of each, its tokens."""
    keys = [k.encode() for k in lengths]
    return b"".join(keys), np.array([len(k) for k in keys], np.uint8), np.array(list(lengths.values()), np.uint8)


def unpacked(table: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    data, sizes, tokens = table
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return {data[e - s : e].decode(): n for e, s, n in zip(ends, sizes.tolist(), tokens.tolist(), strict=True)}


class Lengths(dict):
    """Tokens of each pre-token. The frequent ones are the dictionary's own entries; others come from a cache that is emptied when it
    has grown to CACHE_BYTES; what is in neither gets a negative number, its place in `new`, until learn() is called."""

    def __init__(self, library, frequent: dict[str, int]):
        super().__init__(frequent)
        self.library, self.cache, self.bytes, self.new = library, {}, 0, []

    def __missing__(self, unit: str) -> int:
        n = self.cache.get(unit)
        if n is None:
            self.new.append(unit)
            self.cache[unit] = n = -len(self.new)
        return n

    def of(self, units: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
        if self.new:
            found = np.array([len(e.ids) for e in self.library.encode_batch_fast(self.new, add_special_tokens=False)], np.int64)
            for unit, n in zip(self.new, found.tolist(), strict=True):
                if len(unit) > CACHE_CHARS:
                    del self.cache[unit]
                else:
                    self.cache[unit] = n
                    self.bytes += 4 * len(unit) + 160
            out[out < 0] = found[-1 - out[out < 0]]
            self.new = []
        if self.bytes > CACHE_BYTES:
            self.cache, self.bytes = {}, 0
        return out


class PreTokens:
    """Cuts texts as a tokenizer's library does. Code points that the library and the pattern at hand class differently, as their
    versions of Unicode differ, are found out the first time they are met; texts that hold one go to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = steps_of(spec, "pre_tokenizer", "pretokenizers")
        bytewise = len(steps) == 1 and steps[0]["type"] == "ByteLevel" and steps[0].get("use_regex") and not steps[0].get("add_prefix_space")
        added = spec.get("added_tokens", [])
        plain = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
        cuts = not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
        self.library.no_truncation()
        self.library.no_padding()
        self.simple = bool(bytewise and plain and cuts and len(added) <= 1)
        self.special = [t["content"] for t in added]
        self.whole, self.ascii = regex.compile(PARTS), re.compile(ASCII_PARTS, re.ASCII)
        self.same: set[str] = set()
        self.other: set[str] = set()

    def agree(self, char: str) -> bool:
        probe = f"a{char}1{char}!{char} {char}{char}a"
        return [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(probe)] == [m.span() for m in self.whole.finditer(probe)]

    def pattern(self, text: str):
        """What cuts the text into pre-tokens; None where only the library can."""
        if not self.simple:
            return None
        if text.isascii():
            return self.ascii
        met = set(text)
        for char in met - self.same - self.other:
            (self.same if self.agree(char) else self.other).add(char)
        return None if met & self.other else self.whole

    def blocks(self, text: str) -> Iterator[tuple[list[str], int]]:
        """Blocks of pre-tokens, and tokens beside them."""
        pattern = self.pattern(text)
        if pattern is None:
            yield [], len(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            return
        pieces = text.split(self.special[0]) if self.special else [text]
        for number, piece in enumerate(pieces):
            if len(piece) <= LONG:
                yield pattern.findall(piece), int(number > 0)
            else:
                found, beside = (m.group() for m in pattern.finditer(piece)), int(number > 0)
                while block := list(islice(found, BLOCK)):
                    yield block, beside
                    beside = 0


def sampled(docs: DataFrame, tokenizer: str) -> dict[str, int]:
    """Frequent pre-tokens of a bounded sample and how often they were met: the first rows of each partition, or of some partitions
    where there are more of them than SAMPLE_DOCS. A task stops reading when it has its share, so this costs no scan."""
    parts = max(1, docs.rdd.getNumPartitions())
    each, step = max(1, SAMPLE_DOCS // parts), -(-parts // SAMPLE_DOCS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = each if TaskContext.get().partitionId() % step == 0 else 0
        if not left:
            return
        cutter = PreTokens(tokenizer)
        for batch in batches:
            for text in batch.column(0).slice(0, left).to_pylist():
                found = Counter(u for block, _ in cutter.blocks(text or "") for u in block if len(u) <= FREQUENT_CHARS).most_common(SAMPLE_EACH)
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["unit", "n"])
            left -= min(left, batch.num_rows)
            if not left:
                return

    total: Counter = Counter()
    for unit, n in docs.mapInArrow(count, "unit string, n long").collect():
        total[unit] += n
    return total


def frequent(docs: DataFrame, tokenizer: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    library = PreTokens(tokenizer).library
    units = [u for u, _ in sorted(sampled(docs, tokenizer).items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]]
    return packed({u: len(e.ids) for u, e in zip(units, library.encode_batch_fast(units, add_special_tokens=False), strict=True) if e.ids})


_known: dict[str, tuple[str, PreTokens, Lengths]] = {}


def tools(path: str, table, name: str) -> tuple[PreTokens, Lengths]:
    """A worker's cutter and lengths, kept from task to task as long as the table, known by its name, is the same."""
    if path not in _known or _known[path][0] != name:
        cutter = PreTokens(path)
        _known[path] = name, cutter, Lengths(cutter.library, unpacked(table.value))
    return _known[path][1:]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each row: tokens as the tokenizer's library counts them, without begin,
    end or added special tokens; a special string inside a text is one token, as is the library's default.

    A table of the lengths of frequent pre-tokens (at most FREQUENT) is broadcast; a worker encodes what isn't in it once and
    remembers it within CACHE_BYTES. No pre-token is shuffled and each row is read once, besides the sample's.
    Null or empty text: no bytes and no tokens. Very long texts are counted whole, block by block; a single pre-token is held whole.
    Ties between pre-tokens and what the table or a cache holds never change a count. Repeated rows and null keys: a row each. Other columns
    play no part, whatever their names. Empty table: no rows. Tokenizers of other kinds are counted by their library alone.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent(rows.select("text"), tokenizer))
    name = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, lengths = tools(tokenizer, table, name)
        for batch, texts in chunks(batches):
            tokens, units, at = np.zeros(len(texts), np.int64), [], []
            for k, raw in enumerate(texts):
                for block, beside in cutter.blocks(raw.decode()):
                    tokens[k] += beside
                    units += block
                    at.append((k, len(block)))
                    if len(units) > 4 * BLOCK:
                        add(tokens, lengths.of(units), at)
                        units, at = [], []
            add(tokens, lengths.of(units), at)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def add(tokens: np.ndarray, found: np.ndarray, at: list[tuple[int, int]]) -> None:
    """Adds what was found to the tokens of the texts that blocks (text, units) belong to."""
    if at:
        owner, size = np.array(at, np.int64).T
        total = np.concatenate([[0], np.cumsum(found)])
        ends = np.cumsum(size)
        np.add.at(tokens, owner, total[ends] - total[ends - size])
