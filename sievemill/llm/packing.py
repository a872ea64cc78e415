"""Sequence packing by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import bisect
import heapq
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Memo, chunks, cut, tasks

END_ID = 1
#: The share of windows that may be added so that pieces fit whole; beyond it, what still doesn't fit is cut.
SLACK = 0.01
#: New words that are tokenized as one text, and the word between them.
AT_ONCE, BORDER = 100, "\0"
#: Bytes of words and ids that a worker remembers. Beside it, the worker holds the library twice (some 60 MB); it keeps both while it
#: waits for tasks, when the executor's memory is the JVM's.
WORD_BYTES = 64_000_000
#: Letters, digits and marks that NFC leaves alone, whose classes all versions of Unicode agree on, also in lower case.
SIMPLE = r"[!-~\u00a1-\u012f\u0131-\u024f]+"


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """The items' indexes in `ways` sets of near-equal sums (largest differencing method).

    A partial partition is its non-empty sets, largest sum first. The two partitions with the greatest imbalance (largest
    less smallest sum) are merged time and again, the one's largest sets with the other's smallest.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        alone = max(0, ways - len(b))  # so many of a's sets meet empty sets of b
        sets = a[:alone]
        meet = len(a) - len(sets)
        sets += [(x + y, m + n) for (x, m), (y, n) in zip(a[alone:], reversed(b[len(b) - meet :]), strict=True)] if meet else []
        sets += b[: len(b) - meet]
        sets.sort(key=lambda s: -s[0])
        heapq.heappush(heap, (-(sets[0][0] - (sets[-1][0] if len(sets) == ways else 0)), made, sets))
        made += 1
    return [m for _, m in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of at most `capacity`: lists of (item, start, length).

    Differencing gives sets of near-equal sums; there is a set more whenever one exceeds the capacity, as long as SLACK allows.
    After that, the excess of a set is cut off from its largest item, and the cut-off ends fill the room that other sets have.
    """
    total = sum(sizes)
    ways, most = -(-total // capacity), int(total * (1 + SLACK)) // capacity
    sets = difference(sizes, ways)
    while ways < most and any(sum(sizes[i] for i in s) > capacity for s in sets):
        ways += 1
        sets = difference(sizes, ways)
    out = [[(i, 0, sizes[i]) for i in s] for s in sets]
    out += [[] for _ in range(ways - len(sets))]
    ends, room = [], []  # (length, item, start) of what is cut off; (room, window)
    for n, parts in enumerate(out):
        over = sum(p[2] for p in parts) - capacity
        while over > 0:
            k = max(range(len(parts)), key=lambda k: parts[k][2])
            i, start, length = parts[k]
            taken = min(over, length)
            ends.append((taken, i, start + length - taken))
            parts[k] = (i, start, length - taken)
            over -= taken
        out[n] = [p for p in parts if p[2]]
        if over < 0:
            room.append((-over, n))
    room.sort()
    for length, i, start in sorted(ends, reverse=True):
        while length:
            k = min(bisect.bisect_left(room, (length, -1)), len(room) - 1)  # the least room for all of it, or the most there is
            free, n = room.pop(k)
            taken = min(length, free)
            out[n].append((i, start, taken))
            start, length = start + taken, length - taken
            if free > taken:
                bisect.insort(room, (free - taken, n))
    return [w for w in out if w]


class Tokenizer:
    """ids of texts. Where the tokenizer drops white space and lets no token cross it, as its file says, words between ASCII white
    space are tokenized once and remembered, which equals tokenizing whole texts; otherwise whole texts are tokenized."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_words = splits_at_space(spec)
        self.lower = self.by_words and any(n["type"] == "Lowercase" for n in steps_of(spec, "normalizer", "normalizers"))
        self.memo = Memo(self.learn, WORD_BYTES)
        self.wide = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        border = self.library.encode(BORDER, add_special_tokens=False)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        own = [t.removesuffix(suffix) for t in border.tokens] in ([BORDER], ["Ā"])  # itself, or as byte-level vocabularies spell it
        self.border = border.ids[0] if own else None
        self.special = "|".join(re.escape(t["content"]) for t in spec.get("added_tokens", []))  # found before anything else, in their own case
        self.parts = parts_of(spec) if own else None
        if self.parts:
            self.simple = re.compile(f"(?!.*(?i:{self.special})){SIMPLE}" if self.special else SIMPLE)
            later = steps_of(spec, "pre_tokenizer", "pretokenizers")[1:]
            self.quick = Library.from_str(json.dumps(spec | {
                "normalizer": {"type": "Lowercase"} if self.lower else None,
                "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *later]},
            }))

    def ids_of(self, texts: list[str], library=None) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.int64) for e in (library or self.library).encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate([[0], np.cumsum([len(i) for i in found], dtype=np.int64)])

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new words. Words of simple characters are cut at the tokenizer's own pattern here, so that the library need not
        normalise and match them; the others go to it as they are."""
        texts = [w.decode() for w in words]
        if not self.parts:
            return self.jointly(texts)
        simple = np.fromiter((self.simple.fullmatch(t) is not None for t in texts), bool, len(texts))
        return woven(simple, lambda side: self.jointly([t for t, s in zip(texts, simple.tolist(), strict=True) if s == side], side))

    def jointly(self, words: list[str], simple: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Many words are tokenized as one text, with BORDER as a word between them, since a call for each costs more than its tokens."""
        if self.border is None or not simple and any(BORDER in w for w in words):
            return self.ids_of(words)
        joined = [f" {BORDER} ".join([*words[k : k + AT_ONCE], ""]) for k in range(0, len(words), AT_ONCE)]
        ids, _ = self.ids_of([" ".join(self.parts.findall(j)) for j in joined], self.quick) if simple else self.ids_of(joined)
        ends = np.flatnonzero(ids == self.border)
        return np.delete(ids, ends), np.concatenate([[0], ends - np.arange(len(ends))])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with END_ID after each text, and where each text starts (one more entry closes the last)."""
        if self.by_words:
            whole = pa.array(texts, pa.large_binary()).cast(pa.large_string())
            odd = pc.match_substring_regex(whole, self.special, ignore_case=True).to_numpy(zero_copy_only=False) if self.special else np.zeros(len(texts), bool)
            ids, ends = woven(odd, lambda side: self.ids_of(whole.filter(pa.array(odd)).to_pylist()) if side else self.of_words(whole.filter(pa.array(~odd))))
        else:
            ids, ends = self.ids_of([t.decode() for t in texts])
        first = ends + np.arange(len(ends))
        out = np.full(first[-1], END_ID, np.uint32)
        own = np.ones(len(out), bool)
        own[first[1:] - 1] = False
        out[own] = ids
        return out, first

    def of_words(self, whole: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts by their words, of which each is looked up once."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(whole) if self.lower else whole)  # A-Z alone: lower case comes first in any case
        flat = words.flatten()
        real = pc.binary_length(flat).to_numpy() > 0
        counts = np.concatenate([[0], np.cumsum(real)])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        known = (flat if real.all() else flat.filter(pa.array(real))).dictionary_encode()
        ids, ends = self.memo.ids(known.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), known.indices.to_numpy())
        return ids, ends[counts]


def woven(mask: np.ndarray, found: Callable[[bool], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units of two kinds in the units' order, and where each unit's start: found(True) has those of the mask, found(False)
    the others'."""
    if not mask.any() or mask.all():
        return found(bool(mask.any()))
    sides, size = {side: found(side) for side in (False, True)}, np.zeros(len(mask), np.int64)
    for side, (_, start) in sides.items():
        size[mask == side] = np.diff(start)
    owner = np.repeat(mask, size)
    ids = np.zeros(len(owner), np.int64)
    for side, (own, _) in sides.items():
        ids[owner == side] = own
    return ids, np.concatenate([[0], np.cumsum(size)])


def splits_at_space(spec: dict) -> bool:
    """Whether a tokenizer's file says that white space is dropped and parts words before anything else: its first pre-tokenizer
    removes what no word pattern matches, and the patterns are of letters, digits and what is neither these nor white space."""
    first = (steps_of(spec, "pre_tokenizer", "pretokenizers") or [{}])[0]
    pattern = first.get("pattern", {}).get("Regex", "") if first.get("type") == "Split" else ""
    apart = all(re.fullmatch(r"'\w+|\[(?:\\p\{\w+\})+\]\+?|\[\^\\s(?:\\p\{\w+\})*\]\+?", part) for part in pattern.split("|"))
    dropped = bool(pattern) and apart and first.get("behavior") == "Removed" and first.get("invert") is True
    # steps that work on characters, wherever they stand; white space stays white space
    calm = {"NFC", "NFKC", "NFD", "NFKD", "Lowercase", "StripAccents"}
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    return (dropped or first.get("type") in ("Whitespace", "WhitespaceSplit")) and all(n["type"] in calm or n == spaces for n in steps_of(spec, "normalizer", "normalizers"))


def parts_of(spec: dict) -> regex.Pattern | None:
    """The pattern of the words' parts, where a tokenizer's file has one and nothing but NFC and lower case comes before it."""
    first = (steps_of(spec, "pre_tokenizer", "pretokenizers") or [{}])[0]
    calm = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" for n in steps_of(spec, "normalizer", "normalizers"))
    if not splits_at_space(spec) or first["type"] != "Split" or not calm:
        return None
    pattern = regex.compile(first["pattern"]["Regex"])
    return None if pattern.groups else pattern


def steps_of(spec: dict, part: str, inner: str) -> list[dict]:
    """The steps of a part of a tokenizer's file, which may be one alone or a sequence."""
    found = spec.get(part)
    return [] if found is None else found[inner] if found["type"] == "Sequence" else [found]


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer_of(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids of each document's whole windows and of what is left. ids (little-endian, two
    bytes each where the vocabulary allows it) is null for whole windows, which are never cut again."""
    kind = docs.schema[key].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer_of(tokenizer)
        for batch, texts in chunks(batches, "text"):
            ids, first = known.encode(texts)
            total = np.diff(first)
            many = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), many)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * capacity
            length = np.minimum(capacity, total[doc] - start)
            at = first[doc] + start
            data, narrow = ids.astype("<u4").view(np.uint8).data, ids.astype(known.wide)
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            own = [None if n == capacity else narrow[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), pa.array(total[doc]), pa.array(own, pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def place(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The pieces of a group in windows. What is cut gets the starts, lengths and checksums of its parts."""
    rows = rows.sort_values("_row", ignore_index=True)
    sizes = rows["length"].tolist()
    rest = [i for i, n in enumerate(sizes) if n < capacity]
    found = [[(i, 0, n)] for i, n in enumerate(sizes) if n == capacity]
    found += [sorted((rest[j], s, n) for j, s, n in w) for w in windows([sizes[i] for i in rest], capacity)]
    parts = np.array([(i, s, n, w) for w, members in enumerate(found) for i, s, n in members], np.int64).reshape(-1, 4)
    at, start, length, window = parts.T
    out = rows.iloc[at].reset_index(drop=True)
    crc = out["ids_crc32"].to_numpy(np.int64, copy=True)
    for k in np.flatnonzero(length < out["length"].to_numpy()).tolist():
        wide = len(out["ids"][k]) // int(out["length"][k])
        own = np.frombuffer(out["ids"][k], f"<u{wide}")[start[k] : start[k] + length[k]]
        crc[k] = zlib.crc32(own.astype("<u4").tobytes())
    ends = np.cumsum(length)
    begin = (ends - length)[np.searchsorted(window, window)]  # where each one's window begins
    out["start"] += start
    out["length"], out["ids_crc32"] = length, crc
    out["sequence_id"] = (rows["_group"].iloc[0].astype(np.int64) << 32) + window
    out["offset"] = ends - length - begin
    return out.drop(columns=["_group", "_row", "ids"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, group_bytes: int = 1 << 21, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents (their ids, then END_ID) into sequences of at most `capacity` ids with little padding.

    Each document's whole windows stand alone; what is left of it is one piece. Pieces are dealt at random into groups, one for
    each `group_bytes` of text; in each, differencing of whole pieces gives windows of near-equal fill, and only what exceeds a
    window is cut (see windows). A group is of bounded size however many rows there are, and a document's pieces may lie in several.
    Groups follow row numbers, which are drawn once the pieces are written, so a task that is run again and reads its rows in another
    order neither loses nor doubles pieces.
    Ties: of equal partitions, the one made first; of equal pieces, the one of the earlier row.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (gapless from 0).
    Null or empty text: a piece of END_ID alone. Repeated rows and null keys are packed like others. Very long texts are cut into
    windows like others. Other columns play no part. Empty table: no rows.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    dealt = cut(pieces(docs, tokenizer, capacity, key, text)).withColumn("_row", F.monotonically_increasing_id()).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    parts = tasks(docs.sparkSession, groups, 8)
    kind = docs.schema[key].dataType.simpleString()
    return dealt.repartition(parts, "_group").groupBy("_group").applyInPandas(
        lambda rows: place(rows, capacity), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
