"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import Memo, chunks

#: Code points of new units that are indexed at once.
AT_ONCE = 250_000
SPACE = "▁"
#: No code point; ends each unit in the index.
BORDER = 0x110000
#: Rows that are decoded at once.
ROWS = 1000
#: Longer units are relaxed one by one.
LONG = 64
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Model:
    """A byte-pair model: pieces with scores, bytes for what has no piece; a space before each text; no other normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, library.unk_id())
        self.byte_of: dict[int, int] = {}
        for i in range(n):
            if library.is_byte(i):
                self.byte_of[i] = int(self.pieces[i][3:5], 16)
                self.byte[self.byte_of[i]] = i
        self.silent = {i for i in range(n) if library.is_control(i)}
        self.ids = np.array([i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))])
        names = [self.pieces[i] for i in self.ids]
        self.length = np.array([len(p) for p in names])
        self.widest = int(self.length.max())
        self.letters = np.zeros((len(names), self.widest), np.int64)
        for row, name in zip(self.letters, names, strict=True):
            row[: len(name)] = list(map(ord, name))
        self.score = np.full(n + 1, -np.inf)  # the last entry is for what is no piece
        self.score[self.ids] = [library.get_score(int(i)) for i in self.ids]
        self.memo = Memo(self.learn)
        spelt = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_at = np.concatenate([[0], np.cumsum([len(p) for p in spelt])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's start (one more entry closes the last)."""
        units: list[str] = []
        counts = [0]
        for text in texts:
            if text:
                units += _UNIT.findall(SPACE + text.replace(" ", SPACE))
            counts.append(len(units))
        ids, ends = self.memo.ids(units)
        return ids, ends[np.array(counts)]

    def learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new units, about AT_ONCE code points of them at once, and where each unit's start."""
        ends = np.cumsum([len(u) + 1 for u in units])
        made, size, at = [], [], 0
        while at < len(units):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            ids, start = self.encode_units(units[at:to])
            made.append(ids)
            size.append(np.diff(start))
            at = to
        return np.concatenate(made), np.concatenate([[0], np.cumsum(np.concatenate(size))])

    def edges(self, code: np.ndarray) -> np.ndarray:
        """For each place and each length, the piece that is there (len(pieces) if none): pieces are looked up in a suffix array."""
        order = suffix_array(code, self.widest)
        padded = np.concatenate([code, np.full(self.widest, -1)])

        def bound(after: bool) -> np.ndarray:
            """For each piece, how many suffixes are before it (or: before it or begin with it)."""
            low, high = np.zeros(len(self.length), np.int64), np.full(len(self.length), len(order))
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                place, less = order[middle], np.zeros(len(open_), bool)
                undecided = np.arange(len(open_))
                for k in range(self.widest):
                    undecided = undecided[k < self.length[open_[undecided]]]
                    if not len(undecided):
                        break
                    there, asked = padded[place[undecided] + k], self.letters[open_[undecided], k]
                    less[undecided[there < asked]] = True
                    undecided = undecided[there == asked]
                    if after:  # equal as far as the piece goes: not beyond it
                        less[undecided[self.length[open_[undecided]] == k + 1]] = True
                low[open_[less]] = middle[less] + 1
                high[open_[~less]] = middle[~less]
            return low

        first, last = bound(False), bound(True)
        many = last - first
        of = np.repeat(np.arange(len(many)), many)
        place = order[np.arange(many.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many)]
        table = np.full((len(code) + 1, self.widest + 1), len(self.pieces), np.int32)
        table[place, self.length[of]] = self.ids[of]  # edges by position
        return table

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(u) for u in units])
        border = np.cumsum(size + 1) - 1
        code[border] = BORDER
        table = self.edges(code)
        of = np.repeat(np.arange(len(units)), size)
        begin = np.arange(size.sum()) + of  # each unit is followed by its border
        short = size[of] <= LONG
        segments = [relax_all(begin[short], of[short], table, self.score)]
        for u in np.flatnonzero(size > LONG):
            own = relax_one(int(border[u] - size[u]), int(border[u]), table, self.score)
            segments.append((own[:, 0], own[:, 1], np.full(len(own), u)))
        start, end, unit = (np.concatenate(c) for c in zip(*segments, strict=True))
        order = np.argsort(start, kind="stable")
        start, end, unit = start[order], end[order], unit[order]
        piece = table[start, end - start]
        lone = np.flatnonzero(piece == len(self.pieces))
        spelt = [self.byte[list(chr(code[start[k]]).encode("utf-8", "surrogatepass"))] for k in lone]
        width = np.ones(len(piece), np.int64)
        width[lone] = [len(s) for s in spelt]
        ids = np.repeat(piece, width)
        if len(lone):
            at = (np.cumsum(width) - width)[lone]
            ids[np.repeat(at, width[lone]) + np.concatenate([np.arange(len(s)) for s in spelt])] = np.concatenate(spelt)
        total = np.bincount(unit, width, minlength=len(units)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(total)])

    def decode(self, ids: np.ndarray, start: np.ndarray) -> list[str]:
        """The texts of lists of ids, which lie one after the other; start: where each begins (one more entry closes the last)."""
        at = self.spelt_at[ids]
        size = self.spelt_at[ids + 1] - at
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = self.spelt[np.arange(ends[-1]) + np.repeat(at - ends[:-1], size)].tobytes()
        border = ends[start].tolist()
        texts = [raw[a:b].decode("utf-8", "replace").replace(SPACE, " ") for a, b in zip(border, border[1:], strict=False)]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def suffix_array(code: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, by `depth` code points at least. Ranks of the first 3 are sorted first, then by doubling."""
    wide = np.concatenate([code + 1, np.zeros(2, np.int64)])
    key, known = (wide[:-2] << 42) | (wide[1:-1] << 21) | wide[2:], 3
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.zeros(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]])) if len(key) else 0
        if known >= depth:
            return order
        key = (rank << 32) | np.concatenate([rank[known:], np.zeros(min(known, len(rank)), np.int64)])
        known *= 2


def relax_all(begin: np.ndarray, of: np.ndarray, table: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and unit of the segments that remain when, in every unit, the two neighbours whose edge has the best score (the
    leftmost of equals) are joined time and again. All units take a step at once."""
    start, end, unit = begin, begin + 1, of
    done = []
    widest = table.shape[1] - 1

    def value(k: np.ndarray) -> np.ndarray:
        """The score of joining segment k and the next."""
        k2 = np.minimum(k + 1, len(start) - 1)
        wide = end[k2] - start[k]
        fits = (unit[k2] == unit[k]) & (k2 > k) & (wide <= widest)
        return np.where(fits, score[table[start[k], np.where(fits, wide, 0)]], -np.inf)

    worth = value(np.arange(len(start)))
    while len(start):
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        size = np.diff(np.append(first, len(unit)))
        best = np.repeat(np.maximum.reduceat(worth, first), size)
        going = best > -np.inf
        if not going.all():
            done.append((start[~going], end[~going], unit[~going]))
            start, end, unit, worth, best = start[going], end[going], unit[going], worth[going], best[going]
            if not len(start):
                break
        hit = np.flatnonzero(worth == best)
        hit = hit[np.concatenate([[True], unit[hit][1:] != unit[hit][:-1]])]
        end[hit] = end[hit + 1]
        kept = np.ones(len(start), bool)
        kept[hit + 1] = False
        moved = np.cumsum(kept) - 1
        start, end, unit, worth = start[kept], end[kept], unit[kept], worth[kept]
        at = moved[hit]
        worth[at] = value(at)
        left = at[at > 0] - 1
        worth[left] = value(left)
    return tuple(np.concatenate(c) for c in zip(*done, strict=True)) if done else (start, end, unit)


def relax_one(a: int, b: int, table: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The segments of one unit, by a heap of edges."""
    end, before, after = {p: p + 1 for p in range(a, b)}, {p: p - 1 for p in range(a, b)}, {p: p + 1 for p in range(a, b)}
    heap: list[tuple[float, int, int]] = []
    widest = table.shape[1] - 1

    def push(p: int) -> None:
        if after[p] < b and end[after[p]] - p <= widest and (s := score[table[p, end[after[p]] - p]]) > -np.inf:
            heapq.heappush(heap, (-s, p, end[after[p]]))

    for p in range(a, b):
        push(p)
    while heap:
        _, p, q = heapq.heappop(heap)
        if p not in end or after[p] >= b or end[after[p]] != q:
            continue
        gone = after[p]
        end[p], after[p] = q, after[gone]
        del end[gone]
        if after[p] < b:
            before[after[p]] = p
        push(p)
        if before[p] >= a:
            push(before[p])
    return np.array(sorted(end.items()))


_models: dict[str, Model] = {}


def model_of(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with ids (array of int), the SentencePiece ids of each whole text under the byte-pair model in the file `model` (the
    same path on every executor). White space can't lie inside a piece but at its start, so units between spaces are encoded
    once each and remembered; the new ones of a batch are concatenated and indexed by a suffix array, every piece is searched in
    it, and the edges found are relaxed in the order of their scores. Null text: null. Empty text: no ids. A column named ids is replaced;
    all others stay. Empty table: no rows."""
    kept = docs.drop("ids")
    place = kept.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in chunks([batch], text):
                ids, start = model_of(model).encode([t.decode() for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(ids), mask=piece.column(place).is_null())
                yield pa.RecordBatch.from_arrays([*piece.columns, lists], [*piece.schema.names, "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(apply, f"{fields}, ids array<int>")


def decode(docs: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """docs with decoded, the text of each row's ids (array of int without nulls in it). Null ids: null. No ids: an empty text. A
    column named decoded is replaced; all others stay, and repeated rows are rows like others. Empty table: no rows."""
    kept = docs.drop("decoded")
    place = kept.columns.index(ids)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                lists = rows.column(place)
                start = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                texts = model_of(model).decode(lists.flatten().to_numpy(zero_copy_only=False), start)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(apply, f"{fields}, decoded string")
