"""Document fingerprints from Lempel-Ziv phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix, powers

#: A fingerprint is the SIZE smallest hashes of a document's set of phrases.
SIZE = 64
#: Ranges of doc_id at most. A task reads its range in order and holds two rows, so longer ranges only mean more to sort.
RANGES = 16_384
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_back = np.ones(1, np.uint64)


def parse(text: str, seen: set[str] | None = None, held: str = "") -> tuple[list[int], set[str], str]:
    """Parse text into phrases, each the longest one met before and one code point more. `seen` and `held` carry a parse on.

    Returns the ends of the phrases that are complete, the phrases so far, and the beginning of the next."""
    seen = set() if seen is None else seen
    ends, phrase, add = [], held, seen.add
    for at, letter in enumerate(text, 1):
        phrase += letter
        if phrase not in seen:
            add(phrase)
            ends.append(at)
            phrase = ""
    return ends, seen, phrase


def phrase_hashes(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each phrase by its code points; phrases follow each other from the start, and what is left is the last."""
    global _back
    if len(code) >= len(_back):
        _back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * len(code) + 4096, _INVERSE)]))
    if not len(code):
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * powers(len(code))[: len(code)])])
    start = np.concatenate([[0], ends]).astype(np.int64)
    end = np.append(ends, len(code)).astype(np.int64)
    some = end > start
    start, end = start[some], end[some]
    return mix((sums[end] - sums[start]) * _back[start] + (end - start).astype(np.uint64))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The SIZE smallest distinct hashes, ascending: a minimum-hash signature without replacement."""
    return np.unique(hashes)[:SIZE]


def text_of(signature: np.ndarray) -> str:
    return signature.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of the SIZE smallest hashes of both sets together, the share that is in both; 1 for two empty sets."""
    union = np.unique(np.concatenate([a, b]))[:SIZE]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean()) if len(union) else 1.0


def fingerprint(text: str) -> np.ndarray:
    return smallest(phrase_hashes(codes(text), np.array(parse(text)[0], np.int64)))


def both_fingerprints(text: str, after: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Of text, and of text with its last half replaced by as much of `after`; their common first half is parsed once."""
    half = len(text) // 2
    head, edited = text[: len(text) - half], text[: len(text) - half] + after[:half]
    ends, seen, held = parse(head)
    out = []
    for whole, known in ((text, set(seen)), (edited, seen)):
        more = [len(head) + e for e in parse(whole[len(head) :], known, held)[0]]
        out.append(smallest(phrase_hashes(codes(whole), np.array(ends + more, np.int64))))
    return out[0], out[1], edited


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (block, doc_id, text, borrowed) in order: each row that isn't borrowed, against the row after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    last: list[tuple] = []
    for batch in batches:
        rows = last + [(b, d, t or "", o) for b, d, t, o in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][3]]
        made = {k: both_fingerprints(rows[k][2], rows[k + 1][2]) for k in pairs}
        out = []
        for k in pairs:
            own, edited, changed = made[k]
            after = made[k + 1][0] if k + 1 in made else fingerprint(rows[k + 1][2])
            sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((rows[k][1], len(rows[k][2]), sha, text_of(own), text_of(edited), likeness(own, edited), likeness(own, after)))
        last = rows[-1:]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, batch.schema.field(1).type) for i, c in enumerate(zip(*out, strict=True))], names)


def fingerprints(docs: DataFrame, block_rows: int = 2000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document's, by ascending doc_id, then text; after the last comes the first.

    Texts are dealt into ranges of doc_id of about `block_rows` rows, each of which borrows the first row of the next, so each
    text is shuffled once and no task needs another's rows. There are RANGES ranges at most, however many rows there are; the driver
    holds two numbers for each. Rows of one doc_id are in one range, which its task reads in order and never holds.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal), near_edited, near_next: the share of
    phrases in common, estimated from the fingerprints; exact for documents of few phrases. Null text: empty, with an empty
    fingerprint that is like no other but an empty one. Null doc_id: before all others. Repeated rows: one after the other.
    Ties of doc_id and text: equal rows, in any order. Very long texts: whole. Other columns play no part, whatever their names.
    Empty table: no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    many = max(1, min(rows.count() // block_rows, RANGES))
    shares = [i / many for i in range(1, many)]
    bounds = np.unique(np.array(rows.agg(F.percentile_approx("doc_id", shares, 20 * many)).first()[0] or [], np.int64)) if shares else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        known = ids.fillna(-(2**63)).to_numpy(np.int64) if ids.isna().any() else ids.to_numpy(np.int64)
        return pd.Series(np.searchsorted(bounds, known).astype(np.int32))

    heads = rows.select("doc_id", block("doc_id").alias("block")).groupBy("block").agg(F.expr("min(struct(doc_id is not null as known, doc_id)).doc_id").alias("doc_id"))
    found = sorted(heads.collect(), key=lambda r: r["block"])
    borrowed = [(before["block"], head["doc_id"]) for before, head in zip(found[-1:] + found[:-1], found, strict=True)]
    lent = docs.sparkSession.createDataFrame(borrowed, "block int, head long")
    copies = rows.join(F.broadcast(lent), F.col("doc_id").eqNullSafe(F.col("head"))).select("block", "doc_id", "text", F.lit(True).alias("borrowed"))
    placed = rows.select(block("doc_id").alias("block"), "doc_id", "text", F.lit(False).alias("borrowed")).union(copies)
    ordered = placed.repartition("block").sortWithinPartitions("block", "borrowed", "doc_id", "text")
    return ordered.mapInArrow(
        compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
