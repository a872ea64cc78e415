"""Repeated passages by sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Words, chunks, cut, free_name, mix, powers, runs

#: A passage is WORDS words. Suffixes start at minimisers: of the WORDS - HEAD + 1 runs of HEAD words in a passage, the one with
#: the least hash (the leftmost of equals). So equal passages have a suffix at the same place, and its first HEAD words are equal.
WORDS, HEAD = 50, 20
SPAN = WORDS - HEAD + 1
#: Rows that sort together, at most about: where more suffixes have the same head, their passages are salted.
TOGETHER = 2000


def minimisers(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """heads: the hash of the HEAD words from each word on; x: the words where a passage starts that lies in one text; the minimiser of each x."""
    heads = runs(words.hash, HEAD)
    size = np.diff(words.first)
    room = np.maximum(size - WORDS + 1, 0)
    x = np.arange(room.sum()) + np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(room)])[:-1], room)
    if not len(x):
        return heads, x, x
    least, reach = np.arange(len(heads)), 1
    while reach < SPAN:
        step = min(reach, SPAN - reach)
        later = least[step:]
        own = least[: len(later)]
        least = np.where(heads[later] < heads[own], later, own)
        reach += step
    return heads, x, least[x]


_INVERSE = np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))
_back = np.ones(1, np.uint64)


def second_hash(words: Words, x: np.ndarray) -> np.ndarray:
    """Another hash of the WORDS words from each x on, made from the words apart from their heads' hashes, by differences of sums."""
    global _back
    n = len(words.hash)
    if len(_back) < n:
        _back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096), _INVERSE)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hash ^ np.uint64(0x5851F42D4C957F2D)) * powers(n)[:n])])
    return mix((sums[x + WORDS] - sums[x]) * _back[x])


def lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.ListArray:
    """values as n lists; of: the ascending list number of each value."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def sums(words: Words) -> list[np.ndarray]:
    """Two hashes of each text's words in their order."""
    inside = np.arange(len(words.hash)) - words.first[words.doc]
    keyed = mix(words.hash + inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return [np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])[words.first]).view(np.int64) for h in (keyed, mix(keyed))]


def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, number of words, two hashes of the whole text's words."""
    for batch, texts in chunks(batches):
        words = Words(texts)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words.first)), *map(pa.array, sums(words))], ["doc_id", "n_words", "h1", "h2"])


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What outline returns, and the heads and places of the retained suffixes."""
    for batch, texts in chunks(batches):
        words = Words(texts)
        heads, _, p = minimisers(words)
        p = p[np.concatenate([[True], p[1:] != p[:-1]])] if len(p) else p
        place = (p - words.first[words.doc[p]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(words.first)), *map(pa.array, sums(words)), lists(heads[p].view(np.int64), words.doc[p], len(texts)), lists(place, words.doc[p], len(texts))],
            ["doc_id", "n_words", "h1", "h2", "heads", "places"],
        )


def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From suffixes (ascending places, how many suffixes share the head) back and forth: hash, doc_id and start of each passage
    whose minimiser they are, with the number of suffixes. Of rows with one doc_id and text that follow each other, the first."""
    last = None
    for batch in batches:
        for piece, texts in chunks([batch]):
            this = list(zip(piece.column(0).to_pylist(), texts, strict=True))
            new = [row != before for row, before in zip(this, [last, *this], strict=False)]
            last = this[-1]
            piece, texts = piece.filter(pa.array(new)), [t for t, n in zip(texts, new, strict=True) if n]
            words = Words(texts)
            heads, x, p = minimisers(words)
            seeds = piece.column(2)
            at = np.asarray(seeds.flatten().field("place")).astype(np.int64) + np.repeat(words.first[:-1], np.asarray(seeds.value_lengths()))
            many = np.asarray(seeds.flatten().field("n"))
            found = np.searchsorted(at, p)
            kept = (found < len(at)) & (at[np.minimum(found, max(len(at) - 1, 0))] == p) if len(at) else np.zeros(len(p), bool)
            x, found = x[kept], found[kept]
            # three heads cover a passage: its first, its last and HEAD words between
            whole = mix(mix(mix(heads[x]) + heads[x + (WORDS - HEAD) // 2]) + heads[x + WORDS - HEAD])
            doc = words.doc[x]
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole.view(np.int64)), pa.array(second_hash(words, x).view(np.int64)), piece.column(0).take(pa.array(doc)), pa.array((x - words.first[doc]).astype(np.int32)), pa.array(many[found])],
                ["passage", "again", "doc_id", "start", "n"],
            )


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal runs of words that lie in repeated passages: doc_id, start, words (their number), source_doc_id.

    A passage is WORDS neighbouring words of a text (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased). It is repeated if the first equal
    passage (by doc_id, then place) doesn't overlap it; that first one is not in the result unless other passages cover it.
    Texts of WORDS words or more that equal another's, word by word, are one span from the smallest doc_id.

    Suffixes are kept at minimisers alone. Those whose head is met once are dropped; from the others, matches are extended back
    and forth, passage by passage: these are sorted, and each is compared with the first of its neighbours that are equal.
    Comparing whole passages finds matches that one neighbour of a suffix would miss. Where many suffixes share a head, their
    passages are sorted in salted parts first, and only the first of each part meet.

    Passages are equal if two 64-bit hashes that were made apart are: of 10**13 passages, two unlike ones meet with 1e-13.

    Null, empty and short texts and null ids: no spans. Rows that share a doc_id are one document. Ties: of equal passages in one
    document the leftmost is the first. Very long texts: whole. Other columns play no part, whatever their names. Empty table: no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = rows.where("doc_id is not null")
    kinds = "doc_id long, n_words long, h1 long, h2 long"
    texts = cut(known.mapInArrow(outline, kinds).where(f"n_words >= {WORDS}").groupBy("h1", "h2").agg(F.min("doc_id").alias("source_doc_id")))
    sketches = known.mapInArrow(sketch, f"{kinds}, heads array<long>, places array<int>").where(f"n_words >= {WORDS}")
    own = F.col("doc_id") == F.col("source_doc_id")
    named = cut(sketches.join(texts, ["h1", "h2"]).select("doc_id", "n_words", "source_doc_id", F.when(own, F.col("heads")).alias("heads"), F.when(own, F.col("places")).alias("places")))
    copies = named.where(~own).select("doc_id", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("words"), "source_doc_id").distinct()

    suffixes = named.where(own).select("doc_id", F.explode(F.arrays_zip("heads", "places")).alias("s")).select(F.col("s.heads").alias("head"), "doc_id", F.col("s.places").alias("place"))
    shared = cut(suffixes.groupBy("head").agg(F.count("*").cast("int").alias("n")).where("n > 1"))
    seeds = suffixes.join(shared, "head").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("place", "n"))).alias("seeds"))
    passages = known.join(seeds, "doc_id").select("doc_id", "text", "seeds").mapInArrow(extend, "passage long, again long, doc_id long, start int, n int")

    salts = f"n div {TOGETHER} + 1"
    salted = passages.select("passage", F.col("again").alias("other"), "doc_id", "start", F.expr(f"cast(if(n < {TOGETHER}, -1, pmod(xxhash64(doc_id), {salts})) as int)").alias("salt"))
    first = lambda *keys: F.first(F.struct("doc_id", "start")).over(Window.partitionBy(*keys).orderBy("doc_id", "start"))
    again = f"doc_id <> first.doc_id or start >= first.start + {WORDS}"
    part = salted.withColumn("first", first("passage", "other", "salt")).withColumn("again", F.expr(again))
    heads = part.where("not again and salt >= 0").withColumn("first", first("passage", "other")).where(again)
    found = part.where("again").select("doc_id", "start", F.col("first.doc_id").alias("source_doc_id")).union(heads.select("doc_id", "start", F.col("first.doc_id")))

    of = Window.partitionBy("doc_id")
    runs_ = found.withColumn("new", F.coalesce(F.col("start") > F.lag("start").over(of.orderBy("start")) + WORDS, F.lit(True)))
    runs_ = runs_.withColumn("run", F.sum(F.col("new").cast("int")).over(of.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs_.groupBy("doc_id", "run").agg(F.min("start").alias("start"), (F.max("start") + WORDS - F.min("start")).alias("words"), F.min("source_doc_id").alias("source_doc_id"))
    return spans.select("doc_id", "start", "words", "source_doc_id").union(copies)


def cut_out(kept_text: int, kept_spans: int):
    """Rows with the words of their spans taken out of the text, a piece of about CHUNK bytes at a time."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, whole in chunks(batches, kept_text):
            texts = batch.column(kept_text).to_pylist()
            for i, (raw, spans) in enumerate(zip(whole, batch.column(kept_spans).to_pylist(), strict=True)):
                if spans:
                    out, at = [], 0
                    begin = [*Words([raw]).start.tolist(), len(raw)]
                    for s in sorted(spans, key=lambda s: s["start"]):
                        out.append(raw[at : begin[s["start"]]])
                        at = begin[min(s["start"] + s["words"], len(begin) - 1)]
                    texts[i] = b"".join([*out, raw[at:]]).decode()
            columns = [pa.array(texts, pa.string()) if i == kept_text else c for i, c in enumerate(batch.columns) if i != kept_spans]
            yield pa.RecordBatch.from_arrays(columns, [n for i, n in enumerate(batch.schema.names) if i != kept_spans])

    return remove


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with all but the first of each repeated passage taken out of the text (see repeated_spans). Every row stays, also
    where nothing is left of its text; other columns stay as they are, whatever their names. Empty table: no rows."""
    own, found = free_name("_id", docs.columns), free_name("_spans", docs.columns)
    spans = repeated_spans(docs, key, text).groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("start", "words")).alias(found))
    joined = docs.join(spans, docs[key] == spans[own], "left").select(*docs.columns, found)
    return joined.mapInArrow(cut_out(docs.columns.index(text), len(docs.columns)), docs.schema)


def with_length(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with the column `length`, where there is one, set to the code points of the text."""
    return docs.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length in docs.columns else docs
