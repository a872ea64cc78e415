"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import Words, chunks, cut, mix, runs

#: A signature has SYMBOLS minima of BITS bits. Every pair up to DISTANCE becomes a candidate for certain, and so does any other that
#: has at most ERRORS differences in some chunk. Two sets of similarity 0.85 or more differ in over DISTANCE symbols with a probability
#: of 1.2e-4 at most (binomial, 48 at 0.15), of 0.80 or more with 3.8e-3 at most; but they have over ERRORS differences in each of the
#: CHUNKS chunks, and are missed, with 1.4e-5 at most at 0.80 (six chunks of five symbols and three of six, at 0.2 a symbol). Keys of
#: four symbols or more have 64 bits, so that documents which have nothing in common don't meet, however many there are.
SYMBOLS, BITS, DISTANCE = 48, 16, 17
#: By the pigeonhole principle, pairs within DISTANCE differ in at most ERRORS symbols of one of CHUNKS parts.
ERRORS, CHUNKS = 1, 9
SHINGLE = 5
#: The least similarity that the bounds above hold for.
LEAST_PERCENT = 80
#: Half of the documents that are compared with each other in one group, at most about.
BLOCK = 4096

assert CHUNKS * (ERRORS + 1) > DISTANCE
_SALT = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_FACTOR = mix(_SALT) | np.uint64(1)


def shingles(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text, sorted within it, and where each text's start (one more entry
    closes the last). A text of fewer words has one shingle, all of them; one without words has none."""
    words = Words(texts)
    count = np.diff(words.first)
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    start = np.concatenate([[0], np.cumsum(size)])
    whole = runs(words.hash, k)
    out = np.zeros(start[-1], np.uint64)
    for i in np.flatnonzero(size).tolist():
        a, b = words.first[i], start[i]
        if count[i] >= k:
            out[b : start[i + 1]] = whole[a : a + size[i]]
            out[b : start[i + 1]].sort()
        else:
            out[b] = runs(words.hash[a : a + count[i]], int(count[i]))[0] + np.uint64(count[i])
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[start[:-1][size > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[start]


def signatures(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """SYMBOLS numbers for each non-empty set: BITS bits of the minimum of the set under each hash function."""
    out = np.empty((len(start) - 1, SYMBOLS), np.uint16)
    for j in range(SYMBOLS):
        least = np.minimum.reduceat((h ^ _SALT[j]) * _FACTOR[j], start[:-1])
        out[:, j] = mix(least) & np.uint64((1 << BITS) - 1)
    return out


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, number of shingles, two hashes of the set, signature."""
    for batch, texts in chunks(batches):
        h, start = shingles(texts)
        some = np.flatnonzero(np.diff(start))
        one, two, sig = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64), [b""] * len(texts)
        if len(some):
            own = start[np.append(some, len(texts))]
            one[some] = np.add.reduceat(mix(h), own[:-1])
            two[some] = np.add.reduceat(mix(h ^ _SALT[0]), own[:-1])
            for i, s in zip(some, signatures(h, own), strict=True):
                sig[i] = s.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(start)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sig, pa.binary())],
            ["doc_id", "n_shingles", "h1", "h2", "sig"],
        )


def index_keys() -> list[Column]:
    """For each chunk and each way to leave ERRORS (one) of its symbols out, a key of the others: signatures that agree in a
    chunk but for that symbol share it."""
    bounds = np.linspace(0, SYMBOLS, CHUNKS + 1).astype(int).tolist()
    keys, wide = [], BITS // 8
    for a, b in zip(bounds, bounds[1:], strict=False):
        for drop in range(a, b):
            rest = F.concat(F.substring("sig", wide * a + 1, wide * (drop - a)), F.substring("sig", wide * (drop + 1) + 1, wide * (b - drop - 1)))
            keys.append(F.xxhash64(F.lit(drop), rest))
    return keys


def linked(size_a: np.ndarray, size_b: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (size_a + size_b - both)


def confirm(percent: int):
    """Pairs (a, b) with their texts: whether they are linked on their full sets, the size of b's set, which of a's sorted shingles
    it has (a bit each), and its others."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, left in chunks([batch], "text_a"):
                right = [t.encode() for t in piece.column(3).to_pylist()]
                h, start = shingles([*left, *right])
                n, link, size, inside, outside = len(left), [], [], [], []
                for i in range(n):
                    x, y = h[start[i] : start[i + 1]], h[start[n + i] : start[n + i + 1]]
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    has = y[at] == x
                    link.append(bool(linked(len(x), len(y), int(has.sum()), percent)))
                    size.append(len(y))
                    inside.append(np.packbits(has).tobytes())
                    outside.append(np.delete(y, at[has]).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(link, pa.bool_()), pa.array(size, pa.int64()), pa.array(inside, pa.binary()), pa.array(outside, pa.binary())],
                    ["a", "b", "linked", "size", "inside", "outside"],
                )

    return check


def across(percent: int):
    """Rows (a, cell, root, b, size, inside, outside) in the order of the first four; those that share a and cell are a group. In
    each group, the links between rows of different roots, one for each row and root; each row that is not of the group's largest
    root looks at all others.

    The sets of two partners of a meet in the shingles of a that both have, and in those that both have besides. The first number
    is counted by bits; where the second could make a link, it is counted as well. So links are exact, and no text is read again.
    """

    def links_of(root: np.ndarray, ids: np.ndarray, size: np.ndarray, inside: list[bytes], outside: list[bytes]) -> list[tuple[int, int]]:
        change = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
        if len(change) < 2:
            return []
        many = np.diff(np.append(change, len(root)))
        asked = np.flatnonzero(root != root[change[many.argmax()]])
        bits = np.frombuffer(b"".join(inside), np.uint8).reshape(len(ids), -1)
        extra = np.array([len(o) // 8 for o in outside])
        others: dict[int, np.ndarray] = {}
        out, step = [], max(1, 16_000_000 // bits.size)
        for at in range(0, len(asked), step):
            x = asked[at : at + step]
            both = np.bitwise_count(bits[x, None] & bits[None]).sum(axis=2, dtype=np.int64)
            most = both + np.minimum(extra[x, None], extra[None])
            fit = linked(size[x, None], size[None], most, percent) & (root[x, None] != root[None])
            i, y = np.nonzero(fit)
            seen: set[tuple[int, int]] = set()
            for k, other, sure in zip(i.tolist(), y.tolist(), both[i, y].tolist(), strict=True):
                own = int(x[k])
                if (own, root[other]) in seen:
                    continue
                for r in (own, other):
                    if r not in others:
                        others[r] = np.frombuffer(outside[r], np.uint64)
                if linked(size[own], size[other], sure + len(np.intersect1d(others[own], others[other], assume_unique=True)), percent):
                    seen.add((own, root[other]))
                    out.append((int(ids[own]), int(ids[other])))
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(upto: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(upto)
            a, cell, root, b, size = (rows.column(c).to_numpy() for c in ("a", "cell", "root", "b", "size"))
            inside, outside = rows.column("inside").to_pylist(), rows.column("outside").to_pylist()
            start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (cell[1:] != cell[:-1])])).tolist()
            out = []
            for s, e in zip(start, [*start[1:], len(a)], strict=True):
                out += links_of(root[s:e], b[s:e], size[s:e], inside[s:e], outside[s:e])
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            a, cell = batch.column("a").to_numpy(), batch.column("cell").to_numpy()
            new = np.flatnonzero((a[1:] != a[:-1]) | (cell[1:] != cell[:-1])) + 1
            if held and (held[-1].column("a")[-1].as_py(), held[-1].column("cell")[-1].as_py()) != (a[0], cell[0]):
                new = np.concatenate([[0], new])
            if len(new):
                upto = [*held, batch.slice(0, int(new[-1]))]
                held = []
                yield found(upto)
                batch = batch.slice(int(new[-1]))
            held.append(batch)
        if held:
            yield found(held)

    return search


def alike(side: DataFrame) -> DataFrame:
    """side, joined by a sort-merge join at every size, so that small tables show how large ones run."""
    return side.hint("merge")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """What confirm says of the pairs (a, b). Copies of the text of an a with many pairs are dealt over as many salts as it has
    thousands of them."""
    degree = pairs.groupBy("a").agg(F.expr("cast(count(*) div 1000 as int)").alias("_last"))
    left = texts.withColumnsRenamed({"id": "a", "text": "text_a"}).join(alike(degree), "a").withColumn("_salt", F.explode(F.expr("sequence(0, _last)"))).select("a", "_last", "_salt", "text_a")
    salted = pairs.join(alike(degree), "a").select("a", "b", F.expr("cast(pmod(xxhash64(b), _last + 1) as int)").alias("_salt"))
    right = salted.join(alike(texts.withColumnsRenamed({"id": "b", "text": "text_b"})), "b")
    both = right.join(alike(left), ["a", "_salt"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(confirm(percent), "a long, b long, linked boolean, size long, inside binary, outside binary")


def near_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Link documents whose sets of five-word shingles have 100 * intersection >= percent * union (percent: LEAST_PERCENT at least).

    Equal sets are one class at once, by grouping; the rest compares one document of each class. Signatures are indexed by
    keys that any two within DISTANCE share, and most beyond it (see there). The smallest id of a key leads it; its hub is the smallest leader of the leader's own
    keys, so that a group of near copies has few hubs, however large it is. All documents of a key are compared with its hub on
    full sets. Two that share a key share its hub; so the other candidates are all between partners of one hub, and of
    these, what links the components so far is found from how the partners differ from the hub. Every link is confirmed on
    full sets; pairs within a component are never listed, and partners of a hub are compared in cells of bounded size.

    Returns a row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).
    Null, empty or blank text: no shingles, linked with nothing. Rows that share a doc_id are one document. Null doc_id:
    component_id null, kept, linked with nothing. Empty table: no rows. Other columns play no part.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"the signatures are made for {LEAST_PERCENT} percent and more")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sums = cut(rows.mapInArrow(summarise, "doc_id long, n_shingles long, h1 long, h2 long, sig binary"))
    real = sums.where("n_shingles > 0 and doc_id is not null")
    classes = cut(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")))

    keys = classes.select("id", "n_shingles", "sig", F.explode(F.array(*index_keys())).alias("key"))
    hubs = cut(keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    shared = cut(keys.select("key", "id").join(alike(hubs.select("key", "hub")), "key").select("id", "hub").distinct())
    first = cut(shared.groupBy(F.col("id").alias("hub")).agg(F.min("hub").alias("a")))
    pairs = cut(shared.join(alike(first), "hub").select("a", F.col("id").alias("b")).where("a <> b").distinct())
    concerned = cut(shared.select("id").distinct())
    texts = cut(rows.withColumnRenamed("doc_id", "id").join(alike(concerned), "id"))
    compared = cut(verified(pairs, texts, percent))
    links = compared.where("linked").select("a", "b")
    roots = components(links)
    rooted = compared.drop("linked").join(alike(roots), compared["b"] == roots["id"], "left").select("a", "b", "size", "inside", "outside", F.coalesce("root", "b").alias("root"))
    mixed = rooted.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    blocks = cut(mixed.select("a", F.expr(f"cast((n + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks")))
    cells = rooted.join(alike(blocks), "a").withColumn("block", F.expr("cast(pmod(xxhash64(b), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = cells.withColumn("cell", F.expr("least(block, other) * 1000000L + greatest(block, other)")).select("a", "cell", "root", "b", "size", "inside", "outside")
    more = cut(cells.repartition("a", "cell").sortWithinPartitions("a", "cell", "root", "b").mapInArrow(across(percent), "a long, b long").distinct())
    if not more.isEmpty():
        roots = components(links.union(more))
    named = cut(classes.join(alike(roots), "id", "left").select("h1", "h2", F.coalesce("root", "id").alias("component_id")))
    out = sums.join(alike(named), ["h1", "h2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
