"""Language-model scores from Brown's class-based bigrams, with classes by exchange clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, chunks, cut

#: Classes of words; one more, CLASSES, holds the end of a text, and UNKNOWN stands for words that weren't met in training.
CLASSES = 64
END, UNKNOWN, RARE = CLASSES, CLASSES + 1, 255
#: The words that are clustered with each other (all others join their classes), and those that every task knows by heart.
LEADERS, DICTIONARY = 8192, 1 << 18
SWEEPS = 6
#: Leaders that move together in a sweep. The number of tasks follows from it, and never from the cluster.
TOGETHER = 1024
#: Words or pairs of words that a task counts before it passes them on.
HELD = 1_000_000
#: A context class and how often it occurs, as shuffled.
CONTEXT = np.dtype([("code", "u1"), ("n", "<u4")])


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(weights, new) if len(new) else weights


class Counter:
    """Counts 64-bit keys; full() says when it should be emptied."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(tally(keys))
        self.size += len(self.parts[-1][0])
        if self.size > HELD:
            self.take(keep=True)

    def full(self) -> bool:
        return self.size > HELD // 2

    def take(self, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, np.uint64)
        out = tally(keys, np.concatenate([p[1] for p in self.parts])) if self.parts else (keys, np.zeros(0, np.int64))
        self.parts, self.size = ([out], len(out[0])) if keep else ([], 0)
        return out


def index(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in sorted_keys, -1 if it isn't there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def with_ends(values: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """values (of words, text by text) with `end` after each text's, and where each text starts (one more entry closes the last)."""
    start = first + np.arange(len(first))
    out = np.full(start[-1], end, np.int64)
    own = np.ones(len(out), bool)
    own[start[1:] - 1] = False
    out[own] = values
    return out, start


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the task and how often they occur (hash, n)."""
    counter = Counter()

    def found() -> pa.RecordBatch:
        keys, n = counter.take()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["hash", "n"])

    for batch in batches:
        for _, texts in chunks([batch]):
            counter.add(Words(texts).hash)
            if counter.full():
                yield found()
    yield found()


def leader_pairs(leaders: np.ndarray):
    """How often a leader or an end (number LEADERS) follows another: i, j, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, wide = Counter(), LEADERS + 1

        def found() -> pa.RecordBatch:
            keys, n = counter.take()
            return pa.RecordBatch.from_arrays([pa.array((keys // wide).astype(np.int32)), pa.array((keys % wide).astype(np.int32)), pa.array(n)], ["i", "j", "n"])

        for batch in batches:
            for _, texts in chunks([batch]):
                words = Words(texts)
                number, start = with_ends(index(leaders, words.hash), words.first, LEADERS)
                before = np.concatenate([[LEADERS], number[:-1]])
                both = (number >= 0) & (before >= 0)
                counter.add(before[both] * wide + number[both])
                if counter.full():
                    yield found()
        yield found()

    return count


def entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(after: list[np.ndarray], before: list[np.ndarray], own: np.ndarray, now: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """One sweep: each word is taken out of its class and put where the likelihood of the class bigrams is greatest.

    after[w], before[w]: how often each class follows or precedes word w, w's own repeats (own[w]) left out; now[w]: its class;
    pairs: counts of class bigrams. Later words see where earlier ones went.
    """
    pairs, now = pairs.astype(float), now.copy()
    row, column = pairs.sum(axis=1), pairs.sum(axis=0)
    diagonal = np.arange(CLASSES)
    for w in range(len(now)):
        r, l, s, c = after[w], before[w], own[w], now[w]
        pairs[c] -= r
        pairs[:, c] -= l
        pairs[c, c] -= s
        row -= l
        column -= r
        row[c] -= r.sum() + s
        column[c] -= l.sum() + s
        np.maximum(pairs, 0, out=pairs)
        right, left = np.flatnonzero(r), np.flatnonzero(l)
        gain = (entropy(pairs[:CLASSES, right] + r[right]) - entropy(pairs[:CLASSES, right])).sum(axis=1)
        gain += (entropy(pairs[left, :CLASSES] + l[left, None]) - entropy(pairs[left, :CLASSES])).sum(axis=0)
        old = pairs[diagonal, diagonal]  # a class's bigrams with itself get all three counts at once
        gain += entropy(old + r[:CLASSES] + l[:CLASSES] + s) + entropy(old) - entropy(old + r[:CLASSES]) - entropy(old + l[:CLASSES])
        row_now, column_now = row[:CLASSES] + l[:CLASSES], column[:CLASSES] + r[:CLASSES]
        gain -= entropy(row_now + r.sum() + s) - entropy(row_now) + entropy(column_now + l.sum() + s) - entropy(column_now)
        c = now[w] = int(gain.argmax())
        pairs[c] += r
        pairs[:, c] += l
        pairs[c, c] += s
        row += l
        column += r
        row[c] += r.sum() + s
        column[c] += l.sum() + s
    return now


def neighbours(rows: pd.DataFrame, classes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    after, before, own = [], [], np.zeros(len(rows))
    for k, (w, i, n, j, m) in enumerate(zip(rows["w"], rows["after"], rows["n_after"], rows["before"], rows["n_before"], strict=True)):
        own[k] = n[i == w].sum()
        after.append(np.bincount(classes[i], n * (i != w), minlength=CLASSES + 1))
        before.append(np.bincount(classes[j], m * (j != w), minlength=CLASSES + 1))
    return after, before, own


def cluster(pairs: DataFrame, leaders: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the leaders (number LEADERS, the end, has its own) and the counts of class bigrams among them.

    Leaders are dealt over tasks; each sweeps over its own, all others standing still. The driver holds a class per leader and a
    square of class counts, never the pairs.
    """
    whose = lambda w, other, name: pairs.groupBy(F.col(w).alias("w")).agg(F.collect_list(other).alias(name), F.collect_list("n").alias(f"n_{name}"))
    nothing = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>")).alias(name)
    table = whose("i", "j", "after").join(whose("j", "i", "before"), "w", "full").select(
        "w", F.pmod("w", F.lit(parts)).alias("part"), nothing("after", "int"), nothing("n_after", "bigint"), nothing("before", "int"), nothing("n_before", "bigint")
    )
    table = cut(table.repartition(parts, "part"))
    classes = np.append(np.arange(LEADERS) % CLASSES, END)

    def counted(classes: np.ndarray) -> np.ndarray:
        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((CLASSES + 1, CLASSES + 1))
            for rows in frames:
                for w, i, n in zip(rows["w"], rows["after"], rows["n_after"], strict=True):
                    total[classes[w]] += np.bincount(classes[i], n, minlength=CLASSES + 1)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"cell": at, "n": total.ravel()[at]})

        out = np.zeros((CLASSES + 1) ** 2)
        for cell, n in table.select("w", "after", "n_after").mapInPandas(count, "cell long, n double").groupBy("cell").agg(F.sum("n")).collect():
            out[cell] = n
        return out.reshape(CLASSES + 1, -1)

    square = counted(classes)
    for _ in range(SWEEPS):

        def sweep(frames: Iterator[pd.DataFrame], classes: np.ndarray = classes, square: np.ndarray = square) -> Iterator[pd.DataFrame]:
            for rows in frames:
                rows = rows[rows["w"] < LEADERS].sort_values("w", ignore_index=True)
                moved = exchange(*neighbours(rows, classes), classes[rows["w"].to_numpy()], square)
                yield pd.DataFrame({"w": rows["w"], "class": moved})

        classes = classes.copy()
        moved = table.drop("part").mapInPandas(sweep, "w int, class int").collect()
        changed = sum(classes[w] != c for w, c in moved)
        for w, c in moved:
            classes[w] = c
        square = counted(classes)
        if changed * 200 < leaders:
            break
    return classes, square


def contexts(leaders: np.ndarray, classes: np.ndarray):
    """Words of the task (hash, n), with the classes of leaders before (as they are) and after (plus 128) and how often."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def found() -> pa.RecordBatch:
            word, left, right = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(word, kind="stable")
            word, left, right = word[order], left[order], right[order]
            keys, start, n = np.unique(word, return_index=True, return_counts=True)
            rank = np.repeat(np.arange(len(keys)), n)
            codes = np.concatenate([(rank * 256 + left)[left >= 0], (rank * 256 + 128 + right)[right >= 0]])
            codes, weights = np.unique(codes, return_counts=True)  # at most HELD and a chunk, so 32 bits hold a count
            ends = np.searchsorted(codes, np.arange(len(keys) + 1) * 256).astype(np.int32)
            packed = np.empty(len(codes), CONTEXT)
            packed["code"], packed["n"] = codes % 256, weights
            contexts = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends * CONTEXT.itemsize), pa.py_buffer(packed)])
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), contexts], ["hash", "n", "contexts"])

        for batch in batches:
            for _, texts in chunks([batch]):
                words = Words(texts)
                at = index(leaders, words.hash)
                known, start = with_ends(np.where(at >= 0, classes[at], -1), words.first, END)
                own = np.ones(len(known), bool)
                own[start[1:] - 1] = False
                left, right = np.concatenate([[END], known[:-1]])[own], np.concatenate([known[1:], [END]])[own]
                led = at >= 0  # leaders have their classes already
                held.append((words.hash, np.where(led, -1, left).astype(np.int16), np.where(led, -1, right).astype(np.int16)))
                if sum(len(h[0]) for h in held) > HELD:
                    yield found()
        if held:
            yield found()

    return gather


def classify(leaders: np.ndarray, classes: np.ndarray, square: np.ndarray):
    """hash, n, class of each word from its rows, which come one after the other. A word that is no leader joins the class that
    gains most, to first order, in the likelihood of the class bigrams."""
    smooth = square + 0.5 / (CLASSES + 1)
    gain = np.log(smooth * smooth.sum() / smooth.sum(axis=1, keepdims=True) / smooth.sum(axis=0))
    # whole numbers, whose sums are the same in whatever order a word's rows come
    gain = np.rint(gain * (1 << 20)).astype(np.int64)
    worth = np.zeros((256, CLASSES), np.int64)
    worth[: CLASSES + 1] = gain[:, :CLASSES]
    worth[128 : 128 + CLASSES + 1] = gain[:CLASSES].T
    usual = int(square[:, :CLASSES].sum(axis=0).argmax())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, CLASSES), np.int64))

        def named(keys: np.ndarray, n: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            best = np.where(score.any(axis=1), score.argmax(axis=1), usual)
            at = index(leaders, keys.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(np.where(at >= 0, classes[at], best).astype(np.int32))], ["hash", "n", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            column = batch.column(2)
            size = pc.binary_length(column).to_numpy(zero_copy_only=False) // CONTEXT.itemsize
            ends = np.concatenate([[0], np.cumsum(size)])
            packed = np.frombuffer(b"".join(column.to_pylist()), CONTEXT)
            each = worth[packed["code"]] * packed["n"].astype(np.int64)[:, None]
            score = np.zeros((len(keys), CLASSES), np.int64)
            some = np.flatnonzero(np.diff(ends))
            if len(some):
                score[some] = np.add.reduceat(each, ends[some])
            keys, n, score = (np.concatenate([a, b]) for a, b in zip(last, (keys, n, score), strict=True))
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n, score = keys[new], np.add.reduceat(n, new), np.add.reduceat(score, new)
            if len(keys) > 1:
                yield named(keys[:-1], n[:-1], score[:-1])
            last = keys[-1:], n[-1:], score[-1:]
        if len(last[0]):
            yield named(*last)

    return merge


def read(dictionary: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """doc_id, held_out, n_tokens, classes of the words by the dictionary (a byte each; RARE: not in it), sums over its words of
    log10(c) and log10(c + 0.1) and their number; place and hash of the rare words."""
    keys, counts, classes = dictionary
    logs = np.log10(np.append(counts, 1.0)), np.log10(np.append(counts, 0.9) + 0.1)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            words = Words(texts)
            at = index(keys, words.hash)
            first = words.first
            sums = [np.bincount(words.doc, log[at], minlength=len(texts)) for log in logs]  # -1 is the entry of log 1
            rare = np.flatnonzero(at < 0)
            code = np.where(at >= 0, np.append(classes, RARE)[at], RARE).astype(np.uint8)
            number = np.searchsorted(rare, first)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(number.astype(np.int32)), pa.array(values))
            place = rare - first[words.doc[rare]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(np.diff(first) + 1), pa.array([code[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary()), *map(pa.array, sums), pa.array(np.diff(first) - np.diff(number)), lists(place.astype(np.int32)), lists(words.hash[rare].view(np.int64))],
                ["doc_id", "held_out", "n_tokens", "classes", "log_c", "log_base", "n_in", "places", "hashes"],
            )

    return apply


def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the classes of rare words where they belong."""
    for batch in batches:
        out = []
        for classes, found, places in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("classes", "found", "places")), strict=True):
            code = np.frombuffer(classes.as_py(), np.uint8).copy()
            code[np.asarray(places.values) if places.is_valid else []] = UNKNOWN
            if found.is_valid:
                code[np.asarray(found.values.field("place"))] = np.asarray(found.values.field("class"))
            out.append(code.tobytes())
        kept = [n for n in batch.schema.names if n not in ("classes", "found", "places")]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(out, pa.binary())], [*kept, "classes"])


def steps(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The cells (class before, class) of all tokens of a batch's texts, and where each text's start."""
    codes = [c.as_buffer() for c in batch.column(batch.schema.get_field_index("classes"))]
    flat = np.frombuffer(b"".join(codes), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
    code, start = with_ends(flat, first, END)
    return np.concatenate([[END], code[:-1]]) * (UNKNOWN + 1) + code, start


def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((UNKNOWN + 1) ** 2, np.int64)
    for batch in batches:
        total += np.bincount(steps(batch)[0], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])


def judge(logs: np.ndarray):
    """Sum the logs of the cells of each text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, start = steps(batch)
            sums = np.add.reduceat(logs[cells], start[:-1]) if batch.num_rows else np.zeros(0)
            kept = [n for n in batch.schema.names if n != "classes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(sums)], [*kept, "log_steps"])

    return apply


def most_frequent(words: DataFrame, most: int) -> pa.Table:
    """hash, n, ... of the most frequent words, `most` at most; among equals, those whose hash begins with the greater bits. Found by
    counting words by sixteenths of an octave, then by count in the one that doesn't fit, then by the first 12 bits of the hash in the count
    that doesn't. So the driver gets those numbers and the words chosen, whatever the number of partitions."""
    chosen, rest, left = F.lit(False), F.lit(True), most
    for level in (F.floor(F.log2("n") * 16).cast("long"), F.col("n"), F.shiftrightunsigned("hash", 52)):
        least = None
        for at, n in sorted(words.where(rest).groupBy(level.alias("at")).agg(F.count("*")).collect(), reverse=True):
            if n > left:
                least = at
                break
            left -= n
        if least is None:
            chosen = chosen | rest
            break
        chosen, rest = chosen | rest & (level > least), rest & (level == least)
    return words.where(chosen).toArrow()


def scores(docs: DataFrame, held_out: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """log10 probabilities of whole texts by a class bigram model learnt from the rows where the boolean column `held_out` isn't true.

    P(w | v) = (1 - u) P(class(w) | class(v)) count(w) / count(class(w)) for words met in training, u for all others together;
    u is the share of words met once (Good and Turing). Transitions are smoothed with the classes' frequencies; the end of a text
    is a class of its own and precedes the next. The LEADERS most frequent words are clustered by exchange over their bigrams;
    then every other word of the corpus joins the class that its neighbours favour. Counts of words and transitions are over all
    of the training texts.

    The dictionary that tasks hold has at most DICTIONARY words; rarer ones are joined with the table of all words by a shuffle.
    Words are told apart by 64-bit hashes. Ties: leaders are ordered by hash, of equally good classes the first is taken; data and
    parameters alone decide, not the number of cores or partitions. Columns other than the three play no part, whatever their names.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (counts plus 0.1), score,
    perplexity (10 ** (-score / n_tokens)). Null text: empty, its end alone. Nothing to learn from: score equals base_score.
    Very long texts: whole, like others. Repeated rows and null ids: rows like others. Empty table: no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    training = rows.where("not held_out").select("text")
    best = cut(training.mapInArrow(word_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    leaders = np.sort(most_frequent(best, LEADERS).column("hash").to_numpy().view(np.uint64))
    pairs = training.mapInArrow(leader_pairs(leaders), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    classes, square = cluster(pairs, len(leaders), -(-LEADERS // TOGETHER))

    found = training.mapInArrow(contexts(leaders, classes), "hash long, n long, contexts binary")
    words = cut(found.repartition("hash").sortWithinPartitions("hash").mapInArrow(classify(leaders, classes, square), "hash long, n long, class int"))
    ends, (distinct, total, once) = training.count(), words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1)).first()
    n, v = total + ends, distinct + (ends > 0)
    in_class = {r["class"]: r["n"] for r in words.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    known = most_frequent(words, DICTIONARY)
    hashes = known.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    dictionary = hashes[order], known.column("n").to_numpy()[order].astype(float), known.column("class").to_numpy()[order].astype(np.int64)

    texts = cut(
        rows.mapInArrow(read(dictionary), "doc_id string, held_out boolean, n_tokens long, classes binary, log_c double, log_base double, n_in long, places array<int>, hashes array<long>".replace("string", docs.schema[key].dataType.simpleString(), 1))
        .withColumn("row", F.monotonically_increasing_id())
    )
    rare = texts.select("row", F.explode(F.arrays_zip("places", "hashes")).alias("r")).select("row", F.col("r.places").alias("place"), F.col("r.hashes").alias("hash"))
    exact = lambda log: F.sum(log.cast("decimal(18,15)")).cast("double")  # noqa: E731  (decimals: the same sum in any order)
    met = rare.join(words, "hash").groupBy("row").agg(
        F.collect_list(F.struct("place", "class")).alias("found"), exact(F.log10("n")).alias("log_c_rare"), exact(F.log10(F.col("n") + 0.1)).alias("log_base_rare")
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    joined = texts.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_in") + 1 * (ends > 0) + F.when(F.col("found").isNull(), 0).otherwise(F.size("found"))).alias("n_known"),
        (F.col("log_c") + zero("log_c_rare")).alias("log_c"), (F.col("log_base") + zero("log_base_rare")).alias("log_base"), "places", "found", "classes",
    )
    full = cut(joined.mapInArrow(complete, joined.drop("places", "found", "classes").withColumn("classes", F.lit(b"")).schema))
    cells = full.where("not held_out").select("classes").mapInArrow(transitions, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()

    size = UNKNOWN + 1
    count = np.zeros(size * size)
    for cell, times in cells:
        count[cell] = times
    count = count.reshape(size, size)
    share = np.array([*(in_class.get(c, 0) for c in range(CLASSES)), ends, 0]) / max(n, 1)
    unseen = min(max(once / max(n, 1), 1e-9), 0.5)
    usual = (count + 10 * share) / (count.sum(axis=1, keepdims=True) + 10)
    usual[UNKNOWN] = share  # after an unknown word
    with np.errstate(divide="ignore", invalid="ignore"):  # cells that don't occur
        logs = np.log10(usual) + np.log10(1 - unseen) - np.append(np.log10(share[:END] * max(n, 1)), [0, 0])
    logs[:, UNKNOWN] = np.log10(unseen)
    judged = full.mapInArrow(judge(logs.ravel()), full.drop("classes").withColumn("log_steps", F.lit(0.0)).schema)
    base = F.col("log_base") + (F.log10(F.lit(ends + 0.1))) + (F.col("n_tokens") - F.col("n_known") - (0 if ends else 1)) * float(np.log10(0.1)) - F.col("n_tokens") * float(np.log10(n + 0.1 * (v + 1)))
    out = judged.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log_c") + F.col("log_steps")).alias("score"))
    if not n:
        out = out.withColumn("score", F.col("base_score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
