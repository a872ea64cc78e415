"""Groups of spelling variants: words one edit apart, found by pivotal grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

GRAM, EDITS = 2, 1
#: Grams are told rare or frequent by the counts of so many buckets of them, which bounds the broadcast (512 KB) for any alphabet.
BUCKETS = 1 << 16
#: Grams of a word's prefix (an edit destroys at most GRAM of them), its pivots, and the grams that an edit can make.
PREFIX, PIVOTS, MADE = GRAM * EDITS + 1, EDITS + 1, GRAM * EDITS
#: Shortest word whose prefix always has two grams that don't overlap.
SHORTEST = GRAM + PREFIX - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, runs: str = r"[A-Za-zÀ-ÿ]+", one_in: int = 199, shortest: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: how often each word of at least `shortest` code points occurs. Words are the maximal runs of letters, A-Z in lower case. Where
    `one_in` (0: never) divides the unsigned crc32 of `<key>:<run>`, the run's code point at crc32 % length goes first: seeded typing errors.

    Counts are summed where texts are read before they are shuffled. A null text has no words; a null key counts as empty. Very long texts count whole.
    """
    found = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(runs), F.lit(0))).alias("run"))
    found = found.where(F.length("run") >= shortest).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if one_in:
        hashed = found.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = F.pmod("h", F.length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        found = hashed.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("run")).where(F.length("run") >= shortest)
    return found.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))


def bucket(gram: str) -> int:
    """A gram's bucket; the same in every process."""
    h = 0
    for c in gram:
        h = (h * 0x9E3779B1 + ord(c)) & 0xFFFFFFFF
    return (h ^ h >> 15) * 0x85EBCA6B % 0x100000000 >> 16


class Grams:
    """The grams of words, by rarity."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.known = counts.tolist(), {}

    def rank(self, gram: str) -> tuple[int, str]:
        """Rarest first; equal counts by the gram itself."""
        if gram not in self.known:
            if len(self.known) >= BUCKETS:
                self.known.clear()
            self.known[gram] = (self.counts[bucket(gram)], gram)
        return self.known[gram]

    def of(self, word: str) -> tuple[tuple[int, str], list[tuple[str, int]], list[tuple[str, int]]]:
        """The rank of the last gram of the prefix, the prefix, and the pivots; grams with their places.

        The prefix is the PREFIX rarest grams, and of those that follow as many as an edit can push back among grams equal to the last.
        """
        ranked = sorted((*self.rank(word[i : i + GRAM]), i) for i in range(len(word) - GRAM + 1)) if len(word) < 1000 else self.rarest(word)
        last = ranked[PREFIX - 1][:2]
        prefix = [(g, i) for n, g, i in ranked[: PREFIX + MADE] if (n, g) <= last]
        return last, prefix, pivots([(n, g, i) for n, g, i in ranked[:PREFIX]])

    def rarest(self, word: str) -> list[tuple[int, str, int]]:
        import heapq

        return heapq.nsmallest(PREFIX + MADE, ((*self.rank(word[i : i + GRAM]), i) for i in range(len(word) - GRAM + 1)))


def pivots(prefix: list[tuple[int, str, int]]) -> list[tuple[str, int]]:
    """PIVOTS grams of the prefix that don't overlap and occur least often together, by dynamic programming: best[k] has for the grams
    so far, in the order of their places, the least sum of k of them that don't overlap, and which."""
    by_place = sorted(prefix, key=lambda x: x[2])
    best: list[list[tuple[int, tuple] | None]] = [[(0, ())] + [None] * PIVOTS]
    for j, (n, _, at) in enumerate(by_place):
        free = sum(1 for _, _, other in by_place[:j] if other + GRAM <= at)  # so many grams end before this one begins
        row = list(best[j])
        for k in range(1, PIVOTS + 1):
            before = best[free][k - 1]
            if before is not None and (row[k] is None or before[0] + n < row[k][0]):
                row[k] = (before[0] + n, (*before[1], j))
        best.append(row)
    chosen = best[-1][PIVOTS]
    return [(by_place[j][1], by_place[j][2]) for j in chosen[1]]


def gram_counts(known: DataFrame) -> np.ndarray:
    """How many grams of all words each bucket has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, memo = np.zeros(BUCKETS, np.int64), {}
        for batch in batches:
            met = []
            for word in batch.column(0).to_pylist():
                for i in range(len(word) - GRAM + 1):
                    gram = word[i : i + GRAM]
                    if gram not in memo:
                        if len(memo) >= BUCKETS:
                            memo.clear()
                        memo[gram] = bucket(gram)
                    met.append(memo[gram])
                if len(met) > BUCKETS:
                    total += np.bincount(met, minlength=BUCKETS)
                    met = []
            total += np.bincount(np.array(met, np.int64), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in known.select("word").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def near_words(known: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: all ordered pairs of words of `known` (word, n; each word once) that differ by one inserted, deleted or replaced code point.

    Of two such words s and r, let s be the one whose prefix ends in the rarer gram. The edit leaves one of s's two pivots whole, as they don't
    overlap, and it is found in r's prefix: at the same place if the words are of a length, at the same place or one further where r is longer, at
    the same place or one before where r is shorter. So pivots are looked up by gram, length and place, and each pair met is verified in the join.
    Words have SHORTEST code points at least.
    """
    if known.where(F.length("word") < SHORTEST).limit(1).count():
        raise ValueError(f"words have {SHORTEST} code points at least")
    counts = known.sparkSession.sparkContext.broadcast(gram_counts(known))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(counts.value)
        for batch in batches:
            rows, lists, ends = [], {"prefix": [], "pivot": []}, {"prefix": [0], "pivot": [0]}
            for word in batch.column(0).to_pylist():
                (n, gram), prefix, chosen = grams.of(word)
                rows.append((n, gram))
                for name, found in (("prefix", prefix), ("pivot", chosen)):
                    lists[name] += [{"gram": g, "at": i} for g, i in found]
                    ends[name].append(len(lists[name]))
            kind = pa.struct([("gram", pa.string()), ("at", pa.int32())])
            columns = [pa.ListArray.from_arrays(pa.array(ends[k], pa.int32()), pa.array(lists[k], kind)) for k in ("prefix", "pivot")]
            last = pa.array([{"count": n, "gram": g} for n, g in rows], pa.struct([("count", pa.int64()), ("gram", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), last, *columns], ["word", "n", "last", "prefix", "pivot"])

    entry = "array<struct<gram: string, at: int>>"
    indexed = cut(known.select("word", "n").mapInArrow(index, f"word string, n long, last struct<count: bigint, gram: string>, prefix {entry}, pivot {entry}"))
    held = indexed.select(F.col("word").alias("r"), F.col("n").alias("n_r"), F.col("last").alias("last_r"), F.explode("prefix").alias("p"))
    held = held.select("r", "n_r", "last_r", F.col("p.gram").alias("gram"), F.col("p.at").alias("at"), F.length("r").alias("size"))
    asked = indexed.select(F.col("word").alias("s"), F.col("n").alias("n_s"), F.col("last").alias("last_s"), F.length("word").alias("own"), F.explode("pivot").alias("p"))
    where = F.array(*[F.struct((F.col("p.at") + at).alias("at"), (F.col("own") + more).alias("size")) for more, at in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))])
    asked = asked.select("s", "n_s", "last_s", F.col("p.gram").alias("gram"), F.explode(where).alias("w")).select("s", "n_s", "last_s", "gram", "w.at", "w.size").where("at >= 0")
    pairs = asked.join(held, ["gram", "at", "size"]).where((F.col("last_s") <= F.col("last_r")) & (F.col("s") != F.col("r")) & (F.levenshtein("s", "r", EDITS) == EDITS))
    once = pairs.select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b"), F.when(F.col("s") < F.col("r"), F.col("n_s")).otherwise(F.col("n_r")).alias("n_a"), F.when(F.col("s") < F.col("r"), F.col("n_r")).otherwise(F.col("n_s")).alias("n_b")).distinct()
    both = F.explode(F.array(F.struct("a", "b", "n_a", "n_b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"))))
    return once.select(both.alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of each word of `forms` (word, form) lead in the end. Forms grow more frequent, so there are no circles; each
    round doubles the steps that are followed, until no root has a form of its own."""
    left = forms.select("word", F.col("form").alias("root"))
    while True:
        left = cut(left)
        onward = left.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if left.join(onward, "root", "left_semi").isEmpty():
            return left
        left = left.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))


def variants(known: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of `known` (word, n; each word once). Near words differ by one code point. A word's form is its
    near word of largest n (ties: the smallest in code-point order), if that n is at least `ratio` times the word's; root follows forms to the last.

    Near words are grouped by a word after their pairs are aggregated, so a word with very many variants is no hot group.
    Very long words take part whole. Empty table: no rows.
    """
    if ratio < 2:
        raise ValueError("the ratio is 2 at least, so that forms lead to no circle")
    known = cut(known.where("word is not null"))
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")))
    near = near_words(known).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    found = known.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    held = F.col("form_n") >= ratio * F.col("n")
    found = cut(found.select("word", "n", "n_near", F.when(held, F.col("form")).alias("form"), F.when(held, F.col("form_n")).alias("form_n")))
    led = roots(found.where("form is not null"))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = 5, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """variants() of the words (see words()) that occur at least `least` times in all documents. Null and empty texts have no words, a null key counts as
    empty, repeated rows count each, very long texts count whole; other columns play no part, whatever their names. Empty table: no rows."""
    return variants(words(docs, key=key, text=text, **how).where(F.col("n") >= least))
