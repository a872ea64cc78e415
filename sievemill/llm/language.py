"""Language identification by hierarchical discrimination: the family first, then the language within it."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, tasks

#: Families of languages by ISO 639-1 code. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "an ast ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
    "baltic": "lt lv",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

WIDTH = 8192
TEXTS_AT_ONCE = 64
_alphabetic: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than letters as one 0, with a 0 at both ends."""
    global _alphabetic
    if _alphabetic is None:
        _alphabetic = np.array([chr(i).isalpha() for i in range(0x110000)])
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.concatenate([[0], np.where(_alphabetic[code], code, 0), [0]]).astype(np.uint32)
    return code[(code != 0) | np.concatenate([[True], code[:-1] != 0])]


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of WIDTH + 1 features of unit length for each text, and whether it has a letter.

    Features are the square roots of the counts of hashed runs of one to three letters (a gap between words counts as one),
    and a constant.
    """
    codes = [letters(t) for t in texts]
    size = np.array([len(c) for c in codes])
    code = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    of = np.repeat(np.arange(len(texts)) * WIDTH, size)
    cells, rolled = [], np.zeros(len(code), np.uint32)
    for n in range(3):
        ends = np.concatenate([np.zeros(n, np.uint32), code[: len(code) - n]]) if n else code
        rolled = rolled * np.uint32(0x01000193) + (ends + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
        inside = of == np.concatenate([np.full(n, -1), of[: len(of) - n]]) if n else code != 0
        scrambled = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        cells.append((of + (scrambled >> np.uint32(19)))[inside])
    counts = np.bincount(np.concatenate(cells), minlength=len(texts) * WIDTH)[: len(texts) * WIDTH].reshape(-1, WIDTH)
    x = np.sqrt(counts, dtype=np.float32)
    x /= np.maximum(np.sqrt(counts.sum(axis=1, dtype=np.float32)), 1)[:, None]
    return np.hstack([x, np.full((len(texts), 1), 0.1, np.float32)]), np.array([bool(c.any()) for c in codes], bool)


def separate(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Weights of a linear support vector machine with hinge loss, by dual coordinate descent. y is +1 or -1; classes weigh alike."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    most = np.where(y > 0, cost * len(y) / max(1, 2 * (y > 0).sum()), cost * len(y) / max(1, 2 * (y < 0).sum()))
    square = np.einsum("ij,ij->i", x, x)
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(y)):
            now = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / square[i], 0.0), most[i])
            if now != alpha[i]:
                w += (now - alpha[i]) * y[i] * x[i]
                moved, alpha[i] = max(moved, abs(now - alpha[i])), now
        if moved < 1e-3:
            break
    return w


def duel(rows: pd.DataFrame) -> pd.DataFrame:
    """The machine of one pair (level, a, b): positive for a."""
    rows = rows.sort_values("draw", kind="stable")
    x = np.empty((len(rows), WIDTH + 1), np.float32)
    for i in range(0, len(rows), TEXTS_AT_ONCE):
        x[i : i + TEXTS_AT_ONCE] = profiles(rows["text"].iloc[i : i + TEXTS_AT_ONCE].tolist())[0]
    w = separate(x, np.where(rows["is_a"], 1.0, -1.0))
    return pd.DataFrame({"level": rows["level"].iloc[:1], "a": rows["a"].iloc[:1], "b": rows["b"].iloc[:1], "w": [w.astype(np.float32)]})


class Model:
    """langs: {family: languages}; machines: {(level, a, b): weights}. Its size depends on the languages alone."""

    def __init__(self, langs: dict[str, list[str]], machines: dict[tuple[str, str, str], np.ndarray]):
        self.langs, self.machines = langs, machines

    def vote(self, level: str, names: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the name that wins most duels (then by the sum of margins), and how sure the closest of its duels is."""
        wins, sure = np.zeros((len(x), len(names))), np.ones((len(x), len(names)))
        for (i, a), (j, b) in itertools.combinations(enumerate(names), 2):
            margin = x @ self.machines[level, a, b]
            for k, m in ((i, margin), (j, -margin)):
                wins[:, k] += (m > 0) + 1e-3 * np.tanh(m)
                sure[:, k] = np.minimum(sure[:, k], 1 / (1 + np.exp(-3 * np.clip(m, -50, 50))))
        best = wins.argmax(axis=1)
        return best, sure[np.arange(len(x)), best]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        x, has_letter = profiles(texts)
        families = sorted(self.langs)
        if not families:
            return ["und"] * len(texts), np.zeros(len(texts))
        family, score = self.vote("", families, x)
        out = np.full(len(texts), "und", object)
        for f, name in enumerate(families):
            own = np.flatnonzero((family == f) & has_letter)
            if len(own):
                best, sure = self.vote(name, self.langs[name], x[own])
                out[own] = np.array(self.langs[name], object)[best]
                score[own] *= sure
        return out.tolist(), np.where(has_letter, score, 0.0)


def train(labelled: DataFrame, per_language: int = 800, text: str = "text", lang: str = "lang", seed: int = 3) -> Model:
    """Fit the machines on at most `per_language` texts of each language, drawn by hash; rows with a null text or language are
    left out. Each pair is fitted in a task of its own."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs: dict[str, list[str]] = {}
    for name in sorted(counts):
        langs.setdefault(FAMILY.get(name, name), []).append(name)
    if len(counts) < 2:
        return Model(langs, {})
    draw = F.xxhash64(F.lit(seed), "text")
    share = F.create_map(*[F.lit(v) for name, n in counts.items() for v in (name, min(1.0, 2.0 * per_language / n))])
    some = rows.withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("at") <= per_language)
    pairs = [("", f, g, langs[f], langs[g]) for f, g in itertools.combinations(sorted(langs), 2)]
    pairs += [(f, a, b, [a], [b]) for f, names in langs.items() for a, b in itertools.combinations(names, 2)]
    part = lambda level, a, b, is_a: F.struct(*[F.lit(v).alias(k) for k, v in (("level", level), ("a", a), ("b", b), ("is_a", is_a))])
    tables = {name: F.array(*[part(lv, a, b, name in left) for lv, a, b, left, right in pairs if name in left + right]) for name in counts}
    where: Column = F.lit(None)
    for name, table in tables.items():
        where = F.when(F.col("lang") == name, table).otherwise(where)
    dealt = some.select("text", "draw", F.inline(where)).repartition(tasks(labelled.sparkSession, len(pairs), 1), "level", "a", "b")
    fitted = dealt.groupBy("level", "a", "b").applyInPandas(duel, "level string, a string, b string, w array<float>").collect()
    return Model(langs, {(r["level"], r["a"], r["b"]): np.array(r["w"], np.float64) for r in fitted})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred (a language of the model; 'und' if the text is null or has no letter) and score (0 to 1).

    Only the text is read: the whole of it, whatever its length. Columns named lang_pred or score are replaced; all others stay.
    Empty table: no rows. A model of one language predicts it with score 1, a model of none always 'und' with score 0.
    """
    kept = docs.drop("lang_pred", "score")
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            for i in range(0, len(texts), TEXTS_AT_ONCE):
                langs, score = broadcast.value.predict([t.decode("utf-8", "replace") for t in texts[i : i + TEXTS_AT_ONCE]])
                some = batch.slice(i, TEXTS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(langs, pa.string()), pa.array(score)], [*some.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(predict, f"{fields}, lang_pred string, score double")
