"""Token counts, spelling variants and whitening against libraries and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievemill.llm import spelling, tokencounts, whitening

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "abcdefghijklmnopqrstuvwxyzéèàü"


# -- token counts ------------------------------------------------------------------------------------------


def library_counts(texts, limit=512):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [(len((t or "").encode()), len(e.ids), len(e.ids) > limit) for t, e in zip(texts, found, strict=True)]


def odd_texts():
    rng = random.Random(8)
    chars = ["a", "B", "é", "漢", "😀", "1", "²", "Ⅷ", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\u0085", "'", "'s", "'ll", "!", "_", "՘", "\U0003fc3f", "<|endoftext|>", "<|", "́", "‍"]
    texts = [None, "", " ", "\n \n", "it's  here <|endoftext|><|endoftext|> and there", "<|endoftext|>", "word " * 5000, "x" * 30_000, "é" * 4000, "a1" * 9000]
    return texts + ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(300)]


def test_token_counts_equal_the_library(spark, monkeypatch):
    texts = odd_texts()
    rows = [(i if i else None, t, 1, "x") for i, t in enumerate(texts)] + [(5, texts[4], 1, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, unit string")
    want = sorted(map(repr, [(r[0], *c) for r, c in zip(rows, library_counts([r[1] for r in rows]), strict=True)]))
    for parts in (1, 3):
        assert sorted(repr(tuple(r)) for r in tokencounts.token_counts(table.repartition(parts), BYTES).collect()) == want
    assert tokencounts.token_counts(table.where("false"), BYTES).collect() == []


def test_tiers_and_blocks_do_not_change_counts(monkeypatch):
    texts = [t or "" for t in odd_texts()]
    want = [n for _, n, _ in library_counts(texts)]
    for cache, chars, long, block, frequent in ((10**8, 256, 10**7, 10**6, {}), (2000, 5, 100, 7, {" word": 1}), (0, 0, 0, 1, {"a": 1, "'s": 1})):
        for name, value in (("CACHE_BYTES", cache), ("CACHE_CHARS", chars), ("LONG", long), ("BLOCK", block)):
            monkeypatch.setattr(tokencounts, name, value)
        cutter = tokencounts.PreTokens(BYTES)
        lengths = tokencounts.Lengths(cutter.library, tokencounts.unpacked(tokencounts.packed(frequent)))
        got = [sum(beside + int(lengths.of(units).sum()) for units, beside in cutter.blocks(t)) for t in texts]
        assert got == want


def test_a_tokenizer_of_another_kind(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [t or "" for t in odd_texts()[:40]]
    known = Tokenizer.from_file(path)
    got = tokencounts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(known.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


# -- spelling variants -------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def slow_variants(counts, ratio=5):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out, key=repr)


def test_variants_equal_brute_force(spark):
    rng = random.Random(2)
    for seed in range(3):
        few = LETTERS[:3] if seed == 0 else LETTERS
        counts = {"".join(rng.choice(few) for _ in range(rng.randrange(4, 12))): rng.choice([1, 1, 5, 25, 125, 700]) for _ in range(120)}
        for w in list(counts):
            for _ in range(4):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                changed = w[:at] + ("" if kind == 0 else rng.choice(few)) + w[at + (kind < 2) :]
                if len(changed) >= 4:
                    counts.setdefault(changed, rng.choice([1, 2, 5, 25]))
        counts |= {"aaaaaaaa": 9, "aaaaaaaaa": 45, "aaaaaaaaaa": 9, "a" * 3000: 2, "a" * 3001: 10, "a" * 1500 + "b" + "a" * 1500: 10, "abababab": 3, "babababa": 15, "ababababa": 15}
        got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
        assert sorted(map(tuple, got.collect()), key=repr) == slow_variants(counts)


def test_pivots_are_the_rarest_grams_that_do_not_overlap():
    rng = random.Random(6)
    for _ in range(200):
        at = sorted(rng.sample(range(12), 3))
        prefix = [(rng.randrange(9), f"g{i}", i) for i in at]
        best = min((a[0] + b[0] for a in prefix for b in prefix if b[2] - a[2] >= 2), default=None)
        found = spelling.pivots(rng.sample(prefix, 3))
        cost = {g: n for n, g, _ in prefix}
        assert found[1][1] - found[0][1] >= 2 and sum(cost[g] for g, _ in found) == best


def test_words_of_documents(spark):
    text = "Straße STRASSE naïve×naïves don't colour COLOUR ab"
    rows = [(i, text, "w", 3) for i in range(250)] + [(7, text, "w", 3), (None, text, "w", 3), (8, None, "w", 3), (9, "", "w", 3), (10, "x" * 50_000 + " longer", "w", 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    counts = {}
    import re

    for i, t, *_ in rows:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] = counts.get(run, 0) + 1
    assert {r["word"]: r["n"] for r in spelling.words(table).collect()} == counts and len(counts) > 5
    often = {w: n for w, n in counts.items() if n >= 5}
    assert sorted(map(tuple, spelling.spelling_variants(table).collect()), key=repr) == slow_variants(often)
    assert spelling.spelling_variants(table.where("false")).collect() == []
    with pytest.raises(ValueError):
        spelling.near_words(spark.createDataFrame([("abc", 1)], "word string, n long"))


def test_long_chains_lead_to_their_root(spark):
    chain = [("abcdefgh"[: 8 - k] + "z" * k, 2 * 5**k) for k in range(9)]
    got = spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()
    assert {r["root"] for r in got} == {"z" * 8} and sum(r["form"] is not None for r in got) == 8


# -- whitening ---------------------------------------------------------------------------------------------


def held(rows, k=8):
    sound = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in sound), default=0)
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] + [100_000] * (width - len(v)) for _, v in sound], object)
    n, s = len(x), x.sum(axis=0)
    centred = np.array(x - s / n, float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[: min(k, width)]
    return [i for i, _ in sound], ((n * x - s) ** 2).sum(axis=1), centred, values[order], axes[:, order], values.sum()


def compare(spark, rows, parts=3):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, component string, n int").repartition(parts)
    got = whitening.whitened(table).collect()
    ids, deviation, centred, values, axes, trace = held(rows)
    k = len(values)
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {len(ids)} and len({r["identity_error"] for r in got}) == 1
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == sorted(zip(ids, deviation.tolist(), strict=True))
    for c in range(k):
        own = {r["vec_id"]: r for r in got if r["component"] == c + 1}
        assert all(abs(r["explained"] - (values[c] / trace if trace else 0)) < 1e-9 for r in own.values())
        apart = min([abs(values[c] - v) for j, v in enumerate(values) if j != c], default=1)
        if values[c] > 1e-6 and apart > 1e-6 * values[0]:
            want = dict(zip(ids, centred @ axes[:, c] / np.sqrt(values[c]), strict=True))
            sign = np.sign(sum(own[i]["whitened"] * want[i] for i in want))
            assert max(abs(own[i]["whitened"] * sign - want[i]) for i in want) < 1e-8
        if values[c] < 1e-9:
            assert all(r["whitened"] is None and r["explained"] == 0 for r in own.values())
    assert got[0]["identity_error"] < 1e-8
    return got


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13) / 40).tolist()) for i in range(300)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (404, rows[0][1]), (405, rows[0][1])]
    compare(spark, rows)
    compare(spark, rows[:300] + [(500 + i, [0.5]) for i in range(20)] + [(600, [])], 5)  # short vectors
    narrow = [(i, rng.normal(size=3).tolist()) for i in range(50)]
    compare(spark, narrow)
    compare(spark, [(i, [v[0], v[1], v[0], 0.25, 0.25, 0.25, 0.25, 0.25, 0.25]) for i, v in narrow])  # no variance in most directions
    compare(spark, [(1, [0.5, 0.25])])
    twin = [(i, [float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)]) for i in range(8)]  # equal eigenvalues
    got = compare(spark, twin)
    y = np.array([[next(r["whitened"] for r in got if (r["vec_id"], r["component"]) == (i, c)) for c in (1, 2, 3)] for i in range(8)])
    assert np.abs(y.T @ y / 8 - np.eye(3)).max() < 1e-9


def test_whitening_of_nothing_and_of_huge_entries(spark):
    none = spark.createDataFrame([(1, None), (2, [None])], "vec_id long, embedding array<float>")
    assert whitening.whitened(none).collect() == [] and whitening.whitened(none.where("false")).collect() == []
    huge = spark.createDataFrame([(i, [float(i) * 1e9, 1e300]) for i in range(4)] + [(None, [0.0, 1e300])], "vec_id long, embedding array<double>")
    got = whitening.whitened(huge).collect()
    assert len(got) == 10 and all(r["deviation"] is None or r["deviation"] >= 0 for r in got) and any(r["deviation"] is None for r in got)


def test_eigenvectors_of_hard_matrices():
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    for values in ([5.0] * 20 + [1.0] * 20, np.arange(40.0), [1 + 1e-9 * i for i in range(40)], [1.0] + [0.0] * 39, [10.0**-i for i in range(40)]):
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        found, axes = whitening.leading_vectors(a, 8)
        assert np.abs(np.sort(found)[::-1] - np.sort(np.linalg.eigvalsh(a))[::-1][:8]).max() < 1e-13 * 40
        assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-10
        assert np.abs(a @ axes - axes * found).max() < 1e-12 * 40
    for a in (np.zeros((3, 3)), np.eye(3), np.diag([3.0, 1.0, 2.0]), np.array([[2.0]]), np.array([[0.0, 1.0], [1.0, 0.0]])):
        found, axes = whitening.leading_vectors(a, len(a))
        assert np.abs(a @ axes - axes * found).max() < 1e-12 and np.abs(axes.T @ axes - np.eye(len(a))).max() < 1e-12


def test_partial_squares_meet_in_a_tree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(90)]
    monkeypatch.setattr(whitening, "MERGE_BYTES", 1)
    compare(spark, rows, 11)
