"""Operators on documents against brute force, over odd rows, no rows and rows with clashing column names."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievemill.llm import brown, language, lempelziv, neardup, packing, sentencepiece, sharding, shared, suffixes
from sievemill.llm.graph import components

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHING = {"id": "x", "n": 1, "key": "k", "row": 2, "block": 3, "score": 0.5, "ids": "i", "hash": 4, "a": 5, "root": 6, "start": 7, "class": "c"}


def clashing(docs):
    return docs.withColumns({k: F.lit(v) for k, v in CLASHING.items()})


def tokens(text):
    return (text or "").encode().lower().split()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def by_text(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# -- near-duplicates --------------------------------------------------------------------------------------


def brute_components(docs, percent=85):
    sets = {}
    for i, text in by_text(docs):
        w = tokens(text)
        if i is not None:
            sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sorted(sets), 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[a] = root[b] = min(root[a], root[b])
    return sets, root


def test_near_duplicates_equal_brute_force(odd_docs):
    sets, root = brute_components(odd_docs)
    got = neardup.near_duplicates(clashing(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])


def test_chains_and_large_groups_of_near_copies(spark):
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):  # neighbours are alike, the ends of the chain aren't
        w = list(base)
        for j in range(i):
            w[(j * 13) % 200] = f"x{j}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, root = brute_components(docs)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == root


def test_no_documents(no_docs):
    assert rows_of(neardup.near_duplicates(no_docs)) == []
    assert rows_of(suffixes.repeated_spans(no_docs)) == []
    assert rows_of(lempelziv.fingerprints(no_docs)) == []
    assert rows_of(sharding.stratified_shards(no_docs)) == []
    assert rows_of(packing.pack(no_docs, BPE)) == []
    assert rows_of(sentencepiece.encode(no_docs, PIECES)) == []
    assert rows_of(language.identify(no_docs, language.train(no_docs))) == []
    assert rows_of(brown.scores(no_docs.withColumn("held", F.lit(False)), "held")) == []


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 9), (9, 1), (7, 7), (8, 3), (3, 8), (None, 2)], "a long, b long")
    assert dict(rows_of(components(links))) == {1: 1, 4: 1, 5: 1, 9: 1, 7: 7, 3: 3, 8: 3}
    chain = spark.createDataFrame([((i * 7) % 50, ((i + 1) * 7) % 50) for i in range(49)], "a long, b long")
    assert {r for _, r in rows_of(components(chain))} == {0}


# -- repeated passages ------------------------------------------------------------------------------------


def brute_cover(docs):
    first, whole, cover = {}, {}, {}
    n = suffixes.WORDS
    for i, text in sorted({x for x in by_text(docs) if x[0] is not None}):
        w = tokens(text)
        if len(w) >= n and tuple(w) in whole:
            cover[i] = set(range(len(w)))
            continue
        whole[tuple(w)] = i
        own = set()
        for x in range(len(w) - n + 1):
            d, at = first.setdefault(tuple(w[x : x + n]), (i, x))
            if d != i or x >= at + n:
                own.update(range(x, x + n))
        if own:
            cover[i] = own
    return cover


def test_repeated_passages_equal_brute_force(odd_docs, monkeypatch):
    want = brute_cover(odd_docs)
    for together in (suffixes.TOGETHER, 1):
        monkeypatch.setattr(suffixes, "TOGETHER", together)
        got = defaultdict(set)
        for r in suffixes.repeated_spans(clashing(odd_docs)).collect():
            got[r["doc_id"]].update(range(r["start"], r["start"] + r["words"]))
            assert r["source_doc_id"] <= r["doc_id"]
        assert got == want
    assert set(want) >= {7, 10}


def test_repeats_are_cut_out(odd_docs):
    want, seen = brute_cover(odd_docs), clashing(odd_docs)
    out = suffixes.without_repeats(seen)
    assert out.columns == seen.columns and out.count() == seen.count()
    before = {(r["doc_id"], r["text"]) for r in seen.collect()}
    for r in out.where("doc_id is not null").collect():
        text = next(t for i, t in before if i == r["doc_id"])
        kept = [w for k, w in enumerate((text or "").split(" ") if r["doc_id"] not in want else text.split()) if k not in want.get(r["doc_id"], ())]
        assert (r["text"] or "").split() == " ".join(kept).split()
        if r["doc_id"] not in want:
            assert r["text"] == text


# -- fingerprints -----------------------------------------------------------------------------------------


def slow_phrases(text):
    seen, phrase = set(), ""
    for letter in text:
        phrase += letter
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen | ({phrase} if phrase else set())


@pytest.mark.parametrize("block", [3, 1000])
def test_fingerprints(odd_docs, block):
    got = defaultdict(list)
    for r in lempelziv.fingerprints(clashing(odd_docs), block_rows=block).collect():
        got[r["doc_id"]].append(r)
    order = sorted(((i is not None, i or 0, t or "") for i, t in by_text(odd_docs)))
    assert sum(map(len, got.values())) == len(order)
    for (has, i, text), (_, _, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        r = next(r for r in got[i if has else None] if r["edited_sha256"] == sha and r["n_chars"] == len(text))
        assert r["fingerprint"] == lempelziv.text_of(lempelziv.fingerprint(text))
        assert r["edited_fingerprint"] == lempelziv.text_of(lempelziv.fingerprint(edited))
        own = slow_phrases(text)
        for name, other in (("near_edited", slow_phrases(edited)), ("near_next", slow_phrases(after))):
            share = len(own & other) / len(own | other) if own | other else 1.0
            assert r[name] == pytest.approx(share) if len(own | other) <= lempelziv.SIZE else abs(r[name] - share) < 0.3  # smallest hashes of few phrases are all of them
        assert len(r["fingerprint"]) // 16 == min(lempelziv.SIZE, len(slow_phrases(text)))


def test_likeness_estimates_the_share_of_phrases():
    a, b = "abracadabra " * 9, "abracadabra " * 8 + "hocus"
    x, y = slow_phrases(a), slow_phrases(b)
    near = lempelziv.likeness(lempelziv.fingerprint(a), lempelziv.fingerprint(b))
    assert near == pytest.approx(len(x & y) / len(x | y))


# -- packing ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_packing_places_every_id_once(odd_docs, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    got = packing.pack(clashing(odd_docs), path, group_bytes=30_000).collect()
    ids = Counter()
    for i, text in by_text(odd_docs):
        ids[i, tuple(library.encode(text or "", add_special_tokens=False).ids) + (1,)] += 1
    for (i, own), times in ids.items():
        parts = [r for r in got if r["doc_id"] == i and r["doc_tokens"] == len(own)]
        covered = Counter(k for r in parts for k in range(r["start"], r["start"] + r["length"]))
        assert set(covered) == set(range(len(own))) and set(covered.values()) == {times}
        for r in parts:
            part = b"".join(t.to_bytes(4, "little") for t in own[r["start"] : r["start"] + r["length"]])
            assert zlib.crc32(part) == r["ids_crc32"]
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048


def test_packing_numbers_rows_that_are_written(odd_docs):
    """Behind a shuffle, rows have no fixed order: the numbers that deal the groups must be those of rows read back, not of rows made anew."""
    found = packing.pack(odd_docs.repartition(5), BPE, group_bytes=30_000)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "LogicalRDD" in plan and "MapInArrow" not in plan
    whole = found.agg(F.sum("length")).first()[0]
    assert whole == packing.pieces(odd_docs, BPE).agg(F.sum("length")).first()[0]


def test_words_of_all_kinds_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BPE), packing.Tokenizer(BPE)
    assert own.by_words and own.border is not None and not packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.json")).by_words
    odd = ["", " \t", "It's \x00 a\x00b", "İSTANBUL ﬁne", "e\u0301 \u0301x", "a\u00a0b\u2003c\u200bd", "<|endoftext|>x", "x<|startoftext|> y", "漢字😀 12,5%", "A" * 3000, "ΑΣ ΑΣΑ"]
    odd += ["don't he'S I'M", "a <|STARTOFTEXT|> b", "x\x85y a\x1cb \x0b", "ª² ¼ ŉ ſ ȺǅǄ \u00ad", "A1b22c!!x--'s''t été"]
    for texts in (odd, [" ".join(odd)], odd):
        ids, first = own.encode([t.encode() for t in texts])
        for t, a, b in zip(texts, first, first[1:], strict=False):
            assert ids[a:b].tolist() == [*library.encode(t, add_special_tokens=False).ids, packing.END_ID]


def test_memo_forgets_what_is_rare():
    calls = []

    def learn(units):
        calls.extend(units)
        return np.array([ord(c) for u in units for c in u]), np.concatenate([[0], np.cumsum([len(u) for u in units])])

    memo = shared.Memo(learn, limit=4_000)
    rng = random.Random(2)
    for _ in range(300):
        units = ["the", "of"] * 3 + [f"w{rng.randrange(10**6)}" for _ in range(5)]
        ids, ends = memo.ids(units)
        assert "".join(map(chr, ids)) == "".join(units) and ends.tolist() == [0, *itertools.accumulate(map(len, units))]
    assert calls.count("the") == calls.count("of") == 1 and len(memo) < 40
    assert memo.ids([])[0].tolist() == []


def test_differencing():
    sets = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in s) for s in sets) == [14, 16]
    assert [sorted(s) for s in packing.difference([5], 3)] == [[0]] and packing.difference([], 2) == []
    rng = random.Random(5)
    for sizes in ([(i * 37) % 256 + 1 for i in range(700)], [rng.randrange(1, 2048) for _ in range(600)], [1500] * 100, [2047] * 30 + [1] * 9, [3], []):
        found = packing.windows(sizes, 2048)
        held = defaultdict(list)
        for window in found:
            assert 0 < sum(n for *_, n in window) <= 2048
            for i, start, n in window:
                held[i].append((start, n))
        assert len(held) == len(sizes)
        for i, parts in held.items():
            assert [s for s, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts)[:-1])] or len(parts) == 1
            assert sum(n for _, n in parts) == sizes[i]
        assert len(found) <= max(math.ceil(sum(sizes) / 2048), sum(sizes) * 1.01 // 2048)
        assert sum(map(len, found)) <= len(sizes) + 2 * len(found)  # few cuts
    whole = packing.windows([300] * 60, 2048)  # what fits whole isn't cut
    assert sum(map(len, whole)) <= 60 + len(whole)


# -- language ---------------------------------------------------------------------------------------------


def test_language_id(spark):
    texts = {
        "en": "the quick brown fox jumps over the lazy dog and then it runs through the woods with other animals",
        "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft dann durch den Wald mit anderen Tieren",
        "fr": "le rapide renard brun saute par-dessus le chien paresseux et court ensuite dans la forêt avec les autres",
        "es": "el rápido zorro marrón salta sobre el perro perezoso y luego corre por el bosque con los otros animales",
    }
    rows = [(i, " ".join(t.split()[i % 7 : i % 7 + 9]), lang) for lang, t in texts.items() for i in range(12)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=10)
    assert set(model.machines) == {("", "germanic", "romance"), ("germanic", "de", "en"), ("romance", "es", "fr")}
    asked = [(lang, t.upper() + " 123 !!") for lang, t in texts.items()] + [("und", None), ("und", ""), ("und", "12 34 ..")]
    out = language.identify(spark.createDataFrame([(want, t, 1) for want, t in asked], "lang string, text string, score int"), model).collect()
    assert [(r["lang"], r["lang_pred"]) for r in out] == [(want, want) for want, _ in asked]
    assert all(0 <= r["score"] <= 1 for r in out)
    one = language.train(spark.createDataFrame([(1, "word", "xx"), (2, None, "yy")], "doc_id long, text string, lang string"))
    assert one.predict(["anything", "1"])[0] == ["xx", "und"]


# -- scores -----------------------------------------------------------------------------------------------


def test_scores(odd_docs, monkeypatch):
    docs = clashing(odd_docs).withColumn("held", F.col("doc_id") % 5 == 0)
    for size in (brown.DICTIONARY, 20):
        monkeypatch.setattr(brown, "DICTIONARY", size)
        out = brown.scores(docs, "held").collect()
        check_scores(odd_docs, out)


def check_scores(odd_docs, out):
    count, texts = Counter(), by_text(odd_docs)
    for i, t in texts:
        if i is None or i % 5:
            count.update([*tokens(t), None])
    n, v = sum(count.values()), len(count)
    assert len(out) == len(texts)
    for i, t in texts:
        own = [*tokens(t), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        r = next(r for r in out if r["doc_id"] == i)
        assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == n and r["n_tokens"] == len(own)
        assert r["n_known"] == sum(count[w] > 0 for w in own) and r["held_out"] == (i is not None and i % 5 == 0)
        assert r["score"] < 0 and r["perplexity"] > 1


def test_scores_do_not_depend_on_partitions(odd_docs, monkeypatch):
    monkeypatch.setattr(brown, "DICTIONARY", 60)
    docs, seen = odd_docs.withColumn("held", F.col("doc_id") % 5 == 0), []
    for parts, held in ((1, 10**6), (7, 400), (64, 10**6)):
        monkeypatch.setattr(brown, "HELD", held)
        seen.append(sorted(map(repr, brown.scores(docs.repartition(parts), "held").collect())))
    assert seen[0] == seen[1] == seen[2]


def test_scores_equal_the_formula_for_given_classes(odd_docs):
    """The model's probabilities, worked out again from its classes and from counts by brute force."""
    given = {}
    classify = brown.classify

    def keep(leaders, classes, square):
        merge = classify(leaders, classes, square)

        def tap(batches):
            yield from merge(batches)

        return tap

    rows = by_text(odd_docs)
    docs = odd_docs.withColumn("held", F.col("doc_id") % 5 == 0)
    train = [tokens(t) for i, t in rows if i is None or i % 5]
    words = docs.where("not coalesce(held, false)").select("text")
    table = words.mapInArrow(brown.word_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    leaders = np.sort(brown.most_frequent(table, brown.LEADERS).column("hash").to_numpy().view(np.uint64))
    pairs = words.mapInArrow(brown.leader_pairs(leaders), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    classes, square = brown.cluster(pairs, len(leaders), 8)
    found = words.mapInArrow(brown.contexts(leaders, classes), "hash long, n long, contexts binary")
    for r in found.coalesce(1).sortWithinPartitions("hash").mapInArrow(keep(leaders, classes, square), "hash long, n long, class int").collect():
        given[r["hash"]] = r["class"]
    hash_of = lambda w: int(shared.Words([w]).hash.view(np.int64)[0])
    count, steps, before, in_class = Counter(), Counter(), Counter(), Counter()
    for text in train:
        last = brown.END
        for w in [*text, None]:
            count[w] += 1
            c = brown.END if w is None else given[hash_of(w)]
            steps[last, c] += 1
            before[last] += 1
            in_class[c] += 1
            last = c
    n = sum(count.values())
    unseen = min(max(sum(v == 1 for w, v in count.items() if w is not None) / n, 1e-9), 0.5)
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in brown.scores(docs, "held").collect()}
    for i, t in rows:
        last, want = brown.END, 0.0
        for w in [*tokens(t), None]:
            if not count[w]:
                want += math.log10(unseen)
                last = None
                continue
            c = brown.END if w is None else given[hash_of(w)]
            move = in_class[c] / n if last is None else (steps[last, c] + 10 * in_class[c] / n) / (before[last] + 10)
            want += math.log10((1 - unseen) * move * count[w] / in_class[c])
            last = c
        assert got[i, len(tokens(t)) + 1] == pytest.approx(want, rel=1e-9)


def test_most_frequent_words(spark):
    rows = [(int(h), n) for h, n in zip(shared.mix(np.arange(1, 3001, dtype=np.uint64)).view(np.int64), [1] * 2000 + [2] * 700 + [50] * 200 + [51] * 100, strict=True)]
    table = spark.createDataFrame(rows, "hash long, n long")
    for most in (50, 100, 150, 300, 1200, 5000):
        got = brown.most_frequent(table.repartition(3), most).to_pydict()
        assert min(most, 3000) - 10 <= len(got["n"]) <= most
        best = sorted((n for _, n in rows), reverse=True)
        assert sorted(got["n"], reverse=True) == best[: len(got["n"])]


def test_model_is_a_distribution(spark):
    rows = [(i, f"the {a} {b}") for i, (a, b) in enumerate(itertools.product(["red", "blue", "old"], ["cat", "dog", "sun"]))]
    rows += [(100, "cat"), (101, "zzz"), (102, "")] + [(103 + i, w) for i, w in enumerate(["the", "red", "blue", "old", "dog", "sun"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.col("doc_id") >= 100)
    p = {r["doc_id"]: 10 ** r["score"] for r in brown.scores(docs, "held").collect()}
    # P(text) = P(w | start) P(end | w); all one-word texts and the empty one are less than everything
    assert 0 < sum(p[i] for i in p if i >= 100) < 1
    assert p[103] > p[101]


# -- shards -----------------------------------------------------------------------------------------------


def test_shards_are_those_of_the_law(spark, odd_docs):
    rows = [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()), r["source"]) for r in odd_docs.collect()]
    draw = {r: hashlib.md5(":".join(str(v) for v in (17, r[0], r[2], r[1]) if v is not None).encode()).hexdigest() for r in rows}
    strata = {}
    for r in sorted(rows, key=lambda r: (draw[r], r[0] is not None, r[0] or 0)):
        strata.setdefault(r[3], []).append(r)
    shares = sorted(((k + 0.5) / len(held), draw[r], r[0] is not None, r[0] or 0, s is None, s or "", k, r) for s, held in strata.items() for k, r in enumerate(held))
    shards, want = Counter(), Counter()
    for place, (*_, r) in enumerate(shares):
        shard = place * 3 // len(shares)
        want[(*r, shard, shards[shard])] += 1
        shards[shard] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "size", "text_crc32", "stratum", "shard", "slot")) for r in sharding.stratified_shards(odd_docs, shards=3).collect()) == want


def test_shards(spark, odd_docs):
    many = odd_docs.union(spark.range(500).selectExpr("id + 1000", "cast(id as string)", "'en'", "if(id % 3 = 0, 'hot', 's' || id % 7)", "0L"))
    out = sharding.stratified_shards(clashing(many)).collect()
    assert len(out) == many.count()
    size = Counter(r["shard"] for r in out)
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 1
    for s in size:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(size[s]))
    strata, mixed = Counter(r["stratum"] for r in out), Counter((r["stratum"], r["shard"]) for r in out)
    assert all(abs(mixed[k, s] - n * size[s] / len(out)) <= 2 for k, n in strata.items() for s in size)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in by_text(many))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want


# -- SentencePiece ----------------------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(spark, odd_docs):
    import sentencepiece as library

    lib = library.SentencePieceProcessor(model_file=PIECES)
    out = sentencepiece.decode(sentencepiece.encode(clashing(odd_docs), PIECES), PIECES).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        assert r["ids"] == (None if r["text"] is None else lib.encode(r["text"]))
        assert r["decoded"] == r["text"]
    model = sentencepiece.model_of(PIECES)
    for text in ["a" * 300, "  two  spaces ", "tab\tand\nline", "▁x▁", "<unk> </s>", "abc" * 99 + " 漢"]:
        ids, start = model.encode([text, "", text])
        assert ids.tolist() == lib.encode(text) * 2 and model.decode(ids, start) == [lib.decode(lib.encode(text)), "", lib.decode(lib.encode(text))]
    none = spark.createDataFrame([(1, None), (2, []), (3, [3, 198, 300])], "a int, ids array<int>")
    assert [r["decoded"] for r in sentencepiece.decode(none, PIECES).orderBy("a").collect()] == [None, "", lib.decode([3, 198, 300])]
    assert sentencepiece.decode(none.where("false"), PIECES).collect() == []
