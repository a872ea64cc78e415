"""Cases that a review named."""

import random

from test_documents import brute_components

import corpus_pipeline
from sievemill.llm import neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_pairs(spark):
    """40 pairs of documents that differ in two words, with similarities from 0.77 to 0.88."""
    rng, rows = random.Random(11), []
    for i in range(40):
        text = [f"w{rng.randrange(10**6)}" for _ in range(80 + 2 * i)]
        rows.append((2 * i, " ".join(text), "en", "a", 1))
        text[20] = text[60] = "changed"
        rows.append((2 * i + 1, " ".join(text), "en", "a", 1))
    return spark.createDataFrame(rows, SCHEMA)


def test_near_duplicates_between_80_and_85(spark):
    docs = near_pairs(spark)
    _, at_80 = brute_components(docs, 80)
    _, at_85 = brute_components(docs, 85)
    assert sum(at_80[i] != at_85[i] for i in at_80) == 17
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == at_80
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, percent=85).collect()} == at_85
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()} == set(at_80.values())


def test_pipeline_keeps_texts_where_no_language_is_known(spark):
    rows = [(1, "some words", None, "a", 10), (2, None, None, "a", 0), (3, "12 - 34", None, "a", 7), (4, "漢字", None, "a", 2), (5, "", None, "a", 0), (None, "é", None, "a", 1)]
    got = corpus_pipeline.known_languages(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {tuple(r) for r in got.collect()} == {rows[0], rows[3], rows[5]}
