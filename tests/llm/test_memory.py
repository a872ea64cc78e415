"""What Python workers hold: an executor's memory is theirs beside the JVM's, and workers outlive their tasks."""

import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from test_reviewed import SCHEMA

import corpus_pipeline
from sievemill.llm import language, packing, shared, suffixes

ROOT = Path(__file__).resolve().parents[2]

KEPT = """
import re
import numpy as np, pyarrow as pa
from sievemill.llm import neardup, suffixes

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches(n):
    rng = np.random.default_rng(1)
    some = pa.array([" ".join(f"w{k}" for k in rng.integers(0, 10**5, 300)) for _ in range(100)])
    for k in range(n):
        texts = pa.DictionaryArray.from_arrays(pa.array(rng.integers(0, 100, 10_000).astype(np.int32)), some).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(range(10_000), pa.int64()), texts], ["doc_id", "text"])

before = held()
for step in (neardup.summarise, suffixes.sketch):
    assert sum(b.num_rows for b in step(batches(3))) == 30_000
print(held() - before)
"""


def texts(n, words):
    rng = random.Random(8)
    return [" ".join(f"w{rng.randrange(10**5)}" for _ in range(words)) for _ in range(n)]


def test_texts_become_pythons_a_piece_at_a_time():
    some = texts(50, 300)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([*some, None, ""] * 200)[:10_000]], ["doc_id", "text"])
    tracemalloc.start()
    try:
        found = [(piece.num_rows, sum(map(len, own))) for piece, own in shared.chunks([batch])]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(n for n, _ in found) == 10_000 and sum(n for _, n in found) > 15_000_000 and max(n for _, n in found) <= shared.CHUNK
    assert peak < 3 * shared.CHUNK


def test_workers_give_back_what_arrow_held():
    done = subprocess.run([sys.executable, "-c", KEPT], cwd=ROOT, capture_output=True, text=True, check=True)
    assert float(done.stdout) < 90


def test_texts_without_passages_leave_in_pieces():
    some = texts(50, 300)
    span = [{"start": 10, "words": 50}]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(10_000)), pa.array(some * 200), pa.array([span, None] * 5_000, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())])))], ["doc_id", "text", "spans"]
    )
    out = list(suffixes.cut_out(1, 2)([batch]))
    assert [n for b in out for n in b.column(0).to_pylist()] == list(range(10_000)) and max(b.nbytes for b in out) < 2 * shared.CHUNK
    want = [" ".join(t.split()[:10] + t.split()[60:]) if i % 2 == 0 else t for i, t in enumerate(some)]
    assert [t for b in out for t in b.column(1).to_pylist()] == want * 200


def test_language_stage_sends_each_text_once(spark, monkeypatch):
    rows = [(i, f"the words of text number {i}" if i % 2 else f"die Wörter von Text Nummer {i}", "en" if i % 2 else "de", "a", 1) for i in range(30)] + [(30, "12", "en", "a", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sent, real = [], language.identify
    monkeypatch.setattr(language, "identify", lambda frame, *a, **b: sent.append(frame.schema.simpleString()) or real(frame, *a, **b))
    out = corpus_pipeline.known_languages(spark, docs, "")
    assert sent[0].count("string") == 3
    assert out.columns == docs.columns and out.dtypes == docs.dtypes and {tuple(r) for r in out.collect()} == set(rows[:30])


def test_tokenizer_remembers_within_its_bound():
    known = packing.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(10):
        known.encode([" ".join(f"x{k}y{i}" for i in range(45_000)).encode()])
    assert 0 < known.memo.bytes.sum() < 80_000_000
