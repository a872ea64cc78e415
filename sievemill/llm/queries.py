"""The registered queries of the operators, with production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, html, language, lempelziv, neardup, packing, sentencepiece, sharding, spelling, suffixes, tokencounts, topk, whitening
from .shared import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 10) == 0)
    return brown.scores(docs, "held_out")


def training_rows(docs: DataFrame) -> DataFrame:
    """The labelled documents that language identification learns from."""
    return docs.where(crc_mod("doc_id", 3) != 1)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(training_rows(docs))
    return language.identify(docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text"), model).drop("text")


def op3_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempelziv.fingerprints(table(spark, sf_dir, "documents"))


def op4_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.stratified_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "stratum")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_hash (xxhash64 of the ids), decoded_crc32, round_trip (the decoded text is the text)."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = sentencepiece.decode(sentencepiece.encode(docs, model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op8_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


def op10_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), least=5, shortest=6, one_in=199)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), components=8)


QUERIES = {
    "op1_brown_scores": op1_brown_scores,
    "op2_language_id": op2_language_id,
    "op3_lz_fingerprints": op3_lz_fingerprints,
    "op4_sparse_suffixes": op4_sparse_suffixes,
    "op5_html_text": op5_html_text,
    "op6_stratified_shards": op6_stratified_shards,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_minhash_hamming": op8_minhash_hamming,
    "op9_exact_topk": op9_exact_topk,
    "op10_kk_packing": op10_kk_packing,
    "op11_token_counts": op11_token_counts,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_embedding_whitening": op13_embedding_whitening,
}

def folded(bit: int) -> int:
    """What a set bit of the lowest byte leaves in a crc32 after eight steps."""
    c = 1 << bit
    for _ in range(8):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


#: size and crc32 of the text of each document: bytes are folded into the checksum bit by bit, as each bit's share is known.
_FOLD = "c >> 8"
for _bit in range(8):
    _FOLD = f"xor({_FOLD}, (xor(c, x) >> {_bit} & 1) * {folded(_bit)})"
CRC = f"""
    spelt AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
    bytes AS (SELECT *, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM spelt),
    rows_ AS (SELECT doc_id, source, length(h) // 2 + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: {_FOLD}), 4294967295) AS text_crc32 FROM bytes)
"""

#: Each run of at least six letters of a document, lower-cased, with its checksum as above; then without the letter that it loses. Letters beyond ASCII
#: stand for one byte each where edits are counted.
SPELT = f"""
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS raw FROM documents),
    low AS (SELECT id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs WHERE length(raw) >= 6 GROUP BY 1, 2),
    hexed AS (SELECT *, hex(encode(id || ':' || run)) AS h FROM low),
    bytes AS (SELECT *, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM hexed),
    hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: {_FOLD}), 4294967295) AS h FROM bytes),
    typed AS (SELECT CASE WHEN h % 199 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
    narrow AS (SELECT word, n, length(word) AS size, translate(word, '{"".join(chr(0xC0 + i) for i in range(64))}', '{"".join(chr(0x21 + i) for i in range(64)).replace("'", "''")}') AS spelt FROM words)
"""

ORACLE = {
    "op6_stratified_shards": f"""
        WITH {CRC}, drawn AS (SELECT *, md5(concat_ws(':', 17, doc_id, text_crc32, size)) AS draw FROM rows_),
        ranked AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS share FROM drawn),
        placed AS (SELECT *, row_number() OVER (ORDER BY share, draw, doc_id, text_crc32, size, source) - 1 AS place, count(*) OVER () AS n FROM ranked),
        dealt AS (SELECT *, (place * 8 // n)::INT AS shard FROM placed)
        SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard, source AS stratum FROM dealt
    """,
    "op9_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS terms FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        SELECT q.vec_id AS query_id, CAST(row_number() OVER best AS INTEGER) AS rank, v.vec_id, CAST(list_inner_product(q.terms, v.terms) AS BIGINT) AS score
        FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
        WINDOW best AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.terms, v.terms) DESC, v.vec_id)
        QUALIFY row_number() OVER best <= 5
    """,
    "op12_spelling_variants": f"""
        WITH RECURSIVE {SPELT},
        near AS (SELECT a.word, a.n, b.word AS other, b.n AS n_other FROM narrow AS a JOIN narrow AS b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.word <> b.word AND levenshtein(a.spelt, b.spelt) = 1),
        best AS (SELECT word, count(*) AS n_near, max(n_other) AS most FROM near GROUP BY word),
        formed AS (SELECT near.word, min(other) AS form, any_value(most) AS form_n FROM near JOIN best USING (word) WHERE n_other = most AND most >= 5 * n GROUP BY near.word),
        led AS (SELECT word, form AS root, 1 AS step FROM formed UNION ALL SELECT led.word, formed.form, step + 1 FROM led JOIN formed ON led.root = formed.word),
        last AS (SELECT word, arg_max(root, step) AS root FROM led GROUP BY word)
        SELECT w.word, form, coalesce(last.root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n
        FROM words AS w LEFT JOIN best USING (word) LEFT JOIN formed USING (word) LEFT JOIN last USING (word)
    """,
}
