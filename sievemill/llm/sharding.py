"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import position


def stratified_shards(docs: DataFrame, shards: int = 8, seed: int = 17, key: str = "doc_id", text: str = "text", stratum: str = "source") -> DataFrame:
    """Put each row into one of `shards` shards whose row counts differ by one at most and whose mixtures of strata match.

    Rows are shuffled by a seeded hash (md5 of seed, key, checksum and size, so that any engine gives the same shards) and ranked within their stratum; (rank + 1/2) / (rows of the stratum) spreads each
    stratum evenly over the unit interval. The order of these fractions is cut into equal runs of rows, so every shard
    holds its share of each stratum to within one row.

    Returns key, size (UTF-8 bytes of the text plus 1), text_crc32, stratum, shard, slot (gapless from 0 in the shard).
    Ties: by key, checksum, size and stratum; rows equal in all of these are alike. Null text: size 1, crc 0. Null stratum: a stratum of its own. Null keys and repeated rows are rows like others.
    Empty table: no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    binary = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(binary) + 1).cast("long").alias("size"),
        F.crc32(binary).alias("text_crc32"),
        F.when(F.col(stratum).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(stratum).cast("string"))).alias("_stratum"),
    ).withColumn("_draw", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), "text_crc32", "size")))
    order = ["_draw", "doc_id", "text_crc32", "size"]
    ranked = position(rows, ["_stratum", *order], "_rank", group="_stratum")
    sizes = ranked.groupBy("_stratum").agg(F.count("*").alias("_of"))
    spread = ranked.join(sizes, "_stratum").withColumn("_share", (F.col("_rank") + 0.5) / F.col("_of"))
    placed = position(spread, ["_share", *order, "_stratum"], "_place")
    total = placed.agg(F.count("*").alias("_all"))
    return (
        placed.join(F.broadcast(total))  # one row
        .withColumn("shard", F.expr(f"cast((_place * {shards}) div _all as int)"))
        .select(
            "doc_id", "size", "text_crc32",
            F.when(F.col("_stratum") != "-", F.expr("substring(_stratum, 2)")).alias("stratum"),
            "shard", (F.col("_place") - F.expr(f"(shard * _all + {shards - 1}) div {shards}")).alias("slot"),
        )
    )
