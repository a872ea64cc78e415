"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERIES_AT_ONCE = 64


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, queries x rows: one term (dimension) at a time, each query's weight times the term's posting list is
    scattered into dense arrays of scores. Zero weights are on no posting list."""
    scores = np.zeros((len(queries), len(rows)), np.int64)
    for term in np.flatnonzero((queries != 0).any(axis=0) & (rows != 0).any(axis=0)):
        weights = rows[:, term]
        asked = np.flatnonzero(queries[:, term])
        posting = np.flatnonzero(weights)
        if len(posting) * 2 > len(weights):  # a list of most rows: add the whole column
            scores[asked] += queries[asked, term, None] * weights
        else:
            scores[np.ix_(asked, posting)] += queries[asked, term, None] * weights[posting]
    return scores


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def best_of_block(k: int):
    def search(_, asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = []
        if len(asked) and len(block):
            block = block.sort_values("vec_id", kind="stable")
            width = max(max(map(len, asked["terms"])), max(map(len, block["terms"])))
            ids, rows = block["vec_id"].to_numpy(), matrix(block["terms"], width)
            for at in range(0, len(asked), QUERIES_AT_ONCE):
                part = asked.iloc[at : at + QUERIES_AT_ONCE]
                own = part["vec_id"].to_numpy()
                for query, score in zip(own, accumulate(matrix(part["terms"], width), rows), strict=True):
                    other = np.flatnonzero(ids != query)
                    if len(other) > k:  # partition selection: all that tie with the k-th best stay, then the smaller ids
                        least = np.partition(score[other], len(other) - k)[len(other) - k]
                        other = other[score[other] >= least]
                    other = other[np.argsort(-score[other], kind="stable")[:k]]
                    found.append((np.full(len(other), query), ids[other], score[other]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return search


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, terms: floor(scale * x) of each component; without null vectors or ids and vectors with null or non-finite components."""
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & sound).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("terms")
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block_rows: int = 8192, block_queries: int = 8192) -> DataFrame:
    """The k rows of `vectors` (vec_id, terms) with the greatest inner product with each query row, all other rows being scored.

    Queries and rows are dealt by hash into blocks of bounded size, and each pair of blocks is one group: a block of queries
    is sent to each block of rows. So a row is copied once for each `block_queries` queries, and a query once for each `block_rows`
    rows; equal sides copy least. A group returns k rows a query, and these are merged by rank.
    Returns query_id, rank, vec_id, score; fewer than k if there are fewer rows; ties go to the smaller vec_id.
    Rows with the query's own id are left out. Repeated rows: each counts as a candidate; a repeated query asks once. Equal rows are
    counted before they are dealt, and k of them at most go on, as no more can be among the k best: however often a row is repeated,
    no block grows by it. Null ids, null vectors and those with a null component take no part. Shorter vectors count as filled with zeros; a
    vector's length has no bound but that a block of them fits a task. Empty table: no rows.
    """
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.forall("terms", lambda c: c.isNotNull()))
    asked = vectors.where(is_query).dropDuplicates(["vec_id"])
    copies = F.posexplode(F.array_repeat(F.lit(0), F.least(F.col("_n"), F.lit(k)).cast("int"))).alias("_copy", "_")
    some = vectors.groupBy("vec_id", "terms").agg(F.count("*").alias("_n")).select("vec_id", "terms", copies).drop("_")
    n, m = vectors.count(), asked.count()
    blocks, sets = max(1, -(-n // block_rows)), max(1, -(-m // block_queries))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    deal = lambda count, *by: F.pmod(F.xxhash64("vec_id", "terms", *by), F.lit(count)).cast("int")
    rows = some.withColumn("_block", deal(blocks, "_copy")).withColumn("_set", every(sets)).drop("_copy")
    queries = asked.withColumn("_set", deal(sets)).withColumn("_block", every(blocks))
    found = (
        queries.groupBy("_set", "_block")
        .cogroup(rows.groupBy("_set", "_block"))
        .applyInPandas(best_of_block(k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
