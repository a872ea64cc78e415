"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(links: DataFrame) -> DataFrame:
    """id, root (the smallest id that links lead to) of every id in `links` (a, b; any order, repeats and loops allowed).

    Each id hooks onto its smallest smaller neighbour, chains are shortened to a quarter by pointer jumping, and the links are
    then drawn between where the ids hang; this repeats until none is left. Ids never meet in the driver, and an id with very many
    links is aggregated before it is shuffled.
    """
    ordered = links.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = cut(ordered.distinct())
    left, levels = first.where("a < b"), []
    while not left.isEmpty():
        parent = left.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        for _ in range(2):
            parent = parent.join(parent.select(F.col("v").alias("p"), F.col("p").alias("q")), "p", "left").select("v", F.coalesce("q", "p").alias("p"))
        levels.append(parent := cut(parent))
        left = cut(follow(follow(left, parent, "a"), parent, "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = first.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id"))
    for parent in levels:
        roots = follow(roots, parent, "root")
    return cut(roots)


def follow(rows: DataFrame, parent: DataFrame, name: str) -> DataFrame:
    """rows with the ids in column `name` replaced by what they hang on."""
    others = [c for c in rows.columns if c != name]
    return rows.join(parent, rows[name] == parent["v"], "left").select(*others, F.coalesce("p", name).alias(name))
