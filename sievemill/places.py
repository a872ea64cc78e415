"""Lineage cuts and places in an order over any number of tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Where it is unset, one of the driver's own will do on one machine, as
    in tests; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="sievemill-")


def free_name(name: str, taken: list[str]) -> str:
    """A column name that isn't taken."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def position(df: DataFrame, order: list[str], name: str, group: str | None = None, parts: int | None = None) -> DataFrame:
    """df with `name`, the row's place from 0 in `order`, within `group` (a non-null leading column of order) or over all rows.

    Rows are range-partitioned and sorted, then each partition's rows are offset by the counts of the partitions
    before it. No task sees more than its range, however large a group is; only the counts (a row per partition
    and group in it) meet in a window.
    """
    ordered = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    ordered = cut(
        ordered.sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    keys = ["_part"] + ([group] if group else [])
    counts = ordered.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*([group] if group else [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return ordered.join(counts, keys).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


#: Characters of text that rows of one task come from, on average, and how many a row counts as besides its text: short rows take memory for their columns.
TASK_CHARS, ROW_CHARS = 1 << 23, 64


def dealt(rows: DataFrame, files: DataFrame, made: Column, key: str = "file_id", chars: int = TASK_CHARS) -> DataFrame:
    """Rows made of files (code), `made` of each file, dealt by key to as many tasks as the files' characters and rows ask for, so that a task's memory stays as it is however many files there
    are and however short the rows. Partitions that are asked for by number aren't merged by their size, which is that of compressed rows."""
    spark = rows.sparkSession
    n = files.agg(F.sum(F.length("code") + made.cast("long") * ROW_CHARS)).first()[0] or 0
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-n // chars)), key)
