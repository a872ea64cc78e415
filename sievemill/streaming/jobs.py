"""Structured Streaming jobs: the batch operators over streams of files, snapshots and validations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import scan


def stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder, with the schema of `like`; ts is event time, with the session's time zone."""
    out = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in out.columns else out


def quick_violations(files: DataFrame) -> DataFrame:
    """Security violations of each edited file as it comes; no state."""
    return scan.quick_scan(files, "security")


def daily(snapshots: DataFrame, late: str = "1 day") -> DataFrame:
    """Snapshots by project and day, given out when the watermark has passed the day."""
    out = snapshots.withWatermark("ts", late).groupBy("project", F.window("ts", "1 day").alias("w"))
    return out.agg(F.count("*").alias("snapshots"), F.sum("errors").alias("errors")).select("project", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "snapshots", "errors")


def sessions(validations: DataFrame, minutes: int = 30, late: str = "1 day") -> DataFrame:
    """Runs of a user's validations without a gap, given out when no more can come."""
    out = validations.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{minutes} minutes").alias("w"))
    return out.agg(F.count("*").alias("validations"), F.sum("errors").alias("errors")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "validations", "errors")


def once(knowledge: DataFrame, late: str = "1 day") -> DataFrame:
    """The first row of each pattern key (project, content) within the watermark."""
    return knowledge.withWatermark("ts", late).dropDuplicatesWithinWatermark(["project", "content"])


def known_advisories(dependencies: DataFrame, advisories: DataFrame, fresh: str = "24 hours") -> DataFrame:
    """A stream of dependencies (package, version, ts, maybe ecosystem) joined with the table of advisories, read anew for each batch. Where both name an ecosystem it must be the same. Advisories
    with `checked_at` match only dependencies seen from then on until `fresh` later: stale rows never match."""
    keys = [k for k in ("ecosystem", "package", "version") if k in dependencies.columns and k in advisories.columns]
    found = dependencies.join(advisories, keys)
    if "checked_at" in advisories.columns:
        found = found.where((F.col("checked_at") <= F.col("ts")) & (F.col("ts") < F.col("checked_at") + F.expr(f"INTERVAL {fresh}")))
    return found


LATEST = "session_id string, file_path string, score double, ts timestamp, event_id long, bucket int, batch long"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a way to name places in it: any that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _commits(spark: SparkSession, path: str) -> list[int]:
    """The batches whose commits are there, in order. A commit says in which batch each bucket was last written; a new one replaces those before it."""
    system, at = _files(spark, path)
    folder = at(f"{path}/commits")
    done = [s.getPath() for s in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(int(p.getName().split("=")[1]) for p in done if system.exists(at(f"{p.toString()}/_SUCCESS")))


def _where(spark: SparkSession, path: str) -> dict[int, int]:
    """The batch that last wrote each bucket."""
    done = _commits(spark, path)
    return {r["bucket"]: r["batch"] for r in spark.read.parquet(f"{path}/commits/batch={done[-1]}").collect()} if done else {}


def latest_table(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """What upsert_latest keeps at `path`: session_id, file_path, score, ts, event_id; of some buckets alone, if these are named."""
    held = [f"{path}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(_where(spark, path).items()) if buckets is None or bucket in buckets]
    table = spark.read.schema(LATEST).option("basePath", f"{path}/data").parquet(*held) if held else spark.createDataFrame([], LATEST)
    return table.drop("bucket", "batch")


def upsert_latest(validations: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> Callable:
    """Keeps the last score of each file in a table at `path` (see latest_table). Files are dealt into buckets by hash; a batch merges and writes the buckets that it has rows of, and no others, then
    commits where each bucket is now. What its buckets were before goes after that. A batch that is repeated after its commit does nothing; before it, it writes the same again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = _commits(spark, path)
        if number in done or done and done[-1] > number:
            return
        last = F.max_by(F.struct("score", "ts", "event_id"), F.struct("ts", "event_id")).alias("r")
        one = lambda rows: rows.groupBy("session_id", "file_path").agg(last).select("session_id", "file_path", "r.*")
        bucket = F.pmod(F.xxhash64("session_id", "file_path"), F.lit(buckets)).cast("int")
        new = one(batch)
        touched = [r["b"] for r in new.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return
        before = _where(spark, path)
        old = latest_table(spark, path, touched)
        merged = one(old.unionByName(new.select(old.columns))).withColumn("bucket", bucket)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={number}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={number}")
        system, at = _files(spark, path)
        for b in touched:
            if b in before:
                system.delete(at(f"{path}/data/batch={before[b]}/bucket={b}"), True)
        for n in done:
            system.delete(at(f"{path}/commits/batch={n}"), True)

    return validations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start


def moving_baseline(snapshots: DataFrame, late: str = "1 day") -> DataFrame:
    """Mean score of each project over seven days, sliding by a day, given out when the watermark has passed the window."""
    out = snapshots.withWatermark("ts", late).groupBy("project", F.window("ts", "7 days", "1 day").alias("w"))
    return out.agg(F.avg("score").alias("baseline"), F.count("*").alias("snapshots")).select("project", F.date_format("w.end", "yyyy-MM-dd").alias("until"), "baseline", "snapshots")


def session_totals(validations: DataFrame, minutes: int = 30, late: str = "1 day") -> DataFrame:
    """Each session without a gap of `minutes`: validations, their scores' sum, the last one's errors, its files (about as many)."""
    out = validations.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", f"{minutes} minutes").alias("w"))
    totals = out.agg(F.count("*").alias("validations"), F.sum("score").alias("score"), F.max_by("errors", F.struct("ts", "event_id")).alias("errors"), F.approx_count_distinct("file_path").alias("files"))
    return totals.select("session_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "validations", "score", "errors", "files")


class LateRows(StreamingQueryListener):
    """Counts what came after the watermark and was dropped, by the query's name or id: add it to spark.streams before the query starts. What an
    aggregate combines before it reaches the state (rows of one key in one task) counts once."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        name = progress.name or str(progress.id)
        self.dropped[name] = self.dropped.get(name, 0) + sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
