"""Trends, forecasts and alerts over quality snapshots (project, ts, score, passed, errors, warnings, infos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..places import position


def recent(snapshots: DataFrame, asof: str, days: int, project: str | None = None) -> DataFrame:
    """Snapshots of the `days` days up to `asof`, of one project or all. A filter on ts alone, so that it prunes partitions by day."""
    end = F.lit(asof).cast("timestamp")
    found = snapshots.where((F.col("ts") > end - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") <= end))
    return found.where(F.col("project") == project) if project else found


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Append to a table with a folder for each day."""
    snapshots.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_snapshots(spark, path: str, asof: str, days: int, project: str | None = None) -> DataFrame:
    """Snapshots of the last days of a table that write_snapshots wrote; only the folders of these days are read."""
    table = spark.read.parquet(path)
    last = F.to_date(F.lit(asof).cast("timestamp"))
    return recent(table.where((F.col("day") >= F.date_sub(last, days)) & (F.col("day") <= last)), asof, days, project)


def direction(change: Column, by: float) -> Column:
    return F.when(change > by, "improving").when(change < -by, "declining").otherwise("stable")


def numbered(rows: DataFrame, newest_first: bool = False) -> DataFrame:
    """rows with n (of the project) and i, the place in time from 0. Tasks hold ranges of (project, time), so no project is one task."""
    known = rows.withColumn("_group", F.coalesce(F.concat(F.lit("p"), F.col("project").cast("string")), F.lit("")))
    placed = position(known, ["_group", "ts", "event_id"], "i", group="_group")
    out = placed.join(placed.groupBy("_group").agg(F.count("*").alias("n")), "_group").drop("_group")
    return out.withColumn("i", F.col("n") - 1 - F.col("i")) if newest_first else out


def trend(snapshots: DataFrame, asof: str, days: int) -> DataFrame:
    """Count, average, least and greatest score and pass rate of each project."""
    return recent(snapshots, asof, days).groupBy("project").agg(
        F.count("*").alias("snapshots"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"),
    )


def score_trend(snapshots: DataFrame) -> DataFrame:
    """Mean of the later half of a project's scores less that of the earlier: improving or declining from 0.05 on."""
    half = F.col("i") >= F.floor(F.col("n") / 2)
    out = numbered(snapshots).groupBy("project").agg(F.avg(F.when(~half, F.col("score"))).alias("before"), F.avg(F.when(half, F.col("score"))).alias("after"))
    change = F.coalesce(F.col("after") - F.col("before"), F.lit(0.0))
    return out.select("project", change.alias("change"), direction(change, 0.05).alias("trend"))


def forecast(snapshots: DataFrame, days_ahead: int = 7) -> DataFrame:
    """Least-squares line of the score over the place in time, its value `days_ahead` places on (0 to 1), and R squared, discounted
    below 30 snapshots."""
    place = F.col("i").cast("double")
    out = numbered(snapshots).groupBy("project").agg(
        F.count("*").alias("n"), F.max_by("score", F.struct("ts", "event_id")).alias("current"), F.regr_slope("score", place).alias("slope"),
        F.regr_intercept("score", place).alias("intercept"), F.regr_r2("score", place).alias("r2"),
    )
    slope = F.when(F.col("n") < 2, 0.0).otherwise(F.col("slope"))
    ahead = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + days_ahead)
    return out.select(
        "project", "current", slope.alias("slope"), F.when(F.col("n") < 2, F.col("current")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ahead))).alias("predicted"),
        F.when(F.col("n") < 2, 0.0).otherwise(F.col("r2") * F.least(F.lit(1.0), F.col("n") / 30)).alias("confidence"), direction(slope, 0.005).alias("trend"),
    )


def velocity(snapshots: DataFrame) -> DataFrame:
    return forecast(snapshots).select("project", F.col("slope").alias("velocity"))


def baseline(snapshots: DataFrame, asof: str, days: int = 7, last: int = 10) -> DataFrame:
    """Average of a project's last scores of the last days; none for fewer than 3 snapshots."""
    rows = numbered(recent(snapshots, asof, days), newest_first=True).where(f"n >= 3 and i < {last}")
    return rows.groupBy("project").agg(F.avg("score").alias("baseline"))


def quality_drift(snapshots: DataFrame, baselines: DataFrame, by: float = 0.15) -> DataFrame:
    """Snapshots whose score is more than `by` below the project's baseline."""
    drop = F.col("baseline") - F.col("score")
    return snapshots.join(F.broadcast(baselines), "project").where(drop > by).select("event_id", "project", drop.alias("drop"))


def regression_alerts(snapshots: DataFrame, window: int = 7) -> DataFrame:
    """Projects whose last `window` scores average 0.05 (warning) or 0.15 (critical) less than all before."""
    late = F.col("i") < window
    out = numbered(snapshots, newest_first=True).where(f"n > {window}").groupBy("project").agg(
        (F.avg(F.when(~late, F.col("score"))) - F.avg(F.when(late, F.col("score")))).alias("drop")
    )
    severity = F.when(F.col("drop") >= 0.15, "critical").when(F.col("drop") >= 0.05, "warning")
    return out.select("project", "drop", severity.alias("severity")).where("severity is not null")


def compare_projects(snapshots: DataFrame) -> DataFrame:
    """Best and worst project by average score (ties: the first name), and the average of the averages."""
    averages = snapshots.groupBy("project").agg(F.avg("score").alias("avg_score"))
    return averages.agg(
        F.min_by("project", F.struct(-F.round("avg_score", 9), F.col("project"))).alias("best"), F.min_by("project", F.struct(F.round("avg_score", 9), F.col("project"))).alias("worst"),
        F.avg("avg_score").alias("avg_score"), F.count("*").alias("projects"),
    )


def timeline(snapshots: DataFrame) -> DataFrame:
    """Each project's scores in time as rows, with the project's trend."""
    return snapshots.select("project", "ts", "event_id", "score").join(score_trend(snapshots).withColumnRenamed("project", "_project"), F.col("project").eqNullSafe(F.col("_project"))).select(
        "project", "ts", "event_id", "score", "trend"
    )


def timeline_ends(snapshots: DataFrame) -> DataFrame:
    """Each project's number of scores, the first and the current one and the average."""
    at = F.struct("ts", "event_id")
    return snapshots.groupBy("project").agg(F.count("*").cast("int").alias("points"), F.min_by("score", at).alias("first"), F.max_by("score", at).alias("current"), F.avg("score").alias("average"))


def severity_share(snapshots: DataFrame) -> DataFrame:
    """Errors, warnings and infos as rows (project, severity, n), with the project's share."""
    rows = snapshots.groupBy("project").agg(*[F.sum(c).alias(c) for c in ("errors", "warnings", "infos")]).unpivot("project", ["errors", "warnings", "infos"], "severity", "n")
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("project")))


def daily(snapshots: DataFrame) -> DataFrame:
    """Snapshots rolled up by project and day; also the form that the streaming job gives."""
    return snapshots.groupBy("project", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("snapshots"), F.avg("score").alias("avg_score"), F.sum("errors").alias("errors")).select(
        "project", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "snapshots", "avg_score", "errors"
    )


def moving_average(snapshots: DataFrame, days: int = 7) -> DataFrame:
    """Average of each project over windows of `days` days that slide by a day; complete windows only."""
    out = snapshots.groupBy("project", F.window("ts", f"{days} days", "1 day").alias("w")).agg(F.avg("score").alias("avg_score"), F.count("*").alias("snapshots"))
    return out.select("project", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "avg_score", "snapshots")
