"""Tables of the engine, read as they are or derived from the test tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that "the last N days" counts from in registered queries.
ASOF = "2024-01-30 00:00:00"
RULE_IDS = ["PY001", "PY003", "PY011", "SEC002", "SEC007"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality snapshots (project, ts, language, score, passed, errors, warnings, infos), one for each event."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('p', user_id % 12) AS project", "ts", "element_at(array('python', 'go', 'rust'), cast(event_id % 3 as int) + 1) AS language",
        "1 - least(value, 200) / 200 AS score", "event_type <> 'error' AS passed", "if(event_type = 'error', 1 + event_id % 3, 0) AS errors",
        "event_id % 4 AS warnings", "event_id % 2 AS infos",
    )


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validations of files in sessions (session_id, file_path, ts, score, passed, errors, warnings, rules, has_security)."""
    rules = F.array_compact(F.array(*[F.when((F.expr(f"event_id div {i + 1}") + F.col("user_id")) % 3 == 0, F.lit(r)) for i, r in enumerate(RULE_IDS)]))
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "event_id", "user_id", "concat('s', user_id) AS session_id", "concat('src/f', (user_id * 7 + event_id) % 5, '.py') AS file_path", "ts", "1 - least(value, 200) / 200 AS score",
            "event_type <> 'error' AS passed", "if(event_type = 'error', 1 + event_id % 3, 0) AS errors", "event_id % 4 AS warnings",
        )
        .withColumn("rules", rules)
        .withColumn("has_security", F.exists("rules", lambda r: r.startswith("SEC")))
    )


#: The same tables for DuckDB.
SNAPSHOTS_SQL = """
    snapshots AS (SELECT event_id, 'p' || (user_id % 12) AS project, ts, ['python', 'go', 'rust'][event_id % 3 + 1] AS language, 1 - least(value, 200) / 200 AS score,
        event_type <> 'error' AS passed, CASE WHEN event_type = 'error' THEN 1 + event_id % 3 ELSE 0 END AS errors, event_id % 4 AS warnings, event_id % 2 AS infos FROM events)"""
VALIDATIONS_SQL = (
    """
    validations AS (SELECT event_id, user_id, 's' || user_id AS session_id, 'src/f' || ((user_id * 7 + event_id) % 5) || '.py' AS file_path, ts, 1 - least(value, 200) / 200 AS score,
        event_type <> 'error' AS passed, CASE WHEN event_type = 'error' THEN 1 + event_id % 3 ELSE 0 END AS errors, event_id % 4 AS warnings,
        list_filter(["""
    + ", ".join(f"CASE WHEN ((event_id // {i + 1}) + user_id) % 3 = 0 THEN '{r}' END" for i, r in enumerate(RULE_IDS))
    + """], lambda r: r IS NOT NULL) AS rules, ((event_id // 4) + user_id) % 3 = 0 OR ((event_id // 5) + user_id) % 3 = 0 AS has_security FROM events)"""
)
