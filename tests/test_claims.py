"""Claims on one path against brute force."""

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sievemill.operators import sessions

START = datetime(2024, 1, 1)


def test_claims_meet_by_path_and_hour(spark):
    rows = [(i, f"s{i % 3}", f"f{i % 2}", ("write", "read")[i % 5 % 2], START + timedelta(minutes=17 * i), START + timedelta(minutes=17 * i + i % 4 * 60)) for i in range(120)]
    found = sessions.claim_conflicts(spark.createDataFrame(rows, "event_id long, session_id string, file_path string, kind string, ts timestamp, released timestamp"))
    want = [(a[0], b[0], "warning" if b[3] == "write" else "info") for a in rows for b in rows
            if a[2] == b[2] and a[1] != b[1] and b[4] <= a[4] < b[5] and "write" in (a[3], b[3])]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and want
    assert "_hour" in found._jdf.queryExecution().optimizedPlan().toString()


def test_one_path_with_open_claims_is_dealt_to_many_tasks(spark):
    rows = [(i, f"s{i % 7}", "f", ("write", "read", None)[i % 3], START + timedelta(minutes=i), START + timedelta(minutes=i + 50) if i % 4 == 0 else None) for i in range(300)]
    claims = spark.createDataFrame(rows, "event_id long, session_id string, file_path string, kind string, ts timestamp, released timestamp")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shared = sessions.claim_conflicts(claims)
        found = sessions.claim_conflicts(claims, cell=20, task_pairs=1000).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [(a[0], b[0], "warning" if b[3] == "write" else "info") for a in rows for b in rows
            if a[1] != b[1] and b[4] <= a[4] and (b[5] is None or b[5] > a[4]) and "write" in (a[3], b[3])]
    assert sorted(tuple(r)[:3] for r in found) == sorted(want) == sorted(tuple(r) for r in shared.collect())
    tasks = Counter(r["task"] for r in found)
    assert max(tasks.values()) < len(want) / 8 and len(tasks) > 20


def test_what_is_shuffled_and_written_grows_as_the_claims_do(spark, tmp_path):
    def run(n):
        rows = spark.range(n).selectExpr(
            "id AS event_id", "concat('s', id) AS session_id", "'f' AS file_path", "'write' AS kind", f"timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id * {40000 / n}) AS ts", "cast(null AS timestamp) AS released"
        )
        written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
        before, out = written(), tmp_path / str(n)
        sessions.claim_conflicts(rows, cell=20).write.parquet(str(out))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        shuffled = written() - before
        found = spark.read.parquet(str(out))
        assert found.count() == found.where("other_id < event_id and severity = 'warning'").distinct().count() == n * (n - 1) // 2
        return shuffled, sum(f.stat().st_size for f in out.glob("*.parquet")) / (n * (n - 1) // 2)

    (little, _), (much, bytes_a_row) = run(750), run(3000)
    assert much < 6 * little and bytes_a_row < 0.5, (little, much, bytes_a_row)
