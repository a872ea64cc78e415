"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from sievemill.operators import sessions as batch
from sievemill.sources.tables import snapshots, validations
from sievemill.streaming import jobs

HOME = "/root/testdata/sf0.001"


def fed(spark, table, path):
    table.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(path)
    return jobs.stream(spark, path, spark.read.parquet(path))


def drained(out, folder, mode="append"):
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/o").outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return out.sparkSession.read.parquet(f"{folder}/o")


def test_daily(spark, tmp_path):
    table = snapshots(spark, HOME)
    out = {tuple(r) for r in drained(jobs.daily(fed(spark, table, f"{tmp_path}/in")), str(tmp_path)).collect()}
    whole = {tuple(r) for r in table.groupBy("project", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*"), F.sum("errors")).collect()}
    assert out and out < whole  # the last days are still open


def test_latest_scores(spark, tmp_path):
    table = validations(spark, HOME)
    query = jobs.upsert_latest(fed(spark, table, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c", buckets=8)()
    assert query.awaitTermination(240)
    got = {(r["session_id"], r["file_path"]): r["score"] for r in jobs.latest_table(spark, f"{tmp_path}/t").collect()}
    assert got == {(r["session_id"], r["file_path"]): r["score"] for r in batch.latest_score(table).collect()}
    assert len(list((tmp_path / "t/commits").iterdir())) == 1 and len(list((tmp_path / "t/data").glob("*/bucket=*"))) == 8


def test_an_upsert_touches_its_buckets_alone(spark, tmp_path):
    from datetime import datetime

    t = lambda m: datetime(2024, 1, 1, 0, m)
    row = "session_id string, file_path string, score double, ts timestamp, event_id long"
    rows = [("s", f"f{i}", i / 10, t(0), i) for i in range(20)]

    def fed_batch(n, *more):
        spark.createDataFrame(list(more), row).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return jobs.upsert_latest(jobs.stream(spark, f"{tmp_path}/in", spark.createDataFrame([], row)), f"{tmp_path}/t", f"{tmp_path}/c{n}", buckets=8)()

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "t/data").rglob("*.parquet")}

    assert fed_batch(0, *rows).awaitTermination(120)
    first = files()
    assert fed_batch(0, ("s", "f3", 9.0, t(5), 50), ("s", "f3", 1.0, t(4), 49), ("s", "f4", 9.0, datetime(2023, 1, 1), 51)).awaitTermination(120)
    second = files()
    kept = set(first) & set(second)
    assert 0 < len(set(second) - kept) <= 2 and all(first[p] == second[p] for p in kept)
    scores = {r["file_path"]: r["score"] for r in jobs.latest_table(spark, f"{tmp_path}/t").collect()}
    assert scores == {f"f{i}": i / 10 for i in range(20)} | {"f3": 9.0}
    assert fed_batch(1).awaitTermination(120)  # a new checkpoint: batches are told again, and are known
    assert files() == second


def test_stale_advisories_never_match(spark, tmp_path):
    from datetime import datetime

    deps = spark.createDataFrame([("PyPI", "x", "1", datetime(2024, 1, 2, 0)), ("npm", "x", "1", datetime(2024, 1, 2, 1)), ("PyPI", "y", "1", datetime(2024, 1, 2, 2))], "ecosystem string, package string, version string, ts timestamp")
    known = spark.createDataFrame([("PyPI", "x", "1", "V1", datetime(2024, 1, 1, 12)), ("npm", "x", "1", "V2", datetime(2023, 1, 1)), ("PyPI", "y", "1", "V3", datetime(2024, 1, 3))], "ecosystem string, package string, version string, vuln_id string, checked_at timestamp")
    got = drained(jobs.known_advisories(fed(spark, deps, f"{tmp_path}/in"), known), str(tmp_path)).collect()
    assert [(r["ecosystem"], r["vuln_id"]) for r in got] == [("PyPI", "V1")]


def test_late_rows_are_counted(spark, tmp_path):
    import time

    late = jobs.LateRows()
    spark.streams.addListener(late)
    try:
        like = spark.createDataFrame([], "project string, ts timestamp_ntz, errors int")
        for n, days in enumerate([(10, 10), (20,), (1, 2, 2, 19)]):  # the third file is two days late, three times and once in time
            rows = spark.createDataFrame([("p", d) for d in days], "project string, d int").selectExpr("project", "cast(make_date(2024, 1, d) as timestamp_ntz) as ts", "1 as errors")
            rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            time.sleep(1.1)  # files are read in the order of their times
        out = jobs.daily(jobs.stream(spark, f"{tmp_path}/in", like))
        query = out.writeStream.queryName("days").format("memory").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        for _ in range(100):
            if late.dropped.get("days"):
                break
            time.sleep(0.2)
        assert late.dropped["days"] == 2  # two keys, one of them with two rows
        assert {r["day"] for r in spark.table("days").collect()} == {"2024-01-10"}
    finally:
        spark.streams.removeListener(late)
