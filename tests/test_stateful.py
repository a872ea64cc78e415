"""Streams with state against the batch operators, over several batches."""

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_streaming import HOME, drained, fed

from sievemill.operators import sessions as batch
from sievemill.sources.tables import snapshots, validations
from sievemill.streaming import jobs, stateful


@pytest.fixture(autouse=True)
def store(spark):
    """The state store that typed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, stateful.STORE)
    yield
    spark.conf.set(name, before)


def in_two(spark, table, path, by="ts"):
    """A stream of two batches, the second after the first in time."""
    middle = table.agg(F.percentile_approx(F.unix_micros(F.col(by).cast("timestamp")), 0.5)).first()[0]
    at = F.unix_micros(F.col(by).cast("timestamp"))
    table.where(at <= middle).coalesce(1).write.parquet(path)
    time.sleep(1.2)
    table.where(at > middle).coalesce(1).write.mode("append").parquet(path)
    return jobs.stream(spark, path, spark.read.parquet(path))


def test_arrivals(spark, tmp_path):
    table = validations(spark, HOME)
    got = drained(stateful.arrivals(in_two(spark, table, f"{tmp_path}/in")), str(tmp_path)).collect()
    want = {r["event_id"]: (r["resolved"], r["new"], r["stayed"]) for r in batch.delta(table).collect()}
    assert {r["event_id"]: (r["resolved"], r["new"], r["stayed"]) for r in got} == want
    assert {r["event_id"] for r in got if r["regression"]} == {r["event_id"] for r in batch.security_regression(table).collect()}
    assert max(n for r in got for n in r["running"].values()) >= 2


def test_arrivals_over_restarts(spark, tmp_path):
    """Each third is a run of its own that goes on from the checkpoint; at the end the kept rules' runs are those of all validations at once."""
    table = validations(spark, HOME)
    placed = table.withColumn("third", F.ntile(3).over(Window.orderBy("ts", "event_id")))
    for third in (1, 2, 3):
        placed.where(F.col("third") == third).drop("third").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = drained(stateful.arrivals(jobs.stream(spark, f"{tmp_path}/in", table)), str(tmp_path))
    got = {r["event_id"]: r for r in got.collect()}
    assert {e: (r["resolved"], r["new"], r["stayed"]) for e, r in got.items()} == {r["event_id"]: (r["resolved"], r["new"], r["stayed"]) for r in batch.delta(table).collect()}
    last = {(r["session_id"], r["file_path"]): r["event_id"] for r in batch.latest(table).collect()}
    want = {(e, r["rule"]): r["running"] for r in batch.persistence(table).collect() if r["running"] > 1 for e in [last[r["session_id"], r["file_path"]]]}
    assert want == {(e, rule): n for e in last.values() if e in got for rule, n in got[e]["running"].items()}


def test_forgotten_files_begin_anew(spark, tmp_path):
    rows = [(1, "s", "f", 0, ["A"], False), (2, "s", "f", 5, ["A"], True), (3, "s", "f", 500, ["A"], True), (4, "s", "f", 505, [], False)]
    table = spark.createDataFrame(rows, "event_id long, session_id string, file_path string, s int, rules array<string>, has_security boolean").withColumn("ts", F.timestamp_seconds(F.col("s") + 10_000)).drop("s")
    got = drained(stateful.arrivals(in_two(spark, table, f"{tmp_path}/in"), "0 seconds", 100), str(tmp_path)).collect()
    assert {(r["event_id"], r["resolved"], tuple(r["running"].items()), r["regression"]) for r in got} == {(2, "", (("A", 2),), True), (4, "A", (), False)}


def test_claims(spark, tmp_path):
    rows = [(1, "f", "a", 0, "write"), (2, "f", "b", 10, "read"), (3, "f", "c", 20, "write"), (4, "g", "c", 30, "write"), (5, "f", "a", 40, "end"), (6, "f", "d", 50, "write"), (7, "f", "b", 60, "end"), (8, "f", "e", 5000, "write"), (9, "g", "d", 40, "read")]
    table = spark.createDataFrame(rows, "event_id long, file_path string, session_id string, s int, kind string").withColumn("ts", F.timestamp_seconds(F.col("s") + 10_000)).drop("s")
    got = drained(stateful.claim_alerts(in_two(spark, table, f"{tmp_path}/in")), str(tmp_path)).select("event_id", "other", "severity").collect()
    assert sorted(map(tuple, got)) == [(2, "a", "info"), (3, "a", "warning"), (3, "b", "info"), (6, "b", "info"), (6, "c", "warning"), (9, "c", "info")]


def test_sliding_baseline_and_sessions(spark, tmp_path):
    table = snapshots(spark, HOME)
    out = {(r["project"], r["until"]): r["snapshots"] for r in drained(jobs.moving_baseline(fed(spark, table, f"{tmp_path}/in")), f"{tmp_path}/a").collect()}
    ends = table.select("project", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k"), F.to_date("ts").alias("d")).groupBy("project", F.date_add("d", F.col("k")).cast("string").alias("until")).count()
    whole = {(r["project"], r["until"]): r["count"] for r in ends.collect()}
    assert out and all(whole[k] == n for k, n in out.items())
    table = validations(spark, HOME)
    totals = drained(jobs.session_totals(fed(spark, table, f"{tmp_path}/in2")), f"{tmp_path}/b").agg(F.sum("validations"), F.count("*")).first()
    assert 0 < totals[1] <= totals[0] <= table.count()


def test_plain_streams(spark, tmp_path):
    files = spark.createDataFrame([(1, "python", "eval(x)\nrequests.get(u, verify=False)\n"), (2, "python", "ok = 1\n")], "file_id long, lang string, code string")
    got = drained(jobs.quick_violations(in_two(spark, files.withColumn("ts", F.timestamp_seconds("file_id")), f"{tmp_path}/in").drop("ts")), f"{tmp_path}/a")
    assert {r["file_id"] for r in got.collect()} == {1}
    known = spark.createDataFrame([("p", "a", 0), ("p", "a", 5), ("p", "b", 9), ("q", "a", 9)], "project string, content string, s int").withColumn("ts", F.timestamp_seconds(F.col("s") + 10_000)).drop("s")
    got = drained(jobs.once(in_two(spark, known, f"{tmp_path}/in2")), f"{tmp_path}/b").select("project", "content").collect()
    assert sorted(map(tuple, got)) == [("p", "a"), ("p", "b"), ("q", "a")]
    deps = spark.createDataFrame([("x", "1"), ("y", "2")], "package string, version string").withColumn("ts", F.timestamp_seconds(F.col("version").cast("int")))
    advisories = spark.createDataFrame([("x", "1", "V1")], "package string, version string, vuln_id string")
    assert [r["vuln_id"] for r in drained(jobs.known_advisories(in_two(spark, deps, f"{tmp_path}/in3"), advisories), f"{tmp_path}/c").collect()] == ["V1"]
    got = drained(jobs.sessions(in_two(spark, validations(spark, HOME), f"{tmp_path}/in4")), f"{tmp_path}/d")
    assert got.count() > 0
