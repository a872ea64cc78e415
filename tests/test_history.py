"""Places in time of a hot project, and timelines."""

from datetime import datetime, timedelta

from sievemill.operators import history

START = datetime(2024, 1, 1)


def snapshots(spark):
    rows = [("hot" if i % 10 else None, START + timedelta(minutes=i // 3), i, i % 7 / 7) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "project string, ts timestamp, event_id long, score double").repartition(4)


def test_places_of_a_hot_project_are_dealt_over_tasks(spark):
    rows, table = snapshots(spark)
    for newest_first in (False, True):
        got = history.numbered(table, newest_first)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in plan
        want = {}
        for project in ("hot", None):
            own = sorted((r for r in rows if r[0] == project), key=lambda r: r[1:3], reverse=newest_first)
            want |= {r[2]: (project, i, len(own)) for i, r in enumerate(own)}
        assert {r["event_id"]: (r["project"], r["i"], r["n"]) for r in got.collect()} == want


def test_timeline_is_rows_with_the_trend(spark):
    rows, table = snapshots(spark)
    got = history.timeline(table).collect()
    assert {(r["project"], r["event_id"], r["score"]) for r in got} == {(p, i, s) for p, _, i, s in rows} and len(got) == len(rows)
    assert {r["trend"] for r in got} == {"stable"}
    assert "collect_list" not in history.timeline_ends(table)._jdf.queryExecution().optimizedPlan().toString()
