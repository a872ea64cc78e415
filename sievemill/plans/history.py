"""Registered queries over snapshots and validations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, sessions
from ..sources.tables import ASOF, SNAPSHOTS_SQL, VALIDATIONS_SQL, snapshots, validations

QUERIES, ORACLE = {}, {}


def rounded(df):
    """Doubles to nine digits, as the SQL has them."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str, source=snapshots, tables: str = SNAPSHOTS_SQL):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(source(spark, sf_dir)))
        ORACLE[name] = f"WITH {tables}{sql}"
        return function

    return register


def on_snapshots(name: str, function, sql: str) -> None:
    query(name, sql)(function)


def on_validations(name: str, function, sql: str) -> None:
    query(name, sql, validations, VALIDATIONS_SQL)(function)


LAST = f"ts > TIMESTAMP '{ASOF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{ASOF}'"
PLACED = ", placed AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY project) AS n FROM snapshots)"
NEWEST = ", placed AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) - 1 AS i, count(*) OVER (PARTITION BY project) AS n FROM {})"
TIMED = ", placed AS (SELECT *, row_number() OVER f AS i, count(*) OVER (PARTITION BY session_id, file_path) AS n, lag(rules) OVER f AS before, lag(has_security) OVER f AS had FROM validations WINDOW f AS (PARTITION BY session_id, file_path ORDER BY ts, event_id))"
LATEST = TIMED + ", latest AS (SELECT * FROM placed WHERE i = n)"

on_snapshots("s03_read_snapshots", lambda s: history.recent(s, ASOF, 7).select("event_id", "project", "score"), f" SELECT event_id, project, round(score, 9) AS score FROM snapshots WHERE {LAST}")
on_snapshots(
    "a13_trend", lambda s: history.trend(s, ASOF, 7),
    f" SELECT project, count(*) AS snapshots, round(avg(score), 9) AS avg_score, round(min(score), 9) AS min_score, round(max(score), 9) AS max_score, round(avg(passed::INT), 9) AS pass_rate FROM snapshots WHERE {LAST} GROUP BY project",
)
FORECAST = PLACED + """, line AS (SELECT project, count(*) AS n, max_by(score, i) AS cur, regr_slope(score, i) AS slope, regr_intercept(score, i) AS b, regr_r2(score, i) AS r2 FROM placed GROUP BY project)"""
on_snapshots(
    "a14_forecast", history.forecast,
    FORECAST + """ SELECT project, round(cur, 9) AS "current", round(CASE WHEN n < 2 THEN 0 ELSE slope END, 9) AS slope, round(CASE WHEN n < 2 THEN cur ELSE least(1.0, greatest(0.0, b + slope * (n + 6))) END, 9) AS predicted,
        round(CASE WHEN n < 2 THEN 0 ELSE r2 * least(1.0, n / 30) END, 9) AS confidence, CASE WHEN n >= 2 AND slope > 0.005 THEN 'improving' WHEN n >= 2 AND slope < -0.005 THEN 'declining' ELSE 'stable' END AS trend FROM line""",
)
on_snapshots("a15_velocity", history.velocity, FORECAST + " SELECT project, round(CASE WHEN n < 2 THEN 0 ELSE slope END, 9) AS velocity FROM line")
on_snapshots(
    "a16_compare_projects", history.compare_projects,
    """, a AS (SELECT project, avg(score) AS s FROM snapshots GROUP BY project) SELECT (SELECT project FROM a ORDER BY round(s, 9) DESC, project LIMIT 1) AS best,
        (SELECT project FROM a ORDER BY round(s, 9), project LIMIT 1) AS worst, round(avg(s), 9) AS avg_score, count(*) AS projects FROM a""",
)
on_snapshots(
    "w01_score_trend", history.score_trend,
    PLACED + """, h AS (SELECT project, coalesce(avg(score) FILTER (i >= n // 2) - avg(score) FILTER (i < n // 2), 0) AS d FROM placed GROUP BY project)
        SELECT project, round(d, 9) AS change, CASE WHEN d > 0.05 THEN 'improving' WHEN d < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM h""",
)
BASELINE = f", last AS (SELECT * FROM snapshots WHERE {LAST})" + NEWEST.format("last") + ", base AS (SELECT project, avg(score) AS baseline FROM placed WHERE n >= 3 AND i < 10 GROUP BY project)"
on_snapshots("w02_baseline", lambda s: history.baseline(s, ASOF), BASELINE + " SELECT project, round(baseline, 9) AS baseline FROM base")
on_snapshots(
    "w03_regression_alerts", history.regression_alerts,
    NEWEST.format("snapshots") + """, d AS (SELECT project, avg(score) FILTER (i >= 7) - avg(score) FILTER (i < 7) AS x FROM placed WHERE n > 7 GROUP BY project)
        SELECT project, round(x, 9) AS "drop", CASE WHEN x >= 0.15 THEN 'critical' ELSE 'warning' END AS severity FROM d WHERE x >= 0.05""",
)
on_snapshots("w07_quality_drift", lambda s: history.quality_drift(s, history.baseline(s, ASOF)), BASELINE + ' SELECT event_id, project, round(baseline - score, 9) AS "drop" FROM snapshots JOIN base USING (project) WHERE baseline - score > 0.15')
on_snapshots(
    "w13_score_timeline", history.timeline_ends,
    ' SELECT project, count(*)::INT AS points, round(min_by(score, (ts, event_id)), 9) AS first, round(max_by(score, (ts, event_id)), 9) AS "current", round(avg(score), 9) AS average FROM snapshots GROUP BY project',
)
on_snapshots(
    "p28_severity_matrix", history.severity_share,
    """, t AS (SELECT project, sum(errors) AS errors, sum(warnings) AS warnings, sum(infos) AS infos FROM snapshots GROUP BY project), u AS (UNPIVOT t ON errors, warnings, infos INTO NAME severity VALUE n)
        SELECT project, severity, n::BIGINT AS n, round(n / sum(n) OVER (PARTITION BY project), 9) AS share FROM u""",
)
on_snapshots("m04_daily_rollup", history.daily, " SELECT project, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS snapshots, round(avg(score), 9) AS avg_score, sum(errors)::BIGINT AS errors FROM snapshots GROUP BY ALL")
on_snapshots(
    "m05_moving_average", history.moving_average,
    """ SELECT project, strftime(date_trunc('day', ts) - to_days(k::INT), '%Y-%m-%d') AS day, round(avg(score), 9) AS avg_score, count(*) AS snapshots FROM snapshots, range(7) r(k) GROUP BY ALL""",
)

on_validations(
    "w04_violation_persistence", sessions.persistence,
    TIMED + """, each AS (SELECT session_id, file_path, i, n, unnest(rules) AS rule FROM placed), island AS (SELECT *, i - row_number() OVER (PARTITION BY session_id, file_path, rule ORDER BY i) AS run FROM each)
        SELECT session_id, file_path, rule, count(*) AS running FROM island GROUP BY session_id, file_path, rule, run HAVING max(i) = max(n)""",
)
on_validations(
    "w05_violation_delta", sessions.delta,
    TIMED + """ SELECT event_id, array_to_string(list_sort(list_filter(before, lambda r: NOT list_contains(rules, r))), ',') AS resolved,
        array_to_string(list_sort(list_filter(rules, lambda r: NOT list_contains(before, r))), ',') AS "new", len(list_intersect(rules, before))::INT AS stayed FROM placed WHERE before IS NOT NULL""",
)
on_validations("w06_security_regression", sessions.security_regression, TIMED + " SELECT event_id, session_id, file_path FROM placed WHERE has_security AND NOT had")
SUMMARY = LATEST + """, summary AS (SELECT session_id, count(*) AS files, avg(score) AS avg_score, min(score) AS min_score, max(score) AS max_score, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, avg(passed::INT) AS pass_rate FROM latest GROUP BY session_id)"""
on_validations(
    "w08_session_summary", sessions.session_summary,
    SUMMARY + """ SELECT session_id, v.validations, files, round(avg_score, 9) AS avg_score, round(min_score, 9) AS min_score, round(max_score, 9) AS max_score, errors, warnings, round(pass_rate, 9) AS pass_rate
        FROM summary JOIN (SELECT session_id, count(*) AS validations FROM validations GROUP BY 1) v USING (session_id)""",
)
on_validations("w09_latest_score", sessions.latest_score, LATEST + " SELECT session_id, file_path, round(score, 9) AS score, n AS validations FROM latest")
on_validations("w10_session_snapshot", sessions.session_snapshot, SUMMARY + " SELECT session_id, round(avg_score, 9) AS score, errors = 0 AS passed, errors, warnings FROM summary")
on_validations(
    "j22_persistent_requirements", sessions.persistent_requirements,
    LATEST + """, each AS (SELECT session_id, file_path, i, n, unnest(rules) AS rule FROM placed), island AS (SELECT *, i - row_number() OVER (PARTITION BY session_id, file_path, rule ORDER BY i) AS run FROM each),
        p AS (SELECT session_id, file_path, rule, count(*) AS running FROM island GROUP BY session_id, file_path, rule, run HAVING max(i) = max(n) AND count(*) >= 2)
        SELECT session_id, file_path, rule, running, round(score, 9) AS score FROM p JOIN latest USING (session_id, file_path)""",
)
on_validations("a23_agent_results", sessions.agent_results, LATEST + " SELECT session_id, count(*) AS claimed, count(*) FILTER (passed) AS done, round(avg(score), 9) AS avg_score, sum(errors + warnings)::BIGINT AS violations FROM latest GROUP BY session_id")
on_validations("t04_newest_sessions", lambda v: sessions.newest(v, 100), " SELECT session_id FROM (SELECT session_id, max(ts) AS m FROM validations GROUP BY 1) ORDER BY m DESC, session_id LIMIT 100")
on_validations("u03_resolved_rules", lambda v: sessions.delta(v).where("resolved <> ''").select("event_id", F.explode(F.split("resolved", ",")).alias("rule")), TIMED + " SELECT event_id, r.rule FROM (SELECT event_id, unnest(list_filter(before, lambda r: NOT list_contains(rules, r))) AS rule FROM placed WHERE before IS NOT NULL) r")
on_validations(
    "j20_unvalidated_files",
    lambda v: sessions.unvalidated(v.where("event_id % 3 = 0").selectExpr("session_id", "concat('src/f', event_id % 7, '.py') AS file_path").distinct(), v),
    " SELECT DISTINCT session_id, 'src/f' || (event_id % 7) || '.py' AS file_path FROM validations v WHERE event_id % 3 = 0 AND NOT EXISTS (FROM validations w WHERE w.session_id = v.session_id AND w.file_path = 'src/f' || (v.event_id % 7) || '.py')",
)
on_validations(
    "j21_fresh_findings", lambda v: sessions.fresh(v.selectExpr("file_path || session_id AS name", "event_id AS value", "ts", "event_id"), ASOF, 48),
    f" SELECT file_path || session_id AS name, max_by(event_id, (ts, event_id)) AS value, max(ts) >= TIMESTAMP '{ASOF}' - INTERVAL 48 HOUR AS fresh FROM validations GROUP BY 1",
)
on_validations(
    "m02_sessions_by_gap", sessions.sessions_by_gap,
    """, g AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE, true) AS new FROM validations),
        r AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS validations,
        round(sum(score), 9) AS score_sum, max_by(errors, (ts, event_id))::BIGINT AS last_errors, count(DISTINCT file_path) AS files FROM r GROUP BY user_id, run""",
)
on_validations(
    "j14_claim_conflicts", lambda v: sessions.claim_conflicts(v.selectExpr("event_id", "session_id", "file_path || (event_id % 40) AS file_path", "if(event_id % 2 = 0, 'write', 'read') AS kind", "ts", "if(passed, ts + INTERVAL 10 HOURS, if(errors > 1, null, ts + INTERVAL 3 DAYS)) AS released")),
    """, c AS (SELECT event_id, session_id, file_path || (event_id % 40) AS file_path, CASE WHEN event_id % 2 = 0 THEN 'write' ELSE 'read' END AS kind, ts, CASE WHEN passed THEN ts + INTERVAL 10 HOUR WHEN errors > 1 THEN NULL ELSE ts + INTERVAL 3 DAY END AS released FROM validations)
        SELECT a.event_id, b.event_id AS other_id, CASE WHEN b.kind = 'write' THEN 'warning' ELSE 'info' END AS severity FROM c a JOIN c b
        ON a.file_path = b.file_path AND a.session_id <> b.session_id AND b.ts <= a.ts AND coalesce(b.released > a.ts, true) AND (a.kind = 'write' OR b.kind = 'write')""",
)
on_validations(
    "a18_override_counts", lambda v: sessions.override_counts(v.where("not passed").select(F.explode("rules").alias("rule_id"), "file_path").withColumn("severity", F.when(F.col("rule_id").startswith("SEC"), "error").otherwise("warning"))),
    """, o AS (SELECT unnest(rules) AS rule_id, file_path FROM validations WHERE NOT passed), s AS (SELECT *, CASE WHEN starts_with(rule_id, 'SEC') THEN 'error' ELSE 'warning' END AS severity FROM o)
        SELECT rule_id, severity, count(*) AS overrides, count(DISTINCT file_path) AS files, CASE WHEN count(*) >= 5 THEN CASE severity WHEN 'error' THEN 'warning' ELSE 'info' END END AS suggested FROM s GROUP BY rule_id, severity""",
)
