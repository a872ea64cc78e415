"""Registered queries against their SQL on the smallest tables."""

import pytest

from sievemill.plans import ORACLE, QUERIES

HOME = "/root/testdata/sf0.001"
#: A query of each kind; the driver runs them all.
NAMES = ["r01_scan_pages", "w04_violation_persistence", "a14_forecast", "m02_sessions_by_gap", "l17_function_length", "j05_changed_lines", "x11_plan_cycles", "j12_decision_guidance", "p07_skip_spans", "a28_plan_verify", "a26_plan_scores", "s06_lint_reports", "s09_manifest_dependencies", "s11_export_sarif", "l01_placeholders", "l15_dead_imports", "l17_deep_functions", "x01_classify_prompts", "r08_semantic_checks", "j07_layer_drift", "r16_mark_verifiable", "j08_layer_context", "j10_explanations", "j11_standards", "a22_stack_facts", "a27_layered_plan_scores", "x14_text_figures"]


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "documents events conversations pages part".split():
        con.execute(f"create view {t} as select * from '{HOME}/{t}.parquet'")
    want = con.execute(ORACLE[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = QUERIES[name](spark, HOME)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
