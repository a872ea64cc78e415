"""Small cases of ingestion, exports, plans and checks that the registered queries don't show."""

from datetime import datetime

from pyspark.sql import functions as F

from sievemill.operators import architecture, checks, full, history, ingest, planning
from sievemill.operators.lines import functions


def test_reports_that_are_no_json(spark):
    rows = [(1, "ruff", "oops"), (2, "eslint", ""), (3, "mypy", "no\n{}\n"), (4, "ruff", None), (5, "ruff", "[]"), (6, "ruff", '[{"code":"S1"}]')]
    got = ingest.lint_reports(spark.createDataFrame(rows, "file_id int, tool string, raw string")).collect()
    assert [(r["file_id"], r["rule_id"], r["severity"], r["line"]) for r in got] == [(6, "RUFF-S1", "error", None)]


def test_overrides_rules_and_snapshots_are_kept(spark, tmp_path):
    one = spark.createDataFrame([("PY001", "a.py", "ok", datetime(2024, 1, 1))], "rule_id string, file_path string, reason string, ts timestamp")
    for _ in range(2):
        ingest.append_overrides(one, f"{tmp_path}/o")
    assert ingest.read_overrides(spark, f"{tmp_path}/o").count() == 2
    rules = spark.createDataFrame([("OWN1", r"a\b", "error")], "id string, pattern string, severity string")
    ingest.write_rules(rules, f"{tmp_path}/r")
    assert ingest.read_rules(spark, f"{tmp_path}/r").collect() == rules.collect()
    assert callable(history.write_snapshots) and callable(history.read_snapshots)


def test_plans_of_odd_shapes(spark):
    files = spark.createDataFrame([("src/a.py", "x\nx\n")], "path string, code string")
    rows = [(1, ""), (2, "### Step 1:\n"), (3, "---\nformat_version: 2\n---\n## Step 4 x\n**File:** `src/a.py`\n**Action:** Edit\n```anchor\nx\n```\n```replace\ny\n```\n**Grounding:** g"), (4, None)]
    plans = spark.createDataFrame(rows, "plan_id int, text string")
    got = {r["plan_id"]: r for r in planning.verify(plans, files).collect()}
    assert (got[1]["coverage"], got[1]["verified"], got[2]["grounding"], got[2]["verified"]) == (1.0, True, 1, False)
    assert (got[3]["version"], got[3]["uniqueness"], got[3]["phantom"], got[3]["verified"]) == (2, 1, 0, False)
    assert got[4]["version"] == 1 and planning.plan_steps(plans.where("false")).count() == 0


def test_checks_on_small_files(spark):
    code = "import os\nimport sys as s\n\n\ndef f(a):\n    try:\n        return s\n        # after\n        a = 1\n    except ValueError:\n        pass\n\n\nclass A:\n    def b(self): return 1\n"
    files = spark.createDataFrame([(1, "python", code), (2, "python", ""), (3, "go", "x")], "file_id int, lang string, code string")
    table = checks.marked(files)
    assert [tuple(r) for r in full.dead_imports(files).collect()] == [(1, 1, "os")]
    assert [tuple(r) for r in checks.unreachable(table).collect()] == [(1, 9)]
    assert [tuple(r) for r in checks.swallowed_exceptions(table).collect()] == [(1, 10)]
    assert [tuple(r) for r in checks.big_classes(table, 0).collect()] == [(1, 14, 1)]
    assert checks.deep_functions(functions(files), 0).count() == 1


def test_too_many_layers_are_an_error(spark):
    import pytest

    layers = spark.range(architecture.MOST_LAYERS + 1).select(F.concat(F.lit("l"), "id").alias("layer"), F.col("id").cast("int").alias("ord"), F.lit("x").alias("pattern"))
    with pytest.raises(ValueError, match="layers"):
        architecture.layer_of(F.col("path"), layers)
