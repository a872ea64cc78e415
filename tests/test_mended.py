"""Values worked out by hand: brackets of scripts, ceremony and ambiguity of prompts, what they name, cycles of plans, open claims, newest versions, shared patterns."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievemill.operators import architecture, brackets, entities, ingest, joins, planning, prompts, quality, sessions
from sievemill.plans.prompts import SECURITY
from sievemill.sources.samples import SCRIPTS


def scripts(spark, *codes):
    return spark.createDataFrame([(i, "typescript", c) for i, c in enumerate(codes)], "file_id long, lang string, code string")


def test_functions_of_scripts(spark):
    got = brackets.functions(scripts(spark, SCRIPTS[0][2], "function g() { }\n}}}\nfunction h() {\n (((\n}\nfunction last(a) {\n}\ndeclare\nfunction only(a): void;\nfunction both({ a }: P, f = () => { return 1; }) {\n  if (a) { b(); }\n}", "", None))
    assert {(r["file_id"], r["name"], r["line"], r["length"], r["nesting"], r["typed"]) for r in got.collect()} == {
        (0, "Box", 2, 14, 3, True), (0, "inner", 10, 3, 0, False), (1, "g", 1, 1, 0, False), (1, "h", 3, 3, 0, False), (1, "last", 6, 2, 0, False), (1, "only", 9, 1, 0, True), (1, "both", 10, 3, 1, False),
    }


def test_structure_and_hooks(spark):
    files = scripts(spark, SCRIPTS[0][2], "import x from 'react';\nfunction A() {\n  useOne();\n  // if (a) { useNone(); }\n  const s = 'if (a) {';\n  useTwo();\n}\n", "function B() { if (a) { useHook(); } }")
    assert {tuple(r) for r in brackets.misplaced_hooks(files).collect()} == {(0, "REACT001", 5, "useState"), (0, "REACT001", 8, "useOther"), (0, "REACT002", 11, "useInner"), (0, "REACT001", 13, "useBare")}
    assert {tuple(r) for r in brackets.structure(files, longest=13, deepest=2, most_lines=14).collect()} == {
        (0, "TSARCH001", 2, "Box"), (0, "TSARCH003", 2, "Box"), (0, "TSARCH002", 1, None), (1, "TSARCH004", 2, "A"), (2, "TSARCH004", 1, "B"),
    }


def test_deep_nesting_of_functions(spark):
    code = "function a() {\n" + "".join(f"{'if (x) {' if i % 2 else f'function f{i}() {{'}\n" for i in range(20)) + "}" * 20 + "\n}\nfunction z() {}\n"
    got = {r["name"]: r["nesting"] for r in brackets.functions(scripts(spark, code)).collect()}
    assert got["a"] == 20 and got["f0"] == 19 and got["f18"] == 1 and got["z"] == 0


def asked(spark, *texts, **how):
    rows = [(i, *(t if isinstance(t, tuple) else (t, 0))) for i, t in enumerate(texts)]
    return [r for r in prompts.classify(spark.createDataFrame(rows, "prompt_id long, text string, errors int"), SECURITY, **how).orderBy("prompt_id").collect()]


def test_ceremony(spark):
    plain, errors, plan = asked(spark, "FastAPI and SQLAlchemy with python please now", ("rename a python variable in one place", 2), ("create a plan for python modules now", 1), unresolved="errors")
    assert plain["ceremony"] == "standard" and plan["ceremony"] == "thorough"
    assert errors["ceremony"] == {"micro": "light", "light": "standard", "standard": "thorough"}[asked(spark, "rename a python variable in one place")[0]["ceremony"]]
    assert asked(spark, "rename a python variable in one place", least="thorough")[0]["ceremony"] == "thorough"
    named, unnamed = asked(spark, "document the python call load_all() here", "document the python call here and there")
    order = prompts.CEREMONY.index
    assert order(named["ceremony"]) >= order(unnamed["ceremony"])


def test_ambiguity(spark):
    assert [r["ambiguity"] for r in asked(spark, "", "do something with that", "it is this or that or some stuff", "maybe somehow whatever in python code now")] == pytest.approx([0.8, 1.0, 1.0, 0.3])


def test_entities(spark):
    text = "Please edit ./src/app.py and call user.load() or os.path.join with useState from http://x.org/a/b.py, not if() nor ~/x.zip; read /etc/a.toml"
    got = {r["named"]: (r["kind"], r["confidence"], r["library"]) for r in entities.entities(spark.createDataFrame([(1, text), (2, ""), (3, None)], "prompt_id long, text string")).collect()}
    assert got["./src/app.py"] == ("file_path", 1.0, False) and got["user.load"][0] == "function_name" and got["os.path.join"] == ("api_reference", 1.0, True) and got["useState"][:2] == ("api_reference", 0.9)
    assert got["/etc/a.toml"][:2] == ("file_path", 0.8) and not {"if", "~/x.zip", "/a/b.py"} & set(got)
    row = entities.entities(spark.createDataFrame([(1, "x" * 100 + " load_it() " + "y" * 100)], "prompt_id long, text string")).first()
    assert row["context"] == ("x" * 39 + " load_it() " + "y" * 39) and row["start"] == 101


def test_cycles_of_plans(spark):
    step = "### Step {}: x\n**Depends on:** {}\n"
    texts = [
        step.format(1, "Step 2") + step.format(2, "Step 1") + step.format(3, "Steps 1, 9"), step.format(1, "none") + step.format(2, "Step 1"), step.format(1, "1"), step.format(3, "3") + step.format(3, "none"),
        step.format(1, "2") + step.format(2, "3") + step.format(3, "1") + step.format(4, "5") + step.format(5, "4"),
    ]
    steps = planning.plan_steps(spark.createDataFrame(list(enumerate(texts)), "plan_id long, text string"))
    assert {tuple(r) for r in planning.dependency_errors(steps).collect()} == {(0, "1", "(cycle)"), (0, "3", "9"), (2, "1", "(cycle)"), (4, "1", "(cycle)"), (4, "4", "(cycle)")}
    files = spark.createDataFrame([(1, "src/a.py", "x")], "file_id long, path string, code string")
    plans = spark.createDataFrame([(0, "---\nformat_version: 2\n---\n" + texts[0].replace("9", "2"))], "plan_id long, text string")
    found = planning.verify(plans, files).first()
    assert found["dependency"] == 1 and not found["verified"]


def test_claims_that_are_open_or_live_long(spark):
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    claims = [(1, "a", "f", "write", t(0), None), (2, "b", "f", "write", t(5000), None), (3, "c", "f", "read", t(9000), t(9001)), (4, "d", "f", "write", t(100), t(101)), (5, "a", "f", "write", t(3), t(4)), (6, "e", "g", "write", t(1), None), (7, "h", "f", "write", None, None), (8, "d", "f", "read", t(100.5), t(2000)), (9, "k", "f", "write", t(1999), t(1999))]
    table = spark.createDataFrame(claims, "event_id long, session_id string, file_path string, kind string, ts timestamp, released timestamp")
    want = set()
    for i, s, f, k, ts, _ in claims:
        for j, s2, f2, k2, ts2, end in claims:
            live = ts is not None and ts2 is not None and ts2 <= ts and (end is None or end > ts)
            if f == f2 and s != s2 and live and "write" in (k, k2):
                want.add((i, j, "warning" if k2 == "write" else "info"))
    assert {tuple(r) for r in sessions.claim_conflicts(table).collect()} == want and (2, 1, "warning") in want
    assert sessions.claim_conflicts(table.where("false")).collect() == []


def test_sessions_end_after_half_an_hour(spark):
    rows = [("u", datetime(2024, 1, 1, 0, m), i, 0.5, 0, "f") for i, m in enumerate((0, 29, 58))] + [("u", datetime(2024, 1, 1, 1, 29), 9, 0.5, 0, "f")]
    got = sessions.sessions_by_gap(spark.createDataFrame(rows, "user_id string, ts timestamp, event_id long, score double, errors int, file_path string")).collect()
    assert sorted(r["validations"] for r in got) == [1, 3]


def test_newest_version_and_shared_patterns(spark):
    found = spark.createDataFrame([("p", "react", v) for v in ("9.0", "10.0", "9.11", "")] + [("q", "react", "19.0.0-rc1")], "project string, package string, version string")
    assert {tuple(r) for r in ingest.frameworks(found).collect()} == {("p", "react", "10.0"), ("q", "react", "19.0.0-rc1")}
    entries = spark.createDataFrame([("a", ["t", "u"], "x"), ("b", ["t"], "y"), ("b", ["t"], "y"), ("c", [], "z")], "project string, tags array<string>, content string")
    (row,) = architecture.workspace_patterns(entries).collect()
    assert (row["tag"], row["projects"], row["content"], row["names"]) == ("t", 2, "y", "a,b") and row["confidence"] == pytest.approx(2 / 4 + 0.3)


def test_cycles_of_any_length(spark):
    steps = spark.createDataFrame([(1, i, [(i + 1) % 12]) for i in range(12)] + [(2, 1, [2]), (2, 2, [3])], "plan_id long, step long, needs array<long>")
    assert {tuple(r) for r in joins.cycle_groups(steps).collect()} == {(1, i, 0) for i in range(12)}


def test_gate_and_reports(spark):
    rows = [(1, "p", "go", "a", 1.0, True, 0), (2, "p", "python", "b", 0.5, False, 2), (3, "q", "go", "c", 1.0, True, 0), (4, "r", "go", "d", 1.0, True, 0), (5, None, "go", "e", 1.0, True, 0)]
    scores = spark.createDataFrame(rows, "file_id long, project string, lang string, path string, score double, passed boolean, errors long").selectExpr("*", "0L AS warnings", "0L AS infos")
    found = spark.createDataFrame([("q", "critical"), ("q", "high"), ("r", "low")], "project string, severity string")
    assert {tuple(r) for r in quality.gate(scores, found).collect()} == {("p", "FAIL", 1, 0), ("q", "FAIL", 0, 2), ("r", "PASS", 0, 0), (None, "PASS", 0, 0)}
    assert {tuple(r) for r in quality.gate(scores).select("project", "gate").collect()} == {("p", "FAIL"), ("q", "PASS"), ("r", "PASS"), (None, "PASS")}
    assert {(r["project"], r["files"], r["lang"]) for r in quality.project_report(scores).collect()} == {("p", 2, "go"), ("q", 1, "go"), ("r", 1, "go"), (None, 1, "go")}
    broken = spark.createDataFrame([(1, "B"), (2, "A"), (2, "B"), (3, "C")], "file_id long, rule_id string")
    assert {(r["project"], r["top_rules"]) for r in quality.convention_scan(scores, scores, broken, k=1).collect()} >= {("p", "B"), ("q", "C"), ("r", None)}


def test_brackets_deal_no_texts(spark):
    """A file's text stays where it is read: what is shuffled of a file doesn't grow with its comments."""
    files = scripts(spark, "// " + "a long comment " * 2000 + "\nfunction f(a) { return g(a); }\n// " + "b\n// " * 2000, "const h = (a) => {\n};")
    found = brackets.told(files).withColumn("size", F.length(F.to_json(F.struct("*"))))
    assert found.agg(F.max("size")).first()[0] < 4000
    assert {(r["name"], r["line"], r["length"]) for r in brackets.functions(files).collect()} == {("f", 2, 1), ("h", 1, 2)}
    assert "Exchange hashpartitioning(file_id" in (plan := brackets.functions(files)._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan
