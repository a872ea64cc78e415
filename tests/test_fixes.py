"""Fixes against a loop in Python, and values worked out by hand."""

import re

from sievemill.functions.catalogue import RULES
from sievemill.operators import fixes, scan
from sievemill.plans.fixes import QUERIES
from sievemill.sources.samples import FIX_SAMPLES

FOUND = "file_id long, rule_id string, line int, col int, snippet string"


def looped(code: str, found: list[tuple]) -> tuple[str, int]:
    rows, n = code.split("\n"), 0
    for rule, line, _ in sorted(found, key=lambda f: (f[0], f[2])):
        for p in fixes.PATCHES:
            if p.rule_id == rule and line and 1 <= line <= len(rows) and re.search(p.pattern, rows[line - 1]):
                rows[line - 1] = re.sub(p.pattern, p.by, rows[line - 1])
                n += 1
                break
    return "\n".join(rows), n


def test_applied_like_a_loop_and_once(spark):
    rows = [(i, lang, code) for i, (lang, _, code) in enumerate(FIX_SAMPLES)]
    files = spark.createDataFrame(rows, "file_id long, lang string, code string")
    found = scan.rule_scan(files)
    by_file = {}
    for r in found.collect():
        by_file.setdefault(r["file_id"], []).append((r["rule_id"], r["line"], r["col"]))
    got = fixes.apply_fixes(files, found)
    result = {r["file_id"]: (r["code"], r["applied"]) for r in got.collect()}
    wanted = {i: looped(code, by_file.get(i, [])) for i, _, code in rows}
    assert result == {i: wanted[i] for i in result} and {i for i, (_, n) in wanted.items() if n} <= set(result)
    assert "const a = 1; const b = 2;" in result[1][0] and "except Exception:" in result[0][0] and "# except:" in result[0][0]
    again = files.drop("code").join(got.select("file_id", "code"), "file_id")
    assert all(r["applied"] == 0 for r in fixes.apply_fixes(again, scan.rule_scan(again)).collect())


def test_several_of_one_line_in_turn(spark):
    files = spark.createDataFrame([(1, "x: Dict[str, List[Optional[int]]]\ny"), (2, "z"), (3, None)], "file_id long, code string")
    found = [(1, "PY005", 1, c, None) for c in (1, 2, 3, 4)] + [(1, "PY005", 9, 1, None), (1, "PY005", None, 1, None), (1, "TS004", 1, 1, None), (2, "PY003", 1, 1, None), (3, "PY003", 1, 1, None), (7, "PY003", 1, 1, None)]
    got = {tuple(r) for r in fixes.apply_fixes(files, spark.createDataFrame(found, FOUND)).collect()}
    assert got == {(1, "x: dict[str, list[int | None]]\ny", 3), (2, "z", 0), (3, None, None)}
    assert fixes.apply_fixes(files, spark.createDataFrame(found, FOUND), 0.92).where("file_id = 1").first()["applied"] == 2  # the patch of Optional is less sure


def test_plan_by_text_or_by_patch(spark):
    found = spark.createDataFrame([(1, "PY003", 1, 1, "except:"), (1, "SEC014", 1, 1, ""), (1, "AI001", 2, 1, None), (1, "SEC002", 3, 1, "x"), (1, "NONE1", 3, 1, "x"), (1, "JS002", 4, 1, "a == b")], FOUND)
    assert {(r["rule_id"], r["fixed"], r["confidence"], r["is_template"]) for r in fixes.fix_plan(found).collect()} == {
        ("PY003", "except Exception:", 0.95, True), ("AI001", "# TODO: Implement this function", 0.7, True), ("SEC002", "cursor.execute(query, params)", 0.9, True), ("JS002", "===", 0.95, True),
    }
    assert [tuple(r) for r in fixes.quick_fixes(found).select("rule_id", "fixed").collect()] == [("SEC002", "cursor.execute(query, params)")]
    by_patch = {(r["rule_id"], r["fixed"], r["is_template"]) for r in fixes.fix_plan(found, templates={"SEC002": ("t", 1.0)}).collect()}
    assert by_patch == {("PY003", "except Exception:", False), ("SEC002", "t", True), ("JS002", "a === b", False)}


def test_fixes_look_for_no_other_rules(spark):
    rows = [(i, lang, code) for i, (lang, _, code) in enumerate(FIX_SAMPLES)]
    files = spark.createDataFrame(rows, "file_id long, lang string, code string")
    own = fixes.patched_rules()
    assert {r.id for r in own} == {p.rule_id for p in fixes.PATCHES} and {r.id for r in fixes.patched_rules(sure=0.92)} == {p.rule_id for p in fixes.PATCHES if p.confidence >= 0.92}
    of = lambda rules: sorted(map(tuple, fixes.apply_fixes(files, scan.rule_scan(files, rules)).collect()))
    assert of(own) == of(RULES) != []
    plan = QUERIES["r12_apply_fixes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "pickle" not in plan and "verify" in plan  # before, all rules were looked for
