"""Registered queries of fixes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fixes, scan
from ..sources.corpus import files, files_sql, quoted
from ..sources.samples import FIX_SAMPLES
from .scanning import violations_sql

QUERIES, ORACLE = {}, {}
FOUND = f"WITH {files_sql(FIX_SAMPLES)}, {violations_sql()}"


def add(name: str, function, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: function(files(spark, sf_dir, FIX_SAMPLES))
    ORACLE[name] = FOUND + sql


TEXTS = "texts(rule_id, template, certain) AS (VALUES " + ", ".join(f"({quoted(k)}, {quoted(t)}, {c}::DOUBLE)" for k, (t, c) in fixes.TEMPLATES.items()) + ")"


def patched_sql(rule: str, line: str) -> str:
    cases = [f"WHEN {rule} = '{p.rule_id}' AND regexp_matches({line}, {quoted(p.pattern)}) THEN regexp_replace({line}, {quoted(p.pattern)}, {quoted(p.by)}, 'g')" for p in fixes.PATCHES]
    return f"CASE {' '.join(cases)} ELSE {line} END"


PLAN = f", {TEXTS}, plan AS (SELECT file_id, rule_id, line, col, snippet, template AS fixed, certain AS confidence, true AS is_template FROM violations JOIN texts USING (rule_id) WHERE certain >= 0.7)"
add("r11_auto_fix_plan", lambda f: fixes.fix_plan(scan.rule_scan(f)), PLAN + " SELECT * FROM plan")
add("r11_patched_snippets", lambda f: fixes.fix_plan(scan.rule_scan(f), templates={"SEC001": ("own", 0.9)}).select("file_id", "rule_id", "line", "col", "fixed", "is_template"),
    f""", made AS (SELECT file_id, rule_id, line, col, snippet, CASE WHEN rule_id = 'SEC001' THEN 'own' ELSE {patched_sql('rule_id', 'snippet')} END AS fixed FROM violations)
    SELECT file_id, rule_id, line, col, fixed, rule_id = 'SEC001' AS is_template FROM made WHERE fixed <> snippet OR rule_id = 'SEC001'""")  # fmt: skip
add(
    "r13_quick_fixes", lambda f: fixes.quick_fixes(scan.rule_scan(f)).select("file_id", "rule_id", "line", "col", "fixed", "confidence"),
    PLAN + " SELECT file_id, rule_id, line, col, fixed, confidence FROM plan WHERE confidence >= 0.8 AND regexp_matches(rule_id, '^(?:SEC00[1-8]|AI00[178])$')",
)
add(
    "r12_apply_fixes", lambda f: fixes.apply_fixes(f, scan.rule_scan(f, fixes.patched_rules())).select("file_id", F.md5("code").alias("md5"), "applied"),
    f""", wrong AS (SELECT file_id, line, list(rule_id ORDER BY rule_id, col) AS rules FROM violations WHERE rule_id IN ('PY003', 'PY005', 'JS001', 'JS002', 'SEC006', 'SEC007') GROUP BY ALL),
        l AS (SELECT file_id, unnest(string_split(code, chr(10))) AS t, generate_subscripts(string_split(code, chr(10)), 1) AS line FROM files WHERE file_id IN (SELECT file_id FROM wrong)),
        steps AS (SELECT l.file_id, l.line, t, [list_reduce([t] || rules[1:i], lambda acc, r: {patched_sql('r', 'acc')}) FOR i IN range(1, len(rules) + 1)] AS made FROM l LEFT JOIN wrong USING (file_id, line)),
        done AS (SELECT file_id, line, coalesce(made[-1], t) AS fixed, coalesce(len(list_filter(range(1, len(made) + 1), lambda i: made[i] <> CASE WHEN i = 1 THEN t ELSE made[i - 1] END)), 0) AS n FROM steps)
        SELECT file_id, md5(string_agg(fixed, chr(10) ORDER BY line)) AS md5, sum(n)::INT AS applied FROM done GROUP BY file_id""",
)
