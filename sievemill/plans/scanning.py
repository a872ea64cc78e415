"""Registered queries of the rule scan and of what is made of violations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.catalogue import LANGUAGE_SIGNS, RULES, TEST_FREE, TEST_SIGNS, Rule
from ..operators import quality, scan
from ..places import cut
from ..sources.corpus import FILES_SQL, files, quoted
from ..sources.tables import table
from .history import rounded

QUERIES, ORACLE = {}, {}


def lengths(items: str) -> str:
    return f"coalesce(list_sum(list_transform({items}, lambda x: length(x))), 0)"


def re2(pattern: str) -> str:
    """RE2 has no possessive loops, and never needs them."""
    return quoted(pattern.replace("*+", "*"))


def spans_sql(code: str, pattern: str) -> str:
    """List of {start, end} from 0 of all matches."""
    m, g = f"regexp_extract_all({code}, {pattern})", f"string_split_regex({code}, {pattern})"
    before = f"{lengths('g[1:i]')} + {lengths('m[1:i - 1]')}"
    return f"(SELECT list_transform(range(1, len(m) + 1), lambda i: {{'start': ({before})::INT, 'end': ({before} + length(m[i]))::INT, 'text': m[i]}}) FROM (SELECT {m} AS m, {g} AS g))"


LEXER = f"CASE WHEN lang = 'python' THEN {{}} WHEN lang IN ('typescript', 'javascript') THEN {{}} ELSE {{}} END".format(*(spans_sql("code", re2(text.LEXERS[k])) for k in ("hash", "template", "block")))
IS_TEST = "regexp_matches(code, " + quoted("|".join(f"(?:{s})" for s in TEST_SIGNS)) + ")"


def hits_sql(rules: list[Rule], source: str = "files") -> str:
    parts = []
    for r in rules:
        where = f"regexp_matches(code, {quoted(r.regex)}) AND trim(code) <> ''" + (f" AND lang = '{r.lang}'" if r.lang else "") + (f" AND NOT {IS_TEST}" if r.slug in TEST_FREE else "")
        found = spans_sql("code", quoted(r.regex))
        if r.unless:
            found = f"list_filter({found}, lambda s: NOT regexp_matches(s.text, {quoted(r.unless)}))"
        parts.append(f"SELECT file_id, '{r.id}' AS rule_id, unnest({found}).start AS pos FROM {source} WHERE {where}")
    return " UNION ALL ".join(parts)


def violations_sql(rules: list[Rule] = RULES, name: str = "violations") -> str:
    known = ", ".join(f"('{r.id}', '{r.slug}', '{r.severity}', '{r.category}')" for r in rules)
    pieces = [f"CASE WHEN lang = 'python' THEN {{0}} WHEN lang IN ('typescript', 'javascript') THEN {{1}} ELSE {{2}} END".format(*(f"{f}(code, {re2(text.LEXERS[k])})" for k in ("hash", "template", "block"))) for f in ("regexp_extract_all", "string_split_regex")]
    head = "substr(code, 1, pos)"
    line = f"length({head}) - length(replace({head}, chr(10), '')) + 1"
    return f"""{name}_rules(rule_id, rule, severity, category) AS (VALUES {known}), {name}_hits AS MATERIALIZED ({hits_sql(rules)}),
    {name}_lexed AS (SELECT file_id, {pieces[0]} AS m, {pieces[1]} AS g FROM files WHERE file_id IN (SELECT file_id FROM {name}_hits)),
    {name}_lexemes AS (SELECT file_id, unnest(m) AS m, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM {name}_lexed),
    {name}_spans AS (SELECT file_id, sum(length(g) + length(m)) OVER (PARTITION BY file_id ORDER BY i) AS e, length(m) AS n FROM {name}_lexemes),
    {name} AS (SELECT h.file_id, h.rule_id, rule, severity, category, ({line})::INT AS line, length(string_split({head}, chr(10))[-1])::INT + 1 AS col, trim(string_split(code, chr(10))[{line}], ' ') AS snippet
        FROM {name}_hits h JOIN {name}_rules USING (rule_id) JOIN files USING (file_id) WHERE NOT EXISTS (FROM {name}_spans s WHERE s.file_id = h.file_id AND h.pos > s.e - s.n AND h.pos < s.e))"""


VIOLATIONS = f"WITH {FILES_SQL}, {violations_sql()}"
SCORES = VIOLATIONS + """, by_file AS (SELECT file_id, sum(CASE severity WHEN 'error' THEN 0.25::DOUBLE WHEN 'warning' THEN 0.08::DOUBLE ELSE 0.02::DOUBLE END) AS cost, count(*) FILTER (severity = 'error') AS errors,
        count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (category = 'security') AS security FROM violations GROUP BY 1),
    scores AS (SELECT file_id, project, lang, path, greatest(0.0, 1 - coalesce(cost, 0)) AS score, coalesce(errors, 0) = 0 AS passed, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings,
        coalesce(infos, 0) AS infos, coalesce(security, 0) AS security FROM files LEFT JOIN by_file USING (file_id))"""
COLUMNS = "file_id, rule_id, rule, severity, category, line, col, snippet"


def on_files(name: str, function, sql: str, start: str = f"WITH {FILES_SQL}") -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(function(files(spark, sf_dir)))
    ORACLE[name] = start + sql


def on_violations(name: str, function, sql: str) -> None:
    on_files(name, lambda f: function(scan.rule_scan(f)), sql, VIOLATIONS)


def on_scores(name: str, function, sql: str) -> None:
    """function(files, violations, scores)"""

    def run(f):
        v = scan.rule_scan(f)
        return function(f, v, quality.file_scores(f, v))

    on_files(name, run, sql, SCORES)


def on_both(name: str, function, sql: str) -> None:
    """on_scores, for functions that use violations beside scores: files are scanned once, and violations, which are small beside them, are kept."""

    def run(f):
        v = cut(scan.rule_scan(f))
        return function(f, v, quality.file_scores(f, v))

    on_files(name, run, sql, SCORES)


def by_lang(scores):
    """Scores with the language for a project: test documents are dealt over many projects."""
    return scores.withColumn("project", F.col("lang"))


# -- text ---------------------------------------------------------------------------------------------------

QUERIES["s02_scan_table"] = lambda spark, sf_dir: files(spark, sf_dir).select("file_id", "project", "path", "lang", F.length("code").cast("long").alias("n_chars"))
ORACLE["s02_scan_table"] = f"WITH {FILES_SQL} SELECT file_id, project, path, lang, length(code) AS n_chars FROM files"

NUMBER = "[0-9]+"
on_files(
    "p06_find_all", lambda f: f.select("file_id", "code", F.explode(text.matches(F.col("code"), F.lit(NUMBER))).alias("m")).select("file_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"), "m.line"),
    f""", m AS (SELECT file_id, code, unnest({spans_sql('code', quoted(NUMBER))}) AS m FROM files) SELECT file_id, m.start AS start, m."end" AS "end", (1 + length(substr(code, 1, m.start)) - length(replace(substr(code, 1, m.start), chr(10), '')))::INT AS line FROM m""",
)
on_files(
    "p07_skip_spans", lambda f: f.select("file_id", text.skip_spans(F.col("code"), F.col("lang")).alias("s")).select("file_id", F.size("s").alias("spans"), F.aggregate("s", F.lit(0), lambda a, x: a + x["end"] - x["start"]).alias("chars"), F.element_at("s", 1)["start"].alias("first")),
    f', s AS (SELECT file_id, {LEXER} AS s FROM files) SELECT file_id, len(s)::INT AS spans, list_sum(list_transform(s, lambda x: x."end" - x.start))::INT AS chars, s[1].start AS first FROM s',
)
LANG_SCORES = ", ".join(f"({' + '.join(f'{w} * len(regexp_extract_all(code, {quoted(p)}))' for p, w in signs)})::INT AS s{i}" for i, (lang, signs) in enumerate(LANGUAGE_SIGNS.items()))
LANG_LIST = ", ".join(f"{{'score': s{i}, 'at': -{i}, 'name': '{lang}'}}" for i, lang in enumerate(LANGUAGE_SIGNS))
on_files(
    "p03_detect_language",
    lambda f: f.select("file_id", "lang", F.explode(F.array(scan.detect_language(F.regexp_replace("code", "[^\\x00-\\x7f]", "x")))).alias("d")).select("file_id", "lang", F.col("d.best").alias("best"), F.col("d.score").alias("score"), F.col("d.confidence").alias("confidence")),
    f""", f AS (SELECT file_id, lang, regexp_replace(code, '[^\\x00-\\x7f]', 'x', 'g') AS code FROM files), s AS (SELECT file_id, lang, {LANG_SCORES} FROM f), t AS (SELECT file_id, lang, list_reverse_sort([{LANG_LIST}]) AS t FROM s)
        SELECT file_id, lang, CASE WHEN t[1].score > 0 THEN t[1].name END AS best, t[1].score AS score,
        CASE WHEN t[1].score >= 8 AND t[1].score - t[2].score >= 3 THEN 'high' WHEN t[1].score >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM t""",
)
LINES = "string_split(trim(code, ' '), chr(10))"
on_files(
    "p04_is_minified", lambda f: f.select("file_id", scan.is_minified(F.col("code")).alias("minified")),
    f" SELECT file_id, len(list_filter({LINES}, lambda x: length(x) > 500)) > 0 OR (list_sum(list_transform({LINES}, lambda x: length(x))) / len({LINES}) > 200 AND len({LINES}) < 5) AS minified FROM files",
)
on_files("p05_is_test_code", lambda f: f.where(F.col("lang") != "x").select("file_id", scan.is_test(F.regexp_replace("code", "[^\\x00-\\x7f]", "x")).alias("is_test")), f" SELECT file_id, {IS_TEST.replace('code', 'regexp_replace(code, ' + quoted('[^\\x00-\\x7f]') + ', ' + quoted('x') + ', ' + quoted('g') + ')')} AS is_test FROM files")
on_files("p14_tokens", quality.tokens, " SELECT project, sum(greatest(1, length(code) // 4))::BIGINT AS tokens FROM files GROUP BY project")

# -- scans --------------------------------------------------------------------------------------------------

on_violations("r01_rule_scan", lambda v: v, f" SELECT {COLUMNS} FROM violations")
on_files("r02_security_scan", scan.security_scan, f", {violations_sql([r for r in RULES if not r.lang])} SELECT {COLUMNS} FROM violations")
OWN = [Rule("OWN1", "", "leaked-token", r'token\s*=\s*"[0-9a-f]{40}"', "error"), Rule("OWN2", "", "open-bracket", r"\(\s*a\b", "info"), Rule("PY001", "", "", "", "info"), Rule("OWN3", "", "broken", "(", "error")]
CUSTOM = [r._replace(ignore_case=True) for r in OWN[:2]] + [r._replace(severity="info") for r in RULES if r.id == "PY001"]
on_files("r03_custom_rules", lambda f: scan.rule_scan(f, [r for r in scan.custom_rules(OWN) if r.id in ("OWN1", "OWN2", "OWN3", "PY001")]), f", {violations_sql(CUSTOM)} SELECT {COLUMNS} FROM violations")
on_files("r04_quick_scan", lambda f: scan.quick_scan(f, "essential"), f", {violations_sql([r for r in RULES if not r.lang or r.severity == 'error'])} SELECT {COLUMNS} FROM violations")
on_violations("p08_filter_severity", lambda v: scan.at_least(v, "warning").groupBy("severity").agg(F.count("*").alias("n")), " SELECT severity, count(*) AS n FROM violations WHERE severity IN ('error', 'warning') GROUP BY 1")
on_files(
    "p10_rule_filters", lambda f: scan.rule_scan(f.where("lang = 'python'"), [r for r in RULES if r.lang == "python" and r.category == "security"]),
    f", {violations_sql([r for r in RULES if r.lang == 'python' and r.category == 'security'])} SELECT {COLUMNS} FROM violations",
)
CHANGED = "file_id % 5 + 4"
on_files(
    "p09_filter_changed_lines", lambda f: scan.near_changes(scan.rule_scan(f), f.selectExpr("file_id", f"cast({CHANGED} as int) AS line")).select("file_id", "rule_id", "line", "col"),
    f" SELECT file_id, rule_id, line, col FROM violations WHERE abs(line - ({CHANGED})) <= 2", VIOLATIONS,
)
on_files(
    "j06_near_changed", lambda f: scan.near_changes(scan.rule_scan(f), f.selectExpr("file_id", "cast(file_id % 9 as int) AS line"), 1).groupBy("rule_id").agg(F.count("*").alias("n")),
    " SELECT rule_id, count(*) AS n FROM violations WHERE abs(line - file_id % 9) <= 1 GROUP BY rule_id", VIOLATIONS,
)
on_files(
    "u04_replaced_rules",
    lambda f: scan.replaced(v := cut(scan.rule_scan(f)), v.where("line < 9"), ["PY001", "PY003", "JS001"]).groupBy("rule_id").agg(F.count("*").alias("n")),
    " SELECT rule_id, count(*) AS n FROM violations WHERE rule_id NOT IN ('PY001', 'PY003', 'JS001') OR line < 9 GROUP BY rule_id", VIOLATIONS,
)
on_violations("u05_first_seen", scan.first_seen, " SELECT rule_id, f.file_id, f.line, f.col, n FROM (SELECT rule_id, min({'file_id': file_id, 'line': line, 'col': col}) AS f, count(*) AS n FROM violations GROUP BY rule_id)")
on_violations(
    "j09_related_violations", scan.related,
    """, e AS (SELECT DISTINCT file_id, category, rule_id FROM violations) SELECT a.file_id, a.rule_id, string_agg(b.rule_id, ',' ORDER BY b.rule_id) AS related FROM e a JOIN e b
        ON a.file_id = b.file_id AND a.category = b.category AND a.rule_id <> b.rule_id GROUP BY ALL""",
)

# -- scores and reports -------------------------------------------------------------------------------------

on_scores("a01_file_scores", lambda f, v, s: s, " SELECT file_id, project, lang, path, round(score, 9) AS score, passed, errors, warnings, infos, security FROM scores")
REPORT = "count(*) AS files, round(avg(score), 9) AS avg_score, round(avg(passed::INT), 9) AS pass_rate, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, sum(infos)::BIGINT AS infos"
on_scores("a03_corpus_report", lambda f, v, s: quality.report(s), f" SELECT project, {REPORT}, (project IS NULL)::INT AS total FROM scores GROUP BY ROLLUP (project)")
MAJORITY = ", n AS (SELECT project, lang, count(*) AS n FROM files GROUP BY ALL), major AS (SELECT project, lang FROM n QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, lang) = 1)"
on_scores("a04_project_report", lambda f, v, s: quality.project_report(s), MAJORITY + f", r AS (SELECT project, {REPORT} FROM scores GROUP BY project) SELECT r.*, major.lang FROM r JOIN major USING (project)")
on_both(
    "a05_convention_scan", lambda f, v, s: quality.convention_scan(f, s, v),
    MAJORITY + f""", r AS (SELECT project, {REPORT} FROM scores GROUP BY project), c AS (SELECT project, rule_id, count(*) AS n FROM violations JOIN (SELECT file_id, project FROM scores) USING (file_id) GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, rule_id) AS rank FROM c), top AS (SELECT project, string_agg(rule_id, ',' ORDER BY rank) AS top_rules FROM k WHERE rank <= 10 GROUP BY 1)
        SELECT r.*, major.lang, top_rules FROM r JOIN major USING (project) LEFT JOIN top USING (project)""",
)
on_files("a11_majority_language", quality.majority_language, MAJORITY + " SELECT project, lang FROM major")
MET = ", met AS (SELECT project, rule_id, count(DISTINCT file_id) AS files, count(*) AS n FROM violations JOIN (SELECT file_id, lang AS project FROM scores) USING (file_id) GROUP BY ALL), total AS (SELECT lang AS project, count(*) AS total FROM scores GROUP BY 1), conv AS (SELECT project, rule_id, met.files, n, least(0.95, 0.6 + met.files / total * 0.3) AS confidence FROM met JOIN total USING (project) WHERE met.files >= {} AND met.files / total >= {})"
on_both("a06_violation_conventions", lambda f, v, s: quality.violation_conventions(by_lang(s), v), MET.format(3, 0.3) + " SELECT project, rule_id, files, n, round(confidence, 9) AS confidence FROM conv")
on_scores("a06_clean_projects", lambda f, v, s: quality.clean_projects(s.withColumn("project", F.concat("lang", F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2))))), " SELECT lang || '/' || split_part(path, '/', 2) AS project, count(*) AS files, count(*) FILTER (errors + warnings + infos = 0) AS clean FROM scores GROUP BY ALL HAVING count(*) >= 5 AND count(*) FILTER (errors + warnings + infos = 0) / count(*) > 0.7")
on_both("a12_rules_from_conventions", lambda f, v, s: quality.rules_from_conventions(quality.violation_conventions(by_lang(s), v), 0.7), MET.format(3, 0.3) + " SELECT 'CONV-' || rule_id AS id, count(*) AS projects, round(max(confidence), 9) AS confidence FROM conv WHERE confidence >= 0.7 GROUP BY rule_id")
on_files(
    "a07_naming_convention", quality.naming_convention,
    """, n AS (SELECT project, regexp_replace(unnest(regexp_extract_all(code, 'def\\s+(\\w+)\\s*\\(', 1)), '^_+', '') AS name FROM files WHERE lang = 'python'),
        s AS (SELECT project, count(*) AS functions, avg(regexp_matches(name, '^[a-z][a-z0-9_]*$')::INT) AS snake, avg((regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') AND NOT regexp_matches(name, '^[a-z][a-z0-9_]*$'))::INT) AS camel FROM n WHERE name <> '' GROUP BY 1)
        SELECT project, functions, CASE WHEN snake > 0.8 THEN 'snake_case' ELSE 'camelCase' END AS style, round(least(0.95, greatest(snake, camel)), 9) AS confidence FROM s WHERE functions >= 10 AND (snake > 0.8 OR camel > 0.8)""",
)
MINED = [Rule("CONV-snake-case-functions", "python", "convention-snake-case-functions", r"def\s+[a-z]+[A-Z]\w*\s*\(", "warning")]


def _mined(files, violations, scores):
    """From conventions that the files keep to rules, and to violations of these."""
    broken, files = quality.violation_conventions(by_lang(scores), violations), by_lang(files)
    return scan.scan_by_rules(files, quality.mined_rules(quality.naming_convention(files), quality.docstring_convention(files), broken)).select("file_id", "rule_id", "line", "col", "snippet")


on_both(
    "a12_mined_violations", _mined,
    f""", mined AS (SELECT lang FROM (SELECT lang, regexp_replace(unnest(regexp_extract_all(code, 'def\\s+(\\w+)\\s*\\(', 1)), '^_+', '') AS name FROM files WHERE lang = 'python') WHERE name <> '' GROUP BY 1
            HAVING count(*) >= 10 AND avg(regexp_matches(name, '^[a-z][a-z0-9_]*$')::INT) > 0.8), {violations_sql(MINED, 'own')}
        SELECT file_id, rule_id, own.line, col, snippet FROM own JOIN files USING (file_id) WHERE lang IN (SELECT lang FROM mined)""",
)
on_files(
    "a08_import_convention", quality.import_convention,
    """, s AS (SELECT project, count(*) AS files, avg(contains(code, 'from __future__ import annotations')::INT) AS future, avg(contains(code, 'TYPE_CHECKING')::INT) AS type_checking FROM files WHERE lang = 'python' GROUP BY 1)
        SELECT project, files, round(future, 9) AS future, round(type_checking, 9) AS type_checking, future > 0.5 AS future_convention, type_checking > 0.3 AS type_checking_convention FROM s WHERE files >= 5""",
)
on_files(
    "a09_docstring_convention", quality.docstring_convention,
    """, d AS (SELECT project, unnest(regexp_extract_all(code, '(?m)^[ \\t]*(?:async[ \\t]+)?def[ \\t]+\\w+[^\\n]*:[^\\n]*\\n(?:[ \\t]*\"\"\"|)')) AS d FROM files WHERE lang = 'python'),
        s AS (SELECT project, count(*) AS functions, avg(ends_with(d, '\"\"\"')::INT) AS documented FROM d GROUP BY 1)
        SELECT project, functions, round(documented, 9) AS documented, CASE WHEN functions >= 10 AND documented > 0.6 THEN 'documented' WHEN functions >= 10 AND documented < 0.2 THEN 'undocumented' END AS convention FROM s""",
)
on_scores("a10_quality_convention", lambda f, v, s: quality.quality_convention(s.withColumn("project", F.col("lang"))), " SELECT lang AS project, round(avg(score), 9) AS avg_score, CASE WHEN round(avg(score), 9) >= 0.9 THEN 'high' WHEN round(avg(score), 9) < 0.6 THEN 'low' END AS fact FROM scores GROUP BY 1")
on_scores(
    "a19_category_breakdown", lambda f, v, s: quality.category_breakdown(v),
    ", n AS (SELECT category, rule_id, count(*) AS n FROM violations GROUP BY ALL) SELECT category, sum(n)::BIGINT AS violations, count(*) AS rules, first(rule_id ORDER BY n DESC, rule_id) AS top_rule FROM n GROUP BY category",
)


def _gated(files, violations, scores):
    """Projects of one language; those in Go have a finding that is severe, those in Rust one that isn't."""
    named = scores.withColumn("project", F.concat("project", F.lit("/"), "lang"))
    found = named.where("lang in ('go', 'rust')").select("project", F.when(F.col("lang") == "go", "high").otherwise("low").alias("severity")).distinct()
    return quality.gate(named, found)


on_scores("a20_gate", _gated, " SELECT project || '/' || lang AS project, CASE WHEN sum(errors) = 0 AND lang <> 'go' THEN 'PASS' ELSE 'FAIL' END AS gate, count(*) FILTER (errors > 0) AS files_with_errors, (lang = 'go')::BIGINT AS severe FROM scores WHERE project IS NOT NULL GROUP BY project, lang")
on_scores("p25_confidence_level", lambda f, v, s: quality.confidence(s), " SELECT file_id, CASE WHEN errors > 0 OR security > 0 THEN 'low' WHEN warnings > 3 OR NOT contains(path, '/tests/') THEN 'medium' ELSE 'high' END AS confidence FROM scores")
on_scores("p17_stringency", lambda f, v, s: s.groupBy(quality.stringency(F.round("score", 9)).alias("stringency")).agg(F.count("*").alias("files")), " SELECT CASE WHEN round(score, 9) >= 0.7 THEN 'strict' WHEN round(score, 9) >= 0.3 THEN 'moderate' ELSE 'permissive' END AS stringency, count(*) AS files FROM scores GROUP BY 1")
on_scores(
    "p27_suggest_profile", lambda f, v, s: quality.suggest_profile(s.withColumn("project", F.concat("project", F.lit("/"), "lang"))),
    """, p AS (SELECT project || '/' || lang AS project, round(avg(score), 9) AS a, round(avg(passed::INT), 9) AS p, count(*) AS files FROM scores GROUP BY 1) SELECT project, files,
        CASE WHEN a >= 0.9 AND p >= 0.9 THEN CASE WHEN files > 50 THEN 'enterprise' ELSE 'library' END WHEN a >= 0.7 THEN 'default' WHEN a >= 0.5 THEN 'startup' ELSE 'prototype' END AS profile FROM p""",
)
on_scores("t01_top_rules", lambda f, v, s: quality.top_rules(v), " SELECT rule_id, count(*) AS n FROM violations GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 10")
on_scores("t02_worst_files", lambda f, v, s: quality.worst_files(s), " SELECT file_id, round(score, 9) AS score FROM scores ORDER BY round(score, 9), file_id LIMIT 20")
on_both("u02_common_rules", lambda f, v, s: quality.common_rules(s, v), ", met AS (SELECT DISTINCT project, rule_id FROM violations JOIN (SELECT file_id, project FROM scores) USING (file_id)) SELECT rule_id, count(*) AS projects FROM met GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT project) FROM met)")
on_scores(
    "r06_compare_candidates", lambda f, v, s: scan.compare_candidates(s.selectExpr("project AS group", "path AS label", "round(score, 9) AS score", "errors")),
    " SELECT project AS \"group\", first(path ORDER BY round(score, 9) DESC, errors, path) AS winner, count(*) AS variants FROM scores GROUP BY project",
)
on_scores(
    "u01_violation_sources", lambda f, v, s: v.select("file_id", "rule_id").unionByName(scan.security_scan(f).select("file_id", "rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files")),
    " SELECT rule_id, count(*) * CASE WHEN starts_with(rule_id, 'SEC') THEN 2 ELSE 1 END AS n, count(DISTINCT file_id) AS files FROM violations GROUP BY rule_id",
)
GLOBS = [(1, text.glob_to_regex("src/tests/*"), 0.5), (2, text.glob_to_regex("*.py"), 0.9), (3, text.glob_to_regex("src/api/*"), None)]
on_files(
    "p11_thresholds", lambda f: quality.thresholds(f, f.sparkSession.createDataFrame(GLOBS, "ord int, pattern string, least double"), 0.7),
    " SELECT file_id, CASE WHEN starts_with(path, 'src/tests/') THEN 0.5::DOUBLE WHEN ends_with(path, '.py') THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS least FROM files",
)
PREFIXES = [("all", "src/"), ("api", "src/api/"), ("api1", "src/api/f1")]
on_files(
    "p12_resolve_project", lambda f: quality.resolve_prefix(f, f.sparkSession.createDataFrame(PREFIXES, "name string, prefix string")),
    " SELECT file_id, CASE WHEN starts_with(path, 'src/api/f1') THEN 'api1' WHEN starts_with(path, 'src/api/') THEN 'api' ELSE 'all' END AS name FROM files",
)


def _lint(spark, sf_dir):
    f = files(spark, sf_dir)
    v = scan.rule_scan(f)
    lint = f.where("file_id % 3 = 0").selectExpr("file_id", "'EXT1' AS rule_id", "'warning' AS severity", "'style' AS category")
    return rounded(quality.file_scores(f, v.select("file_id", "rule_id", "severity", "category").unionByName(lint)).select("file_id", "score"))


QUERIES["a02_rescore_with_linters"] = _lint
ORACLE["a02_rescore_with_linters"] = SCORES + ", c AS (SELECT file_id, coalesce(cost, 0) + CASE WHEN file_id % 3 = 0 THEN 0.08::DOUBLE ELSE 0 END AS c FROM files LEFT JOIN by_file USING (file_id)) SELECT file_id, round(greatest(0.0, 1 - c), 9) AS score FROM c"


def _pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr("page_id AS file_id", "'javascript' AS lang", "coalesce(html, '') AS code")
    return scan.rule_scan(pages, [r for r in RULES if r.lang == "javascript"]).select("file_id", "rule_id", "line", "col")


QUERIES["r01_scan_pages"] = _pages
ORACLE["r01_scan_pages"] = f"WITH files AS (SELECT page_id AS file_id, 'javascript' AS lang, coalesce(html, '') AS code FROM pages), {violations_sql([r for r in RULES if r.lang == 'javascript'])} SELECT file_id, rule_id, line, col FROM violations"
