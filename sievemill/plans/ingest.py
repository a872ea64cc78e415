"""Registered queries of lint reports, manifests, advisories and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, quality, scan
from ..places import cut
from ..sources import reports as made
from ..sources.corpus import FILES_SQL, files, files_sql
from ..sources.samples import FIX_SAMPLES
from ..sources.tables import table
from .history import rounded
from .lookaround import LINES, _diff
from .scanning import SCORES, VIOLATIONS, violations_sql

QUERIES, ORACLE = {}, {}


def add(name: str, function, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
    ORACLE[name] = sql


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


LINT = f"""WITH {made.REPORTS_SQL}, ok AS (SELECT * FROM reports WHERE tool = 'mypy' OR json_valid(raw)),
    ruff AS (SELECT file_id, e->>'code' AS code, e->>'message' AS message, (e->'location'->>'row')::INT AS line, (e->'location'->>'column')::INT AS col FROM (SELECT file_id, unnest(CAST(raw AS JSON[])) AS e FROM ok WHERE tool = 'ruff')),
    mypy AS (SELECT file_id, e->>'code' AS code, e->>'severity' AS sev, e->>'message' AS message, (e->>'line')::INT AS line, (e->>'column')::INT AS col
        FROM (SELECT file_id, CAST(l AS JSON) AS e FROM (SELECT file_id, unnest(string_split(raw, chr(10))) AS l FROM ok WHERE tool = 'mypy') WHERE l <> '' AND json_valid(l))),
    eslint AS (SELECT file_id, e->>'ruleId' AS code, (e->>'severity')::INT AS sev, e->>'message' AS message, (e->>'line')::INT AS line, (e->>'column')::INT AS col
        FROM (SELECT file_id, unnest(CAST(f->'messages' AS JSON[])) AS e FROM (SELECT file_id, unnest(CAST(raw AS JSON[])) AS f FROM ok WHERE tool = 'eslint'))),
    lint AS (SELECT file_id, 'RUFF-' || coalesce(code, '') AS rule_id, coalesce(code, '') AS rule, 'style' AS category, CASE WHEN starts_with(code, 'S') OR starts_with(code, 'E9') THEN 'error' ELSE 'warning' END AS severity, coalesce(message, '') AS message, line, col FROM ruff
        UNION ALL SELECT file_id, 'MYPY-' || coalesce(code, 'E'), coalesce(code, 'error'), 'style', CASE WHEN sev = 'note' THEN 'info' ELSE coalesce(sev, 'error') END, coalesce(message, ''), line, col FROM mypy
        UNION ALL SELECT file_id, 'ESLINT-' || coalesce(code, 'unknown'), coalesce(code, 'parse-error'), 'style', CASE WHEN sev = 2 THEN 'error' ELSE 'warning' END, coalesce(message, ''), line, col FROM eslint)
"""
add("s06_lint_reports", lambda s, d: ingest.lint_reports(made.reports(docs(s, d))), LINT + "SELECT * FROM lint")


def _rescored(spark, sf_dir):
    """Scores by the scan and the reports together."""
    f = files(spark, sf_dir)
    both = scan.rule_scan(f).unionByName(ingest.lint_reports(made.reports(docs(spark, sf_dir))), allowMissingColumns=True)
    return quality.file_scores(f, both).select("file_id", "score", "passed", "errors", "warnings")


add(
    "a02_rescore_with_reports", _rescored,
    VIOLATIONS + ", " + LINT.removeprefix("WITH ") + """, both_ AS (SELECT file_id, severity FROM violations UNION ALL SELECT file_id, severity FROM lint),
        n AS (SELECT file_id, sum(CASE severity WHEN 'error' THEN 0.25::DOUBLE WHEN 'warning' THEN 0.08::DOUBLE ELSE 0.02::DOUBLE END) AS cost, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM both_ GROUP BY 1)
        SELECT file_id, round(greatest(0.0, 1 - coalesce(cost, 0)), 9) AS score, coalesce(errors, 0) = 0 AS passed, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM files LEFT JOIN n USING (file_id)""",
)

# -- diffs ----------------------------------------------------------------------------------------------------

add(
    "s07_diff_lines", lambda s, d: ingest.diff_lines(_diff(s, d)).groupBy("diff_id", "kind").agg(F.count("*").alias("n"), F.max("seq").alias("last")),
    LINES + ", k AS (SELECT file_id AS diff_id, line AS seq, CASE WHEN line = 1 THEN 'file' WHEN line % 6 = 2 THEN 'hunk' WHEN line % 3 = 0 THEN 'added' WHEN line % 3 = 1 THEN 'kept' ELSE 'removed' END AS kind FROM lines) SELECT diff_id, kind, count(*) AS n, max(seq) AS last FROM k GROUP BY ALL",
)


def _changed(f):
    """A third of each file's lines."""
    line = F.explode(F.sequence(F.lit(1), F.size(F.split("code", "\n"))))
    return f.select("file_id", line.alias("line")).where("(line + file_id) % 3 = 0")


add(
    "r07_diff_scan", lambda s, d: ingest.diff_scan(scan.rule_scan(f := files(s, d)), _changed(f)).select("file_id", "rule_id", "line", "col"),
    VIOLATIONS + " SELECT file_id, rule_id, line, col FROM violations WHERE (line + file_id) % 3 = 0",
)



def _whole_diff(f):
    """A diff of each file that adds two of three lines; every other file has another path in it, and begins ten lines later."""
    known = F.col("file_id") % 2 == 0
    head = F.concat(F.lit("--- a/x\n+++ b/"), F.when(known, F.col("path")).otherwise(F.concat(F.lit("new/"), "path")), F.lit("\n@@ -1,3 +"), F.when(known, "1").otherwise("11"), F.lit(",9 @@"))
    rows = F.transform(F.split("code", "\n"), lambda t, i: F.concat(F.when(i % 3 == 0, F.lit(" ")).otherwise("+"), t))
    return f.select(F.col("file_id").alias("diff_id"), F.posexplode(F.concat(F.split(head, "\n"), rows)).alias("seq", "text"))


add(
    "r07_scan_diffs", lambda s, d: ingest.scan_diff(_whole_diff(f := files(s, d, FIX_SAMPLES)), f).select("diff_id", "path", "rule_id", "severity", "line", "col", "snippet"),
    f"""WITH {files_sql(FIX_SAMPLES).replace(" files AS (", " base AS (")}, l AS (SELECT file_id, unnest(string_split(code, chr(10))) AS t, generate_subscripts(string_split(code, chr(10)), 1) AS n FROM base),
        a AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n) AS k FROM l WHERE n % 3 <> 1), new AS (SELECT file_id, string_agg(t, chr(10) ORDER BY n) AS code FROM a GROUP BY 1),
        files AS (SELECT file_id, path, lang, CASE WHEN file_id % 2 = 0 THEN b.code ELSE coalesce(n.code, '') END AS code FROM base b LEFT JOIN new n USING (file_id)), {violations_sql()}
        SELECT a.file_id AS diff_id, CASE WHEN a.file_id % 2 = 0 THEN path ELSE 'new/' || path END AS path, rule_id, severity, (a.n + CASE WHEN a.file_id % 2 = 0 THEN 0 ELSE 10 END)::INT AS line, col, snippet
        FROM violations v JOIN files f USING (file_id) JOIN a ON a.file_id = v.file_id AND v.line = CASE WHEN a.file_id % 2 = 0 THEN a.n ELSE a.k END""",
)

# -- manifests ------------------------------------------------------------------------------------------------

ECOSYSTEM = "CASE name " + " ".join(f"WHEN '{n}' THEN '{e}'" for n, e in ingest.ECOSYSTEMS.items()) + " END"
add(
    "s08_scan_manifests", lambda s, d: ingest.manifests(made.manifest_files(docs(s, d))).select("project", "path", "ecosystem"),
    f"WITH {made.MANIFESTS_SQL} SELECT project, path, {ECOSYSTEM} AS ecosystem FROM manifest_files WHERE {ECOSYSTEM} IS NOT NULL",
)
#: What the five manifests say, worked out from the numbers in them.
DEPENDENCIES = """WITH d AS (SELECT source AS project, doc_id % 6 AS k, (doc_id % 40)::VARCHAR AS n, (doc_id % 4)::VARCHAR AS m FROM documents),
    deps AS (SELECT project, 'PyPI' AS ecosystem, 'pkg-' || n || '-core' AS package, '1.' || m AS version, false AS dev FROM d WHERE k = 0 UNION ALL SELECT project, 'PyPI', 'flask', '', false FROM d WHERE k = 0
        UNION ALL SELECT project, 'PyPI', 'fast-api', m || '.5', false FROM d WHERE k = 1 UNION ALL SELECT project, 'PyPI', 'pkg-' || n, '2.' || m, false FROM d WHERE k = 1
        UNION ALL SELECT project, 'PyPI', 'django', m || '.1', false FROM d WHERE k = 2 UNION ALL SELECT project, 'PyPI', 'pkg-' || n, '', false FROM d WHERE k = 2
        UNION ALL SELECT project, 'npm', 'react', m || '.2.0', false FROM d WHERE k = 3 UNION ALL SELECT project, 'npm', '@scope/pkg-' || n, '', false FROM d WHERE k = 3 UNION ALL SELECT project, 'npm', 'next', '13.' || m, true FROM d WHERE k = 3
        UNION ALL SELECT project, 'Go', 'pkg' || n, '1.' || m || '.0', false FROM d WHERE k = 4 UNION ALL SELECT project, 'Go', 'net', '0.' || m || '.1', false FROM d WHERE k = 4)
"""


def _dependencies(spark, sf_dir):
    return ingest.dependencies(ingest.manifests(made.manifest_files(docs(spark, sf_dir))))


add("s09_manifest_dependencies", _dependencies, DEPENDENCIES + "SELECT * FROM deps")
add("j15_frameworks", lambda s, d: ingest.frameworks(_dependencies(s, d)), DEPENDENCIES + "SELECT project, CASE package WHEN 'next' THEN 'next.js' ELSE package END AS framework, arg_max(version, {'n': list_transform(regexp_extract_all(version, '([0-9]+)', 1), lambda x: x::BIGINT), 'v': version}) AS version FROM deps WHERE package IN ('flask', 'django', 'react', 'next') GROUP BY ALL")
add("s10_lock_versions", lambda s, d: ingest.lock_versions(made.locks(docs(s, d))), "SELECT source AS project, 'react' AS package, (doc_id % 4) || '.9.9' AS locked FROM documents")


def _advisories(spark, sf_dir):
    """An advisory of each part as JSON: in every third the first range has no fix, in every fourth there is none at all."""
    first = F.when(F.col("p_partkey") % 3 == 0, '[{"introduced":"0"}]').otherwise(F.format_string('[{"introduced":"0"},{"fixed":"%d.1"}]', F.col("p_partkey") % 9))
    text = F.when(F.col("p_partkey") % 4 == 0, '{"affected":[]}').otherwise(F.format_string('{"affected":[{"ranges":[{"events":%s}]},{"ranges":[{"events":[{"fixed":"%d.7"}]}]}]}', first, F.col("p_partkey") % 5))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("advisory"))


add(
    "p20_fixed_version", lambda s, d: _advisories(s, d).select("p_partkey", ingest.fixed_version(F.col("advisory")).alias("fixed")),
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN (p_partkey % 5) || '.7' ELSE (p_partkey % 9) || '.1' END AS fixed FROM part",
)


def _vulnerable(spark, sf_dir):
    module = F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"(?m)^(?:import|from)\s+([\w.]+)"), F.lit(1))))
    imports = files(spark, sf_dir).where("lang = 'python'").select("file_id", "project", module.alias("module"))
    found = docs(spark, sf_dir).selectExpr("source AS project", "element_at(array('NumPy', 'requests', 'py-yaml'), cast(doc_id % 3 as int) + 1) AS package", "concat('V', doc_id % 7) AS vuln_id", "element_at(array('low', 'medium', 'high', 'critical'), cast(doc_id % 7 % 4 as int) + 1) AS severity")
    return ingest.vulnerable_imports(imports, found.distinct())


add(
    "j02_vulnerable_imports", _vulnerable,
    f"""WITH {FILES_SQL}, found AS (SELECT DISTINCT source AS project, ['NumPy', 'requests', 'py-yaml'][doc_id % 3 + 1] AS package, 'V' || (doc_id % 7) AS vuln_id, ['low', 'medium', 'high', 'critical'][doc_id % 7 % 4 + 1] AS severity FROM documents),
        i AS (SELECT DISTINCT file_id, project, lower(split_part(m, '.', 1)) AS module FROM (SELECT file_id, project, unnest(regexp_extract_all(code, '(?m)^(?:import|from)\\s+([\\w.]+)', 1)) AS m FROM files WHERE lang = 'python'))
        SELECT file_id, 'SEC014' AS rule_id, package, vuln_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END AS severity FROM i JOIN found f ON f.project = i.project AND replace(lower(f.package), '-', '_') = i.module""",
)

# -- exports, read again ---------------------------------------------------------------------------------------

_READ = "struct<version:string,runs:array<struct<tool:struct<driver:struct<rules:array<struct<id:string,defaultConfiguration:struct<level:string>>>>>,results:array<struct<ruleId:string,level:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>>"


def _sarif(spark, sf_dir):
    run = F.from_json("sarif", _READ)["runs"][0]
    rows = ingest.sarif(scan.rule_scan(f := files(spark, sf_dir)), f).select("file_id", F.array_join(F.transform(run["tool"]["driver"]["rules"], lambda r: r["id"]), ",").alias("rules"), F.posexplode(run["results"]).alias("nr", "r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return rows.select("file_id", "rules", "nr", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("line"))


add(
    "s11_export_sarif", _sarif,
    VIOLATIONS + """, o AS (SELECT *, (row_number() OVER (PARTITION BY file_id ORDER BY line, col, rule_id) - 1)::INT AS nr FROM violations), first_ AS (SELECT file_id, rule_id, min(nr) AS f FROM o GROUP BY ALL),
        rules_ AS (SELECT file_id, string_agg(rule_id, ',' ORDER BY f) AS rules FROM first_ GROUP BY 1)
        SELECT file_id, rules, nr, rule_id, CASE severity WHEN 'info' THEN 'note' ELSE severity END AS level, path, greatest(line, 1) AS line FROM o JOIN rules_ USING (file_id) JOIN files USING (file_id)""",
)


def _json(spark, sf_dir):
    f = files(spark, sf_dir)
    v = cut(scan.rule_scan(f))
    read = F.from_json("json", "struct<path:string,score:double,passed:boolean,violations:array<struct<line:int,rule_id:string>>>")
    out = ingest.json_results(quality.file_scores(f, v), v).select("file_id", read.alias("j"))
    return out.select("file_id", "j.path", "j.score", "j.passed", F.size("j.violations").alias("n"), F.array_join(F.transform("j.violations", lambda x: F.concat_ws(":", x["line"].cast("string"), x["rule_id"])), ",").alias("violations"))


add(
    "s12_export_json", _json,
    SCORES + ", o AS (SELECT file_id, count(*)::INT AS n, string_agg(line || ':' || rule_id, ',' ORDER BY line, col, rule_id, severity) AS violations FROM violations GROUP BY 1) SELECT file_id, path, round(score, 9) AS score, passed, coalesce(n, 0) AS n, coalesce(violations, '') AS violations FROM scores LEFT JOIN o USING (file_id)",
)
