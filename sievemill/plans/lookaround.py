"""Registered queries of line rules, functions, diffs, dependencies, plans and prompts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, lines
from ..sources.corpus import FILES_SQL, files
from ..sources.tables import table
from .history import rounded

QUERIES, ORACLE = {}, {}
LINES = f"""WITH {FILES_SQL}, split AS (SELECT file_id, lang, unnest(string_split(code, chr(10))) AS text, generate_subscripts(string_split(code, chr(10)), 1)::INT AS line FROM files),
    lines AS (SELECT *, length(text) - length(ltrim(text, ' ')) AS indent, trim(text, ' ') = '' AS blank FROM split)"""


def add(name: str, function, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
    ORACLE[name] = sql


def on_lines(name: str, function, sql: str) -> None:
    add(name, lambda spark, sf_dir: function(lines.lines(files(spark, sf_dir))), LINES + sql)


def on_functions(name: str, function, sql: str) -> None:
    add(name, lambda spark, sf_dir: function(lines.functions(files(spark, sf_dir))), FUNCTIONS + sql)


WITHIN = ", w AS (SELECT *, min(CASE WHEN regexp_matches(text, '{hit}') THEN line END) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND {reach} FOLLOWING) AS hit FROM lines) SELECT file_id, line, hit FROM w WHERE regexp_matches(text, '{opener}') AND hit IS NOT NULL"
FUNCTIONS = LINES + """, defs AS (SELECT file_id, line AS start, indent, regexp_extract(text, 'def\\s+(\\w+)', 1) AS name FROM lines WHERE lang = 'python' AND regexp_matches(text, '^\\s*(?:async\\s+)?def\\s+\\w+')),
    stops AS (SELECT d.file_id, d.start, any_value(name) AS name, coalesce(min(l.line) FILTER (l.line > d.start AND NOT blank AND l.indent <= d.indent) - 1, max(l.line))::INT AS stop FROM defs d JOIN lines l USING (file_id) GROUP BY ALL),
    bodies AS (SELECT s.file_id, name, start, stop, coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (t <> ''), '') AS body FROM stops s LEFT JOIN
        (SELECT file_id, line, trim(regexp_replace(regexp_replace(text, '#[^\\n]*', '', 'g'), '[ \\t]+', ' ', 'g'), ' ') AS t FROM lines) l ON l.file_id = s.file_id AND line > start AND line <= stop GROUP BY ALL)"""
on_lines("l08_query_in_loop", lines.query_in_loop, WITHIN.format(opener=lines.LOOP, hit=lines.QUERY, reach=20))
on_lines("l10_blocking_in_async", lines.blocking_in_async, WITHIN.format(opener=lines.ASYNC, hit=lines.BLOCKING, reach=49))
on_lines(
    "l13_undocumented_unsafe", lines.undocumented_unsafe,
    ", w AS (SELECT *, bool_or(regexp_matches(text, '//.*SAFETY')) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS safe FROM lines) SELECT file_id, line FROM w WHERE regexp_matches(text, '\\bunsafe\\s*\\{') AND NOT safe",
)
on_lines("l17_file_length", lambda t: lines.long_files(t, 8), " SELECT file_id, count(*) FILTER (NOT blank AND NOT regexp_matches(ltrim(text, ' '), '^(?:#|//)')) AS lines FROM lines GROUP BY 1 HAVING count(*) FILTER (NOT blank AND NOT regexp_matches(ltrim(text, ' '), '^(?:#|//)')) > 8")
on_functions("l17_function_length", lambda t: lines.long_functions(t, 5), " SELECT file_id, name, start, stop - start + 1 AS length FROM bodies WHERE stop - start + 1 > 5")
on_functions("l03_duplicate_functions", lines.duplicates, ", k AS (SELECT file_id, start, md5(body) AS h FROM bodies), f AS (SELECT h, min({'f': file_id, 's': start}) AS first, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1) SELECT file_id, start, first.f AS first_id, n FROM k JOIN f USING (h) WHERE {'f': file_id, 's': start} <> first")
on_functions("l26_duplicate_tests", lambda t: lines.duplicates(t.where("startswith(name, 'test_')")), ", k AS (SELECT file_id, start, md5(body) AS h FROM bodies WHERE starts_with(name, 'test_')), f AS (SELECT h, min({'f': file_id, 's': start}) AS first, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1) SELECT file_id, start, first.f AS first_id, n FROM k JOIN f USING (h) WHERE {'f': file_id, 's': start} <> first")
on_lines(
    "l28_magic_numbers", lines.magic_numbers,
    ", w AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY file_id ORDER BY line), '') AS prior FROM lines) SELECT file_id, line FROM w WHERE regexp_matches(text, '^\\s*assert\\b.*[^\\w.][0-9]{2,}') AND NOT contains(text, '#') AND NOT starts_with(ltrim(prior, ' '), '#')",
)


def _paragraphs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("start", "body")).where(F.size(F.split("body", " ")) > 5)


add(
    "l03_duplicate_paragraphs", lambda spark, sf_dir: lines.duplicates(_paragraphs(spark, sf_dir)),
    """WITH p AS (SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS body, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS start FROM documents),
        k AS (SELECT file_id, start, md5(body) AS h FROM p WHERE len(string_split(body, ' ')) > 5), f AS (SELECT h, min({'f': file_id, 's': start}) AS first, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1)
        SELECT file_id, start, first.f AS first_id, n FROM k JOIN f USING (h) WHERE {'f': file_id, 's': start} <> first""",
)


def _diff(spark, sf_dir):
    rows = lines.lines(files(spark, sf_dir)).select(F.col("file_id").alias("diff_id"), F.col("line").alias("seq"), "text")
    text = F.when(F.col("seq") == 1, F.concat(F.lit("+++ b/f"), F.col("diff_id"))).when(F.col("seq") % 6 == 2, F.format_string("@@ -%d,5 +%d,5 @@", "seq", F.col("seq") * 2)).otherwise(
        F.concat(F.when(F.col("seq") % 3 == 0, "+").when(F.col("seq") % 3 == 1, " ").otherwise("-"), F.col("text"))
    )
    return rows.withColumn("text", text)


add(
    "j05_changed_lines", lambda spark, sf_dir: lines.changed_lines(_diff(spark, sf_dir)),
    LINES + """, h AS (SELECT file_id AS diff_id, line AS seq, text, line - (line - 2) % 6 AS hunk FROM lines WHERE line > 1 AND line % 6 <> 2)
        SELECT diff_id, 'b/f' || diff_id AS path, (hunk * 2 + (SELECT count(*) FROM range(hunk + 1, seq + 1) r(x) WHERE x % 3 <> 2) - 1)::INT AS line, text AS added FROM h WHERE seq % 3 = 0""",
)

# -- dependencies: manifests by source, advisories by part ---------------------------------------------------


def _dependencies(spark, sf_dir):
    line = F.format_string("# pinned\nPkg_%d.Core>=%d.%d\n-r base.txt\n", F.col("doc_id") % 40, F.col("doc_id") % 3, F.col("doc_id") % 4)
    return joins.parse_requirements(table(spark, sf_dir, "documents").select(F.col("source").alias("project"), line.alias("text"))).distinct()


def _advisories(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("concat('pkg-', p_partkey % 40, '-core') AS package", "concat(p_partkey % 3, '.', p_partkey % 4) AS version", "concat('V', p_partkey) AS vuln_id", "if(p_size % 5 = 0, 'none', cast(p_size % 11 as string)) AS score")


DEPS = "WITH deps AS (SELECT DISTINCT source AS project, 'pkg-' || (doc_id % 40) || '-core' AS package, (doc_id % 3) || '.' || (doc_id % 4) AS version FROM documents), advisories AS (SELECT 'pkg-' || (p_partkey % 40) || '-core' AS package, (p_partkey % 3) || '.' || (p_partkey % 4) AS version, 'V' || p_partkey AS vuln_id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 11 END AS score FROM part), found AS (SELECT project, package, version, vuln_id, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score IS NOT NULL THEN 'low' ELSE 'medium' END AS severity FROM deps JOIN advisories USING (package, version))"
add("s09_dependencies", _dependencies, DEPS + " SELECT project, package, version FROM deps")
add("j03_scan_dependencies", lambda spark, sf_dir: joins.findings(_dependencies(spark, sf_dir), _advisories(spark, sf_dir)), DEPS + " SELECT * FROM found")
add("p19_severity_map", lambda spark, sf_dir: _advisories(spark, sf_dir).select("vuln_id", joins.cvss_severity(F.col("score")).alias("severity")), DEPS + " SELECT vuln_id, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score IS NOT NULL THEN 'low' ELSE 'medium' END AS severity FROM advisories")
add("a25_severity_counts", lambda spark, sf_dir: joins.finding_counts(joins.findings(_dependencies(spark, sf_dir), _advisories(spark, sf_dir))), DEPS + " SELECT project, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low")) + ", count(DISTINCT package) AS packages FROM found GROUP BY project")
add(
    "j04_lock_enrich", lambda spark, sf_dir: joins.lock_enriched(d := _dependencies(spark, sf_dir), d.where("version > '1.2'").groupBy("project", "package").agg(F.max("version").alias("locked"))),
    DEPS + ", locks AS (SELECT project, package, max(version) AS locked FROM deps WHERE version > '1.2' GROUP BY ALL) SELECT project, package, coalesce(locked, version) AS version FROM deps LEFT JOIN locks USING (project, package)",
)


# -- plans: the events of a user in order ---------------------------------------------------------------------


def _steps(spark, sf_dir):
    from pyspark.sql import Window

    placed = table(spark, sf_dir, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return placed.select(F.col("user_id").alias("plan_id"), "step", F.expr("array(cast(event_id % 23 as int))").alias("needs"))


STEPS = "WITH RECURSIVE placed AS (SELECT user_id AS plan_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_id % 23 AS need FROM events), steps AS (SELECT * FROM placed)"
add("j19_dangling_deps", lambda spark, sf_dir: joins.dangling(_steps(spark, sf_dir)), STEPS + " SELECT plan_id, step::INT AS step, need::INT AS need FROM steps s WHERE NOT EXISTS (FROM steps t WHERE t.plan_id = s.plan_id AND t.step = s.need)")
add("x11_plan_cycles", lambda spark, sf_dir: joins.cycles(_steps(spark, sf_dir)), STEPS + ", reach AS (SELECT plan_id, step AS a, need AS b FROM steps UNION SELECT r.plan_id, a, s.need FROM reach r JOIN steps s ON s.plan_id = r.plan_id AND s.step = r.b) SELECT plan_id, a::INT AS step FROM reach WHERE a = b")

# -- prompts: the users' turns, with a request before them -----------------------------------------------------
REQUESTS = ["fix the login bug in the python api", "maybe do something with the cache stuff", "add tests", "refactor the database schema and the cache index", "review security of the auth token in go"]
TRIGGERS = [("caching", 1, "cache"), ("caching", 1, "ttl"), ("data", 2, "database"), ("data", 2, "schema"), ("data", 2, "index"), ("auth", 3, "auth"), ("auth", 3, "token"), ("auth", 3, "login"), ("testing", 4, "tests")]


def _prompts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    request = F.element_at(F.array(*map(F.lit, REQUESTS)), (F.col("conv_id") % len(REQUESTS)).cast("int") + 1)
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.when(F.col("turn") == 0, request).otherwise(F.concat(request, F.lit(" "), F.coalesce("text", F.lit("")))).alias("text"))


PROMPTS = f"WITH prompts AS (SELECT conv_id * 1000 + turn AS prompt_id, {REQUESTS}[conv_id % {len(REQUESTS)} + 1] || CASE WHEN turn = 0 THEN '' ELSE ' ' || coalesce(text, '') END AS text FROM conversations WHERE role = 'user')"
add(
    "j12_decision_guidance", lambda spark, sf_dir: joins.guidance(_prompts(spark, sf_dir), spark.createDataFrame(TRIGGERS, "domain string, ord int, trigger string")),
    PROMPTS + f", t(domain, ord, trigger) AS (VALUES {', '.join(map(str, TRIGGERS))}), n AS (SELECT prompt_id, domain, count(*) AS hits, min(ord) AS ord FROM prompts JOIN t ON contains(lower(text), trigger) GROUP BY ALL) SELECT prompt_id, domain, hits, (row_number() OVER w)::INT AS rank FROM n WINDOW w AS (PARTITION BY prompt_id ORDER BY hits DESC, ord) QUALIFY row_number() OVER w <= 2",
)
