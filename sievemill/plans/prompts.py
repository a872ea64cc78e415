"""Registered queries of prompts, semantic checks, layers and knowledge, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import FOREIGN
from ..operators import architecture as a
from ..operators import entities as e
from ..operators import prompts as p
from ..operators import quality, scan
from ..operators.checks import inferred_severity
from ..operators.lines import lines
from ..places import cut
from ..sources.corpus import FILES_SQL, files, quoted
from ..sources.tables import VALIDATIONS_SQL, table, validations
from .history import rounded
from .lookaround import LINES
from .planning import listed, rlike
from .scanning import SCORES, VIOLATIONS, spans_sql

QUERIES, ORACLE = {}, {}
SECURITY = r"\bauth\b|\bauthentication\b|\bauthorization\b|\blogin\b|\bpassword\b|\btoken\b|\bjwt\b|\bsession\b|\bpermission\b|\baccess control\b|\bencrypt\b|\bhash\b|\bsecure\b|\bsecurity\b|\bapi key\b|\bsecret\b"
REQUESTS = [
    "fix the login bug in the python api", "do something with that stuff", "add unit tests for the Go parser and refactor it", "create a plan for the graph database migration in rust", "Explain embeddings and chunking for retrieval augmented search, with docs",
    "implement a new component in typescript; the failing build has a problem", "hello", "audit this", "review security of the auth token in java and document it", "optimize the c# service",
]


def add(name: str, function, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
    ORACLE[name] = sql


def _prompts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    request = F.element_at(F.array(*map(F.lit, REQUESTS)), (F.col("conv_id") % len(REQUESTS)).cast("int") + 1)
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.when(F.col("turn") == 0, request).otherwise(F.concat(request, F.lit(" "), F.coalesce("text", F.lit("")))).alias("text"))


PROMPTS = f"WITH prompts AS (SELECT conv_id * 1000 + turn AS prompt_id, {'[' + ', '.join(map(quoted, REQUESTS)) + ']'}[conv_id % {len(REQUESTS)} + 1] || CASE WHEN turn = 0 THEN '' ELSE ' ' || coalesce(text, '') END AS text FROM conversations WHERE role = 'user')"


LOW = "low"


def best_sql(signs: dict) -> str:
    each = [f"{{'score': {' + '.join(f'CASE WHEN {rlike(LOW, q)} THEN {w} ELSE 0 END' for q, w in patterns)}, 'at': -{i}, 'name': '{name}'}}" for i, (name, patterns) in enumerate(signs.items())]
    return f"list_reverse_sort(list_filter([{', '.join(each)}], lambda x: x.score > 0))"


FRAMEWORKS = listed({name: rlike(LOW, "(?i)" + "|".join(signs)) for name, signs in p.FRAMEWORKS.items()})
SHORT, UNKNOWN, NO_LANGUAGE = "words < 5", "task = 'unknown'", "language IS NULL"
_TENTHS = f"CASE WHEN {SHORT} THEN 3 ELSE 0 END + CASE WHEN {UNKNOWN} THEN 3 ELSE 0 END + CASE WHEN {NO_LANGUAGE} THEN 2 ELSE 0 END" + "".join(f" + CASE WHEN {rlike('low', chr(92) + 'b' + w + chr(92) + 'b')} THEN 1 ELSE 0 END" for w in p.VAGUE)
_ASKED = listed({"task": UNKNOWN, "details": SHORT} | {w: rlike("low", rf"\b{w}\b") for w in p.ASKED} | {"language": NO_LANGUAGE})


def entities_sql(source: str) -> str:
    """named_spans of the texts (prompt_id, text) of a table: what they name, with the numbers of SURVEY spelt out."""
    parts = " UNION ALL ".join(f"SELECT prompt_id, text, {i} AS sign, '{x.kind}' AS kind, {x.sure} AS base, unnest({spans_sql('low_plain', quoted(x.pattern))}) AS s FROM spelt" for i, x in enumerate(e.SIGNS))
    clue = "CASE sign " + " ".join(f"WHEN {i} THEN regexp_matches(near, {quoted(x.clues)})" for i, x in enumerate(e.SIGNS)) + " END"
    return f"""spelt AS (SELECT prompt_id, text, regexp_replace(text, {quoted(FOREIGN)}, '_', 'g') AS low_plain FROM {source}), spans_met AS ({parts}),
        spans_cut AS (SELECT prompt_id, text, sign, kind, base, s.start + CASE WHEN sign = 2 AND s.text[1] <> '/' THEN 1 ELSE 0 END AS start, s."end" AS stop, regexp_replace(CASE WHEN sign = 2 AND s.text[1] <> '/' THEN s.text[2:] ELSE s.text END, '\\s*\\(\\)?\\z', '') AS named FROM spans_met),
        spans_near AS (SELECT *, lower(string_split(named, '.')[-1]) AS last, substring(lower(text), greatest(start - 30, 0) + 1, stop + 30 - greatest(start - 30, 0)) AS near, substring(text, greatest(start - 50, 0) + 1, start - greatest(start - 50, 0)) AS head,
            kind = 'api_reference' AND string_split(named, '.')[1] IN ({', '.join(map(quoted, e.LIBRARIES))}) AS library FROM spans_cut),
        spans_real AS (SELECT *, least(100, least(100, base + CASE WHEN library THEN 20 ELSE 0 END) + CASE WHEN {clue} THEN 15 ELSE 0 END) AS sure FROM spans_near
            WHERE CASE kind WHEN 'file_path' THEN NOT regexp_matches(head, '://[^ ]*\\z') AND (NOT contains(named, '.') OR last = '' OR last IN ({', '.join(map(quoted, e.EXTENSIONS))})) WHEN 'function_name' THEN last NOT IN ({', '.join(map(quoted, e.NO_NAMES))}) ELSE true END),
        named_spans AS (SELECT prompt_id, kind, start::INT AS start, stop::INT AS stop, named, sure, library, trim(substring(text, greatest(start - 40, 0) + 1, stop + 40 - greatest(start - 40, 0)), ' ') AS context FROM spans_real a WHERE NOT EXISTS
            (FROM spans_real b WHERE b.prompt_id = a.prompt_id AND b.start <= a.start AND b.stop >= a.stop AND (b.stop - b.start > a.stop - a.start OR b.sign < a.sign)))"""


_WEIGHT = "CASE task " + " ".join(f"WHEN '{t}' THEN {s}" for t, s in p.TASK_SCORE.items()) + " ELSE 1 END"
add(
    "x01_classify_prompts", lambda s, d: p.classify(_prompts(s, d), SECURITY),
    PROMPTS + f""", {entities_sql('prompts')}, l AS (SELECT prompt_id, prompt_id IN (SELECT prompt_id FROM named_spans) AS names, regexp_replace(lower(text), {quoted(FOREIGN)}, '_', 'g') AS low, length(text) AS n, len(list_filter(string_split_regex(trim(text, ' '), '\\s+'), lambda x: x <> '')) AS words FROM prompts),
        c AS (SELECT *, {best_sql(p.TASKS)} AS tasks, {best_sql(p.LANGUAGES)}[1].name AS language FROM l),
        t AS (SELECT *, coalesce(tasks[1].name, 'unknown') AS task, list_transform(list_filter(tasks[2:], lambda x: x.score >= 4), lambda x: x.name) AS others, {rlike('low', SECURITY)} AS security, {rlike('low', p.RAG + '|' + p.RAG_FRAMEWORKS)} AS rag, {rlike('low', p.GRAPH + '|' + p.GRAPH_FRAMEWORKS)} AS graph FROM c),
        u AS (SELECT *, least({_TENTHS}, 10) / 10.0::DOUBLE AS ambiguity FROM t), v AS (SELECT *, CASE WHEN ambiguity >= 0.6::DOUBLE THEN array_to_string({_ASKED}[1:4], ',') ELSE '' END AS questions,
            {_WEIGHT} + CASE WHEN len(others) > 0 THEN 1 ELSE 0 END + least(len({FRAMEWORKS}), 2) + names::INT + CASE WHEN n >= 200 THEN 1 ELSE 0 END + CASE WHEN n >= 500 THEN 1 ELSE 0 END AS weight FROM u)
        SELECT prompt_id, task, array_to_string(others, ',') AS others, language, array_to_string({FRAMEWORKS}, ',') AS frameworks, security, rag, graph, round(ambiguity, 9) AS ambiguity, questions,
            ['micro', 'light', 'standard', 'thorough'][greatest(CASE WHEN weight <= 1 THEN 0 WHEN weight = 2 THEN 1 WHEN weight <= 5 THEN 2 ELSE 3 END, CASE WHEN security OR rag OR graph OR ambiguity >= 0.6::DOUBLE THEN 2 ELSE 0 END, CASE WHEN task = 'planning' THEN 3 ELSE 0 END) + 1] AS ceremony FROM v""",
)

add(
    "p21_ambiguity", lambda s, d: p.classify(_prompts(s, d), SECURITY).select("prompt_id", "ambiguity"),
    PROMPTS + f""", l AS (SELECT prompt_id, regexp_replace(lower(text), {quoted(FOREIGN)}, '_', 'g') AS low, len(list_filter(string_split_regex(trim(text, ' '), '\\s+'), lambda x: x <> '')) AS words FROM prompts),
        t AS (SELECT *, len({best_sql(p.TASKS)}) = 0 AS unknown, len({best_sql(p.LANGUAGES)}) = 0 AS no_language FROM l)
        SELECT prompt_id, round(least(10, CASE WHEN words < 5 THEN 3 ELSE 0 END + CASE WHEN unknown THEN 3 ELSE 0 END + CASE WHEN no_language THEN 2 ELSE 0 END
            + len(list_filter(['something', 'stuff', 'thing', 'it', 'this', 'that', 'some'], lambda w: regexp_matches(low, '\\b' || w || '\\b')))) / 10.0::DOUBLE, 9) AS ambiguity FROM t""",
)

# -- semantic checks --------------------------------------------------------------------------------------------

FOUND = ", found AS (SELECT file_id, line, unnest(" + listed({name: rlike("text", f"(?i){q}") for name, (q, _) in p.CONCERNS.items()}) + ") AS concern FROM (SELECT file_id, line, regexp_replace(text, " + quoted(FOREIGN) + ", '_', 'g') AS text FROM lines)), checks AS (SELECT *, CASE WHEN concern IN (" + ", ".join(quoted(n) for n, (_, s) in p.CONCERNS.items() if s == "warning") + ") THEN 'warning' ELSE 'info' END AS severity FROM found)"


def _code_lines(spark, sf_dir):
    return lines(files(spark, sf_dir))


add("r08_semantic_checks", lambda s, d: p.semantic_checks(_code_lines(s, d)), LINES + FOUND + " SELECT * FROM checks")
add(
    "r09_violation_follow_ups", lambda s, d: p.follow_ups(scan.rule_scan(files(s, d))),
    VIOLATIONS + f" SELECT file_id, line, 'violation_deep_dive' AS concern, arg_min(severity, rule_id) AS severity FROM violations WHERE rule_id IN ({', '.join(map(quoted, p.FOLLOW_UPS))}) GROUP BY file_id, line",
)
_S, _D = ", ".join(map(quoted, p.SECURE)), ", ".join(map(quoted, p.DEEP))
add(
    "r10_analysis_protocol", lambda s, d: p.analysis_protocol(p.semantic_checks(_code_lines(s, d))),
    LINES + FOUND + f" SELECT file_id, CASE WHEN bool_or(concern IN ({_S})) AND bool_or(concern IN ({_D})) THEN 'comprehensive_analysis' WHEN bool_or(concern IN ({_D})) THEN 'deep_analysis' ELSE 'security_flow_analysis' END AS kind, count(*) AS areas FROM checks WHERE concern IN ({_S}, {_D}) GROUP BY 1",
)

# -- layers -----------------------------------------------------------------------------------------------------

LAYERS = [("tests", 1, "^src/tests/"), ("web", 2, "^src/(?:api|web|ui)/"), ("data", 3, "^src/(?:db|models)/"), ("base", 4, "^src/(?:core|util)/")]
RULES = [("web", "forbid", "data"), ("base", "allow", "base"), ("data", "allow", "base")]
LAYER = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{q}') THEN '{n}'" for n, _, q in LAYERS) + " END"


def _layers(spark):
    return spark.createDataFrame(LAYERS, "layer string, ord int, pattern string")


def _import_paths(spark, sf_dir):
    """What a file imports: the folder that its number names."""
    target = F.concat(F.lit("src/"), F.element_at(F.array(*map(F.lit, ("core", "db", "api", "tests", "other"))), (F.col("file_id") % 5).cast("int") + 1), F.lit("/x.py"))
    return files(spark, sf_dir).select("file_id", "path", target.alias("target"))


add("p13_resolve_layer", lambda s, d: files(s, d).select("file_id", "path", a.layer_of(F.col("path"), _layers(s)).alias("layer")), f"WITH {FILES_SQL} SELECT file_id, path, {LAYER.format('path')} AS layer FROM files")
add(
    "j07_layer_drift", lambda s, d: a.drift(_import_paths(s, d), _layers(s), s.createDataFrame(RULES, "layer string, kind string, target string")),
    f"""WITH {FILES_SQL}, i AS (SELECT file_id, path, 'src/' || ['core', 'db', 'api', 'tests', 'other'][file_id % 5 + 1] || '/x.py' AS t FROM files), l AS (SELECT file_id, {LAYER.format('path')} AS layer, {LAYER.format('t')} AS target FROM i)
        SELECT file_id, layer, target, 'forbidden' AS kind FROM l WHERE layer = 'web' AND target = 'data' UNION ALL SELECT file_id, layer, target, 'not allowed' FROM l WHERE layer <> target AND layer IN ('base', 'data') AND target <> 'base'""",
)
add(
    "a24_import_graph", lambda s, d: a.import_graph(files(s, d).withColumn("code", F.concat(F.lit("import os.path\nfrom pkg"), (F.col("file_id") % 7).cast("string"), F.lit(".x import y\n"), "code"))),
    f"WITH {FILES_SQL}, e AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder, unnest(['os', 'pkg' || (file_id % 7)]) AS module FROM files WHERE lang = 'python') SELECT folder, string_agg(module, ',' ORDER BY module) AS modules FROM e GROUP BY 1",
)

# -- knowledge --------------------------------------------------------------------------------------------------


def _knowledge(spark, sf_dir):
    v = cut(scan.rule_scan(f := files(spark, sf_dir)))
    return a.knowledge(quality.file_scores(f, v), v)


add(
    "a21_knowledge", _knowledge,
    SCORES + """, e AS (SELECT file_id, rule_id, count(*) AS n, bool_or(category = 'security') AS security FROM violations GROUP BY ALL),
        k AS (SELECT 'rule:' || rule_id AS key, 'recurring' AS kind, file_id FROM e WHERE n >= 3 UNION ALL SELECT 'security:' || rule_id, 'security', file_id FROM e WHERE security UNION ALL SELECT 'clean:' || lang, 'clean', file_id FROM scores WHERE score >= 0.95::DOUBLE)
        SELECT key, kind, count(DISTINCT file_id) AS files, min(file_id) AS first_id FROM k GROUP BY ALL""",
)


def _entries(spark, sf_dir):
    tag = lambda n: F.concat(F.lit("t"), (F.col("doc_id") % n).cast("string"))
    return table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("project"), F.array_distinct(F.array(tag(7), tag(11), F.concat(F.lit("own"), F.col("doc_id").cast("string")))).alias("tags"), F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("content"))


ENTRIES = "WITH x AS (SELECT coalesce(source, 'none') AS project, unnest(list_distinct(['t' || (doc_id % 7), 't' || (doc_id % 11), 'own' || doc_id])) AS tag, 'c' || (doc_id % 3) AS content FROM documents)"
add(
    "a17_workspace_patterns", lambda s, d: a.workspace_patterns(_entries(s, d)),
    ENTRIES + ", o AS (SELECT tag, count(DISTINCT project) AS projects, array_to_string(list_sort(list(DISTINCT project)), ',') AS names FROM x GROUP BY 1 HAVING count(DISTINCT project) >= 2), n AS (SELECT tag, content, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT tag, content FROM n QUALIFY row_number() OVER (PARTITION BY tag ORDER BY n DESC, content) = 1) SELECT tag, projects, content, round(least(1.0, projects / (SELECT count(*) FROM documents) + 0.3::DOUBLE), 9) AS confidence, names FROM o JOIN b USING (tag)",
)
add(
    "j16_missing_conventions", lambda s, d: a.missing_conventions(_entries(s, d), s.createDataFrame([("t3",), ("t10",), ("t99",)], "tag string")),
    ENTRIES + " SELECT DISTINCT project, w.tag FROM x, (VALUES ('t3'), ('t10'), ('t99')) AS w(tag) WHERE NOT EXISTS (FROM x y WHERE y.project = x.project AND y.tag = w.tag)",
)
TRIGGERS = [("caching", 1, "search", 2), ("data", 2, "database", 2), ("data", 2, "graph", 2), ("auth", 3, "auth", 1), ("auth", 3, "token", 1), ("auth", 3, "login", 1), ("testing", 4, "tests", 2), ("docs", 5, "document", 3), ("build", 6, "build", 1)]
add(
    "j13_guardrails", lambda s, d: a.guardrails(_prompts(s, d), s.createDataFrame(TRIGGERS, "domain string, ord int, trigger string, n_items int")),
    PROMPTS + f", t(domain, ord, trigger, n_items) AS (VALUES {', '.join(map(str, TRIGGERS))}), n AS (SELECT prompt_id, domain, count(*) AS hits, min(ord) AS ord, min(n_items) AS n_items FROM prompts JOIN t ON contains(lower(text), trigger) GROUP BY ALL), b AS (SELECT *, coalesce(sum(n_items) OVER (PARTITION BY prompt_id ORDER BY hits DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT prompt_id, domain, least(n_items, 3 - before)::INT AS items FROM b WHERE before < 3",
)


def _named(spark, sf_dir):
    text = F.concat("text", F.lit(" see ./src/app/f"), F.col("prompt_id").cast("string"), F.lit(".py, /etc/app.conf or ~/a.rs, call load_all() and os.path.join with the class Repo.find, not http://x.org/a/b.py; useState in react"))
    return _prompts(spark, sf_dir).withColumn("text", text)


add(
    "x02_entities", lambda s, d: e.entities(_named(s, d)),
    PROMPTS + f""", m AS (SELECT prompt_id, text || ' see ./src/app/f' || prompt_id || '.py, /etc/app.conf or ~/a.rs, call load_all() and os.path.join with the class Repo.find, not http://x.org/a/b.py; useState in react' AS text FROM prompts), {entities_sql('m')}
        SELECT prompt_id, kind, start, stop, named, round(sure / 100.0::DOUBLE, 9) AS confidence, library, context FROM named_spans""",
)
add(
    "p18_inferred_severity", lambda s, d: validations(s, d).select(F.explode("rules").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n")).withColumn("severity", inferred_severity(F.col("rule_id"))),
    f"WITH {VALIDATIONS_SQL} SELECT rule_id, count(*) AS n, CASE WHEN regexp_matches(rule_id, '^(?:SEC|PY001|PY002|PY003|PY004|PY007|PY008|PY009|PY010)') THEN 'error' ELSE 'warning' END AS severity FROM (SELECT unnest(rules) AS rule_id FROM validations) GROUP BY 1",
)
