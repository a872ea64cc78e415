"""Registered queries of advice, layered plans and text figures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.catalogue import RULES
from ..functions.text import collapsed, newlines, words
from ..operators import advice as a
from ..operators import checks as k
from ..operators import lines, planning, scan
from ..operators import prompts as p
from ..operators.quality import ITEMS
from ..sources.corpus import FILES_SQL, files, quoted
from ..sources.plans import LAYERED, plans, plans_sql
from ..sources.samples import SAMPLES
from ..sources.tables import VALIDATIONS_SQL, table, validations
from . import checks, prompts
from .history import rounded
from .planning import all_of, listed, rlike, split
from .scanning import VIOLATIONS

QUERIES, ORACLE = {}, {}


def add(name: str, function, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
    ORACLE[name] = sql


# -- findings ---------------------------------------------------------------------------------------------------


def _marked(spark, sf_dir):
    held = files(spark, sf_dir, SAMPLES)
    marked = k.marked(held)
    found = lambda rows, rule_id, category: rows.select("file_id", F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"), "line")
    every = found(k.placeholders(marked), "AI001", "ai_quality").unionByName(found(k.one_a_line(held, k.THEATRE), "AI007", "ai_quality"))
    every = every.unionByName(scan.rule_scan(held, checks.CALLS).select("file_id", "rule_id", "category", "line"))
    return a.mark_verifiable(every, a.confirmed_placeholders(marked, lines.functions(held)))


_CALLS = "CASE rule_id " + " ".join(f"WHEN '{r.id}' THEN '{r.category}'" for r in checks.CALLS) + " END"
add(
    "r16_mark_verifiable", _marked,
    checks.SQL + f""", g AS (SELECT *, coalesce(sum((NOT starts_with(ltrim(c, ' '), '@'))::INT) {checks.OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM real),
        a AS (SELECT *, bool_or({rlike('c', a.ABSTRACT)}) OVER (PARTITION BY file_id, g) AS abstract FROM g), d AS (SELECT file_id, line, c FROM a WHERE NOT abstract AND {rlike('c', k.DEF)}),
        sure AS (SELECT file_id, line FROM d WHERE {rlike('c', a.INLINE)} UNION SELECT b.file_id, max(l.line) FROM bodies b JOIN d ON d.file_id = b.file_id AND d.line = b.start
            JOIN py l ON l.file_id = b.file_id AND l.line > b.start AND l.line <= b.stop WHERE {rlike('b.body', a.STUB)} AND {rlike('l.c', a.STATEMENT)} GROUP BY b.file_id, b.start),
        v AS (SELECT file_id, 'AI001' AS rule_id, 'ai_quality' AS category, line FROM ({checks.ORACLE['l01_placeholders']}) UNION ALL SELECT file_id, 'AI007', 'ai_quality', line FROM ({checks.ORACLE['l06_security_theatre']})
            UNION ALL SELECT file_id, rule_id, {_CALLS}, line FROM ({checks.ORACLE['l14_call_checks']}))
        SELECT *, category <> 'ai_quality' OR rule_id = 'AI001' AND EXISTS (FROM sure s WHERE s.file_id = v.file_id AND s.line = v.line) AS verifiable FROM v""",
)

TEXTS = [
    ("rule", 1, "SEC002", "A password in source code stays in its history."), ("rule", 2, "SEC", "Attackers look for this first."), ("rule", 3, "PY", "Python offers a safer way."),
    ("rule", 4, "PY003", "A bare handler hides what went wrong."), ("rule", 5, "JS", "Strict code avoids this."), ("category", 1, "security", "Mend it before the code is deployed."),
    ("category", 2, "style", "It makes code harder to read."), ("severity", 1, "error", "Merge nothing before."), ("severity", 2, "warning", "Worth a change."),
]
CONVENTIONS = [(1, "no shell", "process", ["SEC-shell"]), (2, "secure by default", "security", ["safety"]), (3, "python style", "naming", ["pyfiles"])]


def _explained(spark, sf_dir):
    known = spark.createDataFrame(sorted({(r.id, r.category, r.severity) for r in RULES}), "rule_id string, category string, severity string")
    overridden = validations(spark, sf_dir).where("not passed").select(F.explode("rules").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))
    texts, conventions = spark.createDataFrame(TEXTS, "kind string, ord int, name string, text string"), spark.createDataFrame(CONVENTIONS, "ord int, name string, category string, tags array<string>")
    out = a.explain(scan.rule_scan(files(spark, sf_dir)), known, texts, overridden, conventions)
    return out.select("file_id", "rule_id", "line", "col", "explanation", "overrides")


add(
    "j10_explanations", _explained,
    VIOLATIONS + f""", {VALIDATIONS_SQL}, texts(kind, ord, name, text) AS (VALUES {', '.join(f"('{x}', {o}, {quoted(n)}, {quoted(t)})" for x, o, n, t in TEXTS)}),
        conventions(ord, name, category, tags) AS (VALUES {', '.join(f"({o}, '{n}', '{c}', {t})" for o, n, c, t in CONVENTIONS)}),
        n AS (SELECT rule_id, count(*) AS n FROM (SELECT unnest(rules) AS rule_id FROM validations WHERE NOT passed) GROUP BY 1), kinds AS (SELECT DISTINCT rule_id, category, severity FROM violations),
        e AS (SELECT rule_id, category, severity, coalesce(n, 0) AS overrides, (SELECT text FROM texts WHERE kind = 'rule' AND starts_with(rule_id, name) ORDER BY rule_id <> name, ord LIMIT 1) AS r,
            (SELECT text FROM texts WHERE kind = 'category' AND name = category) AS c, (SELECT text FROM texts WHERE kind = 'severity' AND name = severity) AS s,
            (SELECT name FROM conventions o WHERE o.category = kinds.category OR len(list_filter(tags, lambda t: contains(lower(t), lower(rule_id[:2])))) > 0 ORDER BY ord LIMIT 1) AS o FROM kinds LEFT JOIN n USING (rule_id)),
        w AS (SELECT *, concat_ws(' ', r, c, s, CASE WHEN overrides >= 5 THEN 'Overridden ' || overrides || ' times; its severity may be too high.' WHEN overrides > 0 THEN 'Overridden ' || overrides || ' times before.' END, 'See the convention ' || o || '.') AS said FROM e)
        SELECT file_id, rule_id, line, col, CASE WHEN said = '' THEN 'Violation ' || rule_id || ': ' || rule ELSE said END AS explanation, overrides FROM violations JOIN w USING (rule_id, category, severity)""",
)

# -- prompts ----------------------------------------------------------------------------------------------------

MENTIONS = [" in ./src/api/a.py and ./src/web/b.py, then ./src/db/models.py", " see ./src/core/x.py or ./src/tests/t.py", " for FastAPI and SQLAlchemy with python", " using React with next.js and typescript", ""]
FORBIDDEN = [("web", "forbid", "data"), ("web", "forbid", "base"), ("data", "forbid", "web"), ("base", "allow", "base")]
_MENTION = f"[{', '.join(map(quoted, MENTIONS))}][prompt_id % {len(MENTIONS)} + 1]"
MENTIONED = prompts.PROMPTS + f", m AS (SELECT prompt_id, text || {_MENTION} AS text FROM prompts)"


def _mentioning(spark, sf_dir):
    more = F.element_at(F.array(*map(F.lit, MENTIONS)), (F.col("prompt_id") % len(MENTIONS)).cast("int") + 1)
    return prompts._prompts(spark, sf_dir).withColumn("text", F.concat("text", more))


_FORBIDS = ", ".join(f"('{layer}', '{','.join(sorted(t for n, kind, t in FORBIDDEN if n == layer and kind == 'forbid'))}')" for layer in ("web", "data"))
add(
    "j08_layer_context", lambda s, d: a.layer_context(_mentioning(s, d), prompts._layers(s), s.createDataFrame(FORBIDDEN, "layer string, kind string, target string")),
    MENTIONED + f""", {prompts.entities_sql('m')}, e AS (SELECT prompt_id, start, regexp_replace(named, '^\\./', '') AS path FROM named_spans WHERE kind = 'file_path'),
        l AS (SELECT *, {prompts.LAYER.format('path')} AS layer FROM e), f(layer, forbidden) AS (VALUES {_FORBIDS})
        SELECT prompt_id, arg_min(path, start) AS path, layer, forbidden FROM l JOIN f USING (layer) GROUP BY prompt_id, layer, forbidden""",
)
_FRAMEWORKS = listed({name: rlike("low", "(?i)" + "|".join(signs)) for name, signs in p.FRAMEWORKS.items()})
add(
    "a22_stack_facts", lambda s, d: a.stack_facts(_mentioning(s, d)),
    MENTIONED + f""", l AS (SELECT prompt_id, regexp_replace(lower(text), {quoted(prompts.FOREIGN)}, '_', 'g') AS low FROM m), s AS (SELECT prompt_id, {prompts.best_sql(p.LANGUAGES)}[1].name AS language, {_FRAMEWORKS} AS f FROM l)
        SELECT 'stack:' || language || ':' || array_to_string(list_sort(f), ',') AS key, arg_min(language || ' with ' || array_to_string(f, ', '), prompt_id) AS content, min(prompt_id) AS first_id, count(*) AS prompts FROM s WHERE language IS NOT NULL AND len(f) > 0 GROUP BY 1""",
)
TOPICS = ["language:python", "language:typescript", "language:go", "framework:react", "framework:react-19", "framework:fastapi", "framework:next.js", "security:authentication", "security:input_validation", "rag", "graph", "testing", "architecture"]
STANDARDS = [(topic, n, f"{topic} {n}") for topic in TOPICS for n in range(1, 7)]
VERSIONS = [("react", "19.1.0"), ("fastapi", "0.110")]
LEVELS = {"security": "strict", "architecture": "permissive"}


def _standards(spark, sf_dir):
    standards, versions = spark.createDataFrame(STANDARDS, "topic string, ord int, text string"), spark.createDataFrame(VERSIONS, "framework string, version string")
    return a.standards_for(p.classify(_mentioning(spark, sf_dir), prompts.SECURITY), standards, versions, LEVELS)


add(
    "j11_standards", _standards,
    f"WITH prompts AS (SELECT * FROM ({prompts.ORACLE['x01_classify_prompts'].replace('FROM prompts),', 'FROM (SELECT prompt_id, text || ' + _MENTION + ' AS text FROM prompts)),', 2)}))" + f""",
        standards(topic, ord, text) AS (VALUES {', '.join(map(str, STANDARDS))}),
        t AS (SELECT prompt_id, 'language:' || language AS topic, {ITEMS['moderate']} AS cap FROM prompts WHERE language IS NOT NULL
            UNION ALL SELECT prompt_id, 'framework:' || f, {ITEMS['moderate']} FROM (SELECT prompt_id, unnest(string_split(frameworks, ',')) AS f FROM prompts) WHERE f <> ''
            UNION ALL SELECT prompt_id, unnest(['security:authentication', 'security:input_validation']), {ITEMS['strict']} FROM prompts WHERE security
            UNION ALL SELECT prompt_id, 'rag', {ITEMS['moderate']} FROM prompts WHERE rag UNION ALL SELECT prompt_id, 'graph', {ITEMS['moderate']} FROM prompts WHERE graph
            UNION ALL SELECT prompt_id, 'testing', {ITEMS['moderate']} FROM prompts WHERE task = 'test' UNION ALL SELECT prompt_id, 'architecture', {ITEMS['permissive']} FROM prompts)
        SELECT prompt_id, t.topic, ord, s.text FROM t JOIN standards s ON s.topic = CASE t.topic WHEN 'framework:react' THEN 'framework:react-19' ELSE t.topic END WHERE ord <= cap""",
)

# -- plans of three levels, figures of texts --------------------------------------------------------------------

_COUNTS = " + ".join(f"len({all_of('text', x, 0)})" for x in planning.VAGUE + planning.OPEN)
_SECTIONS = " + ".join(f"(NOT {rlike('text', x)})::INT" for x in planning.LAYER_SECTIONS.values())


def _gone(heading: str, fields: list[str]) -> str:
    return f"coalesce(list_sum(list_transform({split('text', heading)}[2:], lambda b: {' + '.join(f'(NOT {rlike(chr(98), x)})::INT' for x in fields)})), 0)"


add(
    "a27_layered_plan_scores", lambda s, d: planning.layered_plan_scores(plans(files(s, d), LAYERED)),
    f"""WITH {FILES_SQL}, {plans_sql(LAYERED)}, n AS (SELECT plan_id, {_COUNTS} AS v, {_SECTIONS} AS s, {_gone(planning.STORY, planning.STORY_FIELDS)} + {_gone(planning.SUBTASK, planning.SUBTASK_FIELDS)} AS f FROM plans),
        e AS (SELECT *, greatest(0, 1 - v * 0.1::DOUBLE) AS clarity, greatest(0, 1 - s * 0.25::DOUBLE) AS completeness, greatest(0, 1 - f * 0.05::DOUBLE) AS grounding, 1::DOUBLE AS atomicity FROM n),
        o AS (SELECT *, clarity * 0.25::DOUBLE + completeness * 0.25::DOUBLE + grounding * 0.3::DOUBLE + atomicity * 0.2::DOUBLE AS overall FROM e)
        SELECT plan_id, round(clarity, 9) AS clarity, round(completeness, 9) AS completeness, round(grounding, 9) AS grounding, atomicity, round(overall, 9) AS overall, v + s + f = 0 AND overall >= 0.95::DOUBLE AS ready FROM o""",
)
add(
    "x14_text_figures",
    lambda s, d: table(s, d, "documents").select("doc_id", words(F.col("text")).alias("words"), newlines(F.col("text")).alias("newlines"), F.md5(collapsed(F.col("text"))).alias("md5")),
    "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\f\\r]+')) AS words, length(text) - length(replace(text, chr(10), '')) AS newlines, md5(trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ')) AS md5 FROM documents",
)
