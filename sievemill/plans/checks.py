"""Registered queries of the checks that look around a line, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.catalogue import RULES
from ..functions.text import bound
from ..operators import checks as k
from ..operators import lines, scan
from ..sources.corpus import FILES_SQL, files, files_sql, quoted
from ..sources.samples import SAMPLES
from .history import rounded
from .lookaround import FUNCTIONS
from .planning import extract, listed, rlike
from .scanning import violations_sql

QUERIES, ORACLE = {}, {}
FILES = files_sql(SAMPLES)
OVER = "OVER (PARTITION BY file_id ORDER BY line"
SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SQL = FUNCTIONS.replace(FILES_SQL, FILES) + """,
    t AS (SELECT l.*, CASE WHEN regexp_matches(ltrim(text, ' '), '^(?:#|//)') THEN '' ELSE text END AS c FROM lines l),
    py AS (SELECT * FROM t WHERE lang = 'python'), real AS (SELECT * FROM py WHERE trim(c, ' ') <> ''), ts AS (SELECT * FROM t WHERE lang IN ('typescript', 'javascript'))
"""


def add(name: str, function, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(function(files(spark, sf_dir, SAMPLES)))
    ORACLE[name] = sql


def on_lines(name: str, function, sql: str) -> None:
    add(name, lambda f: function(k.marked(f)), SQL + sql)


def on_functions(name: str, function, sql: str) -> None:
    add(name, lambda f: function(lines.functions(f)), SQL + sql)


def by_pattern(name: str, rules: list) -> None:
    numbered = [r._replace(id=f"{i}") for i, r in enumerate(rules)]
    add(name, lambda f: k.one_a_line(f, rules), f"WITH {FILES}, {violations_sql(numbered)} SELECT file_id, line, arg_min(rule, rule_id::INT) AS kind FROM violations GROUP BY ALL")


def ahead(opener: str, hit: str, reach: int) -> str:
    return f", w AS (SELECT *, min(CASE WHEN {rlike('c', hit)} THEN line END) {OVER} ROWS BETWEEN CURRENT ROW AND {reach - 1} FOLLOWING) AS hit FROM t) SELECT file_id, line, hit FROM w WHERE {rlike('c', opener)} AND hit IS NOT NULL"


by_pattern("l06_security_theatre", k.THEATRE)
by_pattern("l07_injection", k.INJECTION)
by_pattern("l11_unbounded_query", k.UNBOUNDED)
CALLS = [r for r in RULES if r.id in ("PY001", "PY002", "PY003", "PY004")]
add("l14_call_checks", lambda f: scan.rule_scan(f, CALLS).select("file_id", "rule_id", "line", "col"), f"WITH {FILES}, {violations_sql(CALLS)} SELECT file_id, rule_id, line, col FROM violations")
_FIRST = ", ".join(f"min(CASE WHEN {rlike('c', h)} THEN line END) {OVER} ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)" for h in k.ORM)
on_lines("l08_orm_query_in_loop", lambda t: k.first_listed(t, k.LOOP, k.ORM, 20), f", w AS (SELECT *, coalesce({_FIRST}) AS hit FROM t) SELECT file_id, line, hit FROM w WHERE {rlike('c', k.LOOP)} AND hit IS NOT NULL")
on_lines("l10_blocking_calls", lambda t: k.ahead(t, k.ASYNC, k.BLOCKING, 50), ahead(k.ASYNC, k.BLOCKING, 50))
on_lines("l12_costly_in_loop", lambda t: k.ahead(t, k.COSTLY_LOOP, k.COSTLY, 20), ahead(k.COSTLY_LOOP, k.COSTLY, 20))
on_lines(
    "l09_unbounded_growth", k.unbounded_growth,
    f", w AS (SELECT *, min(CASE WHEN {rlike('c', k.GROWTH)} THEN line END) {OVER} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS hit, bool_or({rlike('c', k.LIMIT)}) {OVER} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS held FROM t) SELECT file_id, line, hit FROM w WHERE {rlike('c', k.ENDLESS)} AND hit IS NOT NULL AND NOT held",
)
on_lines(
    "l01_placeholders", k.placeholders,
    f""", g AS (SELECT *, coalesce(sum({rlike('c', k.DEF)}::INT) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, concat_ws(chr(10), lag(text) {OVER}), text, lead(text) {OVER})) AS near FROM py),
        a AS (SELECT *, {rlike('c', k.DEF)} AND bool_or(contains(c, '@abstractmethod')) OVER (PARTITION BY file_id, g) AS abstract FROM g),
        f AS (SELECT *, last_value(CASE WHEN abstract THEN line END IGNORE NULLS) {OVER} {SO_FAR} AS from_, last_value(CASE WHEN abstract THEN indent END IGNORE NULLS) {OVER} {SO_FAR} AS depth FROM a),
        o AS (SELECT *, bool_or(line > from_ AND NOT blank AND indent <= depth) OVER (PARTITION BY file_id, from_ ORDER BY line {SO_FAR} AS gone,
            CASE WHEN {rlike('c', 'raise' + chr(92) + 's+NotImplementedError' + chr(92) + 'b')} THEN 'raise' WHEN regexp_matches(text, '^\\s*pass\\s*(?:#.*)?$') AND {rlike('near', k.TODO)} THEN 'pass' WHEN {rlike('text', k.ELLIPSIS)} THEN 'ellipsis' END AS kind FROM f)
        SELECT file_id, line, kind FROM o WHERE kind IS NOT NULL AND (from_ IS NULL OR gone OR line = from_)""",
)
add(
    "l02_over_engineering", lambda f: k.over_engineering(k.marked(f), lines.functions(f)),
    SQL + f""", classes AS (SELECT file_id, line, {extract('c', k.CLASS, 1)} AS name, {extract('c', k.CLASS, 2)} AS bases FROM py WHERE {rlike('c', k.CLASS)}),
        heirs AS (SELECT file_id, unnest(list_distinct(regexp_extract_all(bases, '(\\w+)', 1))) AS name FROM classes), made AS (SELECT file_id, start, regexp_extract_all(body, 'return\\s+(\\w+)\\s*\\(', 1) AS r FROM bodies WHERE regexp_matches(name, '^(?:create_|make_|build_|get_)'))
        SELECT a.file_id, line, 'one subclass' AS kind FROM classes a JOIN heirs h ON h.file_id = a.file_id AND h.name = a.name WHERE regexp_matches(bases, '\\bABC\\b') GROUP BY ALL HAVING count(*) = 1
        UNION ALL SELECT file_id, line, 'type parameters' FROM classes WHERE len(string_split(regexp_extract(bases, '\\[([^\\]]+)\\]', 1), ',')) > 5
        UNION ALL SELECT file_id, start, 'factory' FROM made WHERE len(r) >= 2 AND len(list_distinct(r)) = 1""",
)
add(
    "l03_duplicate_blocks", lambda f: f.select("file_id", F.explode(bound(F.split("code", "\n"), lines.repeated_blocks)).alias("line")),
    SQL + f""", lines_ AS (SELECT file_id, line, text, length(regexp_extract(text, '^[ \\t]*')) AS indent, NOT regexp_matches(text, '\\S') AS blank FROM lines), o AS (SELECT file_id, line AS start, indent FROM lines_ WHERE {rlike('text', lines.ANY_FUNCTION)}),
        e AS (SELECT o.file_id, start, coalesce(min(l.line) FILTER (l.line > start AND NOT blank AND l.indent <= o.indent) - 1, max(l.line))::INT AS stop FROM o JOIN lines_ l USING (file_id) GROUP BY o.file_id, start, o.indent),
        x AS (SELECT * FROM e WHERE NOT EXISTS (FROM e p WHERE p.file_id = e.file_id AND p.start < e.start AND p.stop >= e.start) AND stop - start > 5),
        b AS (SELECT x.file_id, start, trim(regexp_replace(string_agg(regexp_replace(regexp_replace(text, '#.*$', ''), '//.*$', ''), chr(10) ORDER BY line), '\\s+', ' ', 'g'), ' ') AS body FROM x JOIN lines l ON l.file_id = x.file_id AND line > start AND line <= stop GROUP BY ALL)
        SELECT file_id, start AS line FROM b QUALIFY row_number() OVER (PARTITION BY file_id, body ORDER BY start) > 1""",
)
on_lines("l04_mixed_handlers", k.mixed_handlers, ", w AS (SELECT *, bool_or(regexp_matches(c, '^\\s*except\\s+\\w+')) OVER (PARTITION BY file_id) AS specific FROM py) SELECT file_id, line FROM w WHERE specific AND regexp_matches(c, '^\\s*except\\s*:')")
on_lines(
    "l05_heavy_imports", k.heavy_imports,
    " " + " UNION ALL ".join(
        f"SELECT file_id, min(line) FILTER (regexp_matches(c, '^(?:import\\s+{lib}|from\\s+{lib}\\s+import)\\b')) AS line, '{lib}' AS library FROM py GROUP BY 1 HAVING count(*) FILTER (regexp_matches(c, '^(?:import\\s+{lib}|from\\s+{lib}\\s+import)\\b')) > 0 AND sum(len(regexp_extract_all(c, '\\b{lib}\\b'))) <= 3 AND bool_or({rlike('c', p)})"
        for lib, p in k.HEAVY.items()
    ),
)
on_lines("l16_unreachable", k.unreachable, f", w AS (SELECT *, lag(c) {OVER}) AS prior, lag(indent) {OVER}) AS depth FROM real) SELECT file_id, line FROM w WHERE {rlike('prior', k.TERMINAL)} AND indent = depth AND NOT {rlike('c', k.CLAUSE)}")
on_lines(
    "l17_untyped_functions", k.untyped_functions,
    f", w AS (SELECT *, coalesce(lag(c) {OVER}), '') AS prior, {extract('c', k.DEF)} AS name FROM real) SELECT file_id, line, name FROM w WHERE {rlike('c', k.DEF)} AND NOT starts_with(name, '_') AND NOT contains(c, '->') AND NOT regexp_matches(prior, '^\\s*@(?:\\w+\\.)*(?:property|abstractmethod)\\b')",
)
add(
    "l17_deep_functions", lambda f: k.deep_functions(lines.functions(f)),
    SQL + f""", o AS (SELECT b.file_id, b.name, b.start, l.line, l.indent FROM bodies b JOIN lines l ON l.file_id = b.file_id AND l.line > b.start AND l.line <= b.stop WHERE {rlike('l.text', lines.NESTING)}),
        p AS (SELECT x.file_id, x.name, x.start, x.line, count(DISTINCT y.indent) AS depth FROM o x JOIN o y ON y.file_id = x.file_id AND y.start = x.start AND y.line <= x.line AND (y.line = x.line OR y.indent < x.indent)
            WHERE NOT EXISTS (FROM o z WHERE z.file_id = x.file_id AND z.start = x.start AND z.line > y.line AND z.line <= x.line AND z.indent <= y.indent AND y.line <> x.line) GROUP BY ALL)
        SELECT file_id, name, start, max(depth)::INT AS depth FROM p GROUP BY ALL HAVING max(depth) > 4""",
)
on_lines(
    "l17_big_classes", k.big_classes,
    f""", w AS (SELECT *, last_value(CASE WHEN regexp_matches(c, '^\\S') AND NOT blank THEN CASE WHEN regexp_matches(c, '^class\\s') THEN line ELSE 0 END END IGNORE NULLS) {OVER} {SO_FAR} AS owner FROM py),
        m AS (SELECT *, min(CASE WHEN line > owner AND NOT blank AND trim(c, ' ') <> '' THEN indent END) OVER (PARTITION BY file_id, owner) AS first_ FROM w WHERE owner > 0)
        SELECT file_id, owner AS line, count(*) FILTER ({rlike('c', k.DEF)} AND indent = first_) AS methods FROM m GROUP BY ALL HAVING count(*) FILTER ({rlike('c', k.DEF)} AND indent = first_) > 10""",
)
BRACES = "(length(c) - length(replace(c, '{', ''))) - (length(c) - length(replace(c, '}', '')))"
on_lines(
    "w12_brace_depth", lambda t: k.brace_depth(t.where("lang in ('typescript', 'javascript')")).select("file_id", "line", "before", "after"),
    f", w AS (SELECT *, {BRACES} AS d, sum({BRACES}) {OVER} {SO_FAR} AS after FROM ts) SELECT file_id, line, (after - d)::BIGINT AS before, after::BIGINT AS after FROM w",
)
on_lines("l18_deepest_braces", k.deepest_braces, f", w AS (SELECT *, sum({BRACES}) {OVER} {SO_FAR} AS after FROM ts) SELECT file_id, max(after)::BIGINT AS depth FROM w GROUP BY 1")
on_lines("l19_maps_without_key", k.maps_without_key, " SELECT file_id, line FROM ts WHERE contains(text, '.map(') AND contains(text, '<') AND NOT contains(text, 'key=')")
on_lines(
    "l20_missing_use_client", k.missing_use_client,
    f", w AS (SELECT *, bool_or({rlike('text', k.USE_CLIENT)}) OVER (PARTITION BY file_id) AS has FROM ts) SELECT file_id, array_to_string(list_sort(list(DISTINCT {extract('c', k.CLIENT_APIS, 0)}))[1:5], ', ') AS apis FROM w WHERE NOT has AND {rlike('c', k.CLIENT_APIS)} AND NOT regexp_matches(trim(c, ' '), '^(?:import |from |/\\*)') GROUP BY 1",
)
on_lines(
    "l21_route_handlers", k.route_handlers,
    f", w AS (SELECT *, lead(c) {OVER}) AS next FROM py) SELECT file_id, line, unnest({listed({'sync handler': 'regexp_matches(next, $$^[ ]*def[ ]+[a-z0-9_]+[ ]*[(]$$)', 'no response model': 'NOT regexp_matches(c, $$response_model *=$$)'})}) AS kind FROM w WHERE {rlike('c', k.ROUTE)}",
)
TS = "lang IN ('typescript', 'javascript')"
add(
    "l22_frameworks", k.frameworks,
    f"WITH {FILES} SELECT file_id, unnest(" + listed({"react": TS + " AND regexp_matches(code, $$from ['\"]react['\"]|require[(]'react'[)]$$)", "next.js": TS + " AND regexp_matches(code, $$from ['\"]next$$)", "fastapi": "lang = 'python' AND regexp_matches(code, 'from fastapi|import fastapi')"}) + ") AS framework FROM files",
)
on_lines(
    "l23_swallowed_exceptions", k.swallowed_exceptions,
    f", w AS (SELECT *, lead(c) {OVER}) AS one, lead(indent) {OVER}) AS deep, lead(indent, 2) {OVER}) AS two FROM real) SELECT file_id, line FROM w WHERE regexp_matches(c, '^\\s*except\\b.*:\\s*$') AND regexp_matches(one, '^\\s*(?:pass|\\.\\.\\.|return(?:\\s+None)?)\\s*(?:#.*)?$') AND deep > indent AND (two IS NULL OR two < deep)",
)
on_lines(
    "l23_raises_without_cause", k.raises_without_cause,
    f""", w AS (SELECT *, last_value(CASE WHEN regexp_matches(c, '^\\s*except\\b.*:\\s*$') THEN line END IGNORE NULLS) {OVER} {SO_FAR} AS from_, last_value(CASE WHEN regexp_matches(c, '^\\s*except\\b.*:\\s*$') THEN indent END IGNORE NULLS) {OVER} {SO_FAR} AS depth FROM real),
        o AS (SELECT *, bool_or(line > from_ AND indent <= depth) OVER (PARTITION BY file_id, from_ ORDER BY line {SO_FAR} AS gone FROM w) SELECT file_id, line FROM o WHERE from_ IS NOT NULL AND NOT gone AND regexp_matches(c, '^\\s*raise\\s+\\w+') AND NOT regexp_matches(c, '\\sfrom\\s')""",
)
EMPTY = "regexp_matches(body, '\\A(?:pass|\\.\\.\\.)?\\z')"
on_functions(
    "l24_weak_tests", k.weak_tests,
    " SELECT file_id, name, unnest(" + listed({"empty": EMPTY, "assert true": "body = 'assert True'", "no assertion": f"NOT {EMPTY} AND NOT {rlike('body', k.ASSERTION)}", "any exception": "regexp_matches(body, 'pytest\\.raises\\s*\\(\\s*Exception\\s*\\)|assertRaises\\s*\\(\\s*Exception\\s*\\)')", "shared state": "regexp_matches(body, '(?m)^(?:global|nonlocal)\\s')"}) + ") AS kind FROM bodies WHERE starts_with(name, 'test_')",
)
on_lines(
    "l24_many_patches", k.many_patches,
    f", g AS (SELECT *, coalesce(sum((NOT starts_with(ltrim(c, ' '), '@'))::INT) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM real), n AS (SELECT *, count(*) FILTER (regexp_matches(c, '^\\s*@(?:\\w+\\.)*patch\\b')) OVER (PARTITION BY file_id, g) AS n FROM g) SELECT file_id, line, n FROM n WHERE regexp_matches(c, '^\\s*(?:async\\s+)?def\\s+test_') AND n >= 4",
)
on_functions("l27_no_edge_cases", k.no_edge_cases, f" SELECT file_id, count(*) AS tests FROM bodies WHERE starts_with(name, 'test_') GROUP BY 1 HAVING count(*) >= 3 AND NOT bool_or({rlike('lower(name)', '|'.join(k.EDGE_WORDS))})")
on_functions("l29_shared_state_in_tests", lambda f: k.weak_tests(f).where("kind = 'shared state'").select("file_id", "name"), " SELECT file_id, name FROM bodies WHERE starts_with(name, 'test_') AND regexp_matches(body, '(?m)^(?:global|nonlocal)\\s')")

add(
    "r15_tidy_suggestions", lambda f: k.tidy_suggestions(k.marked(f), lines.functions(f), long=12, deep=4, large=25),
    SQL + """, v AS (SELECT file_id, line, blank, CASE WHEN NOT blank AND trim(c, ' ') <> '' THEN indent // 4 END AS level FROM t),
        n AS (SELECT file_id, max(level) AS depth, arg_min(line, {'a': -level, 'b': line}) FILTER (level IS NOT NULL) AS line, count(*) FILTER (NOT blank) AS n FROM v GROUP BY 1),
        e AS (SELECT file_id, 'simplify_conditional' AS kind, line, 1 AS effort FROM n WHERE depth >= 4 UNION ALL SELECT file_id, 'extract_method', start, 2 FROM bodies WHERE stop - start + 1 > 12 UNION ALL SELECT file_id, 'split_file', 1, 3 FROM n WHERE n > 25)
        SELECT file_id, kind, line, (row_number() OVER w)::INT AS rank FROM e WINDOW w AS (PARTITION BY file_id ORDER BY effort, line) QUALIFY row_number() OVER w <= 3""",
)


def _pairs(f):
    """The tests of a group of files and what its other files define: a group is what a file's number leaves when divided by 40."""
    g = f.where("lang = 'python'").withColumn("group", F.col("file_id") % 40)
    tests = g.where("path like 'src/tests/%'").select("group", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("token"))
    names = lines.functions(g.where("path not like 'src/tests/%'")).select((F.col("file_id") % 40).alias("group"), "name")
    return k.untested_names(tests.distinct(), names)


add(
    "l25_untested_names", _pairs,
    SQL + """, w AS (SELECT DISTINCT file_id % 40 AS "group", unnest(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*)', 1)) AS token FROM files WHERE lang = 'python' AND path LIKE 'src/tests/%'),
        n AS (SELECT DISTINCT b.file_id % 40 AS "group", name AS token FROM bodies b JOIN files f USING (file_id) WHERE path NOT LIKE 'src/tests/%' AND NOT starts_with(name, '_'))
        SELECT DISTINCT "group" FROM w WHERE "group" IN (SELECT "group" FROM n) AND "group" NOT IN (SELECT w."group" FROM w JOIN n ON n."group" = w."group" AND n.token = w.token)""",
)
