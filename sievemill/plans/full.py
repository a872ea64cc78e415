"""The full scan and unused imports, with their SQL."""

from __future__ import annotations

from ..functions import text
from ..functions.catalogue import Rule
from ..operators import full
from ..operators import checks as k
from ..sources.corpus import files, quoted
from ..sources.samples import SAMPLES
from .brackets import HOOKS, PAIRED, STRUCTURE
from .checks import FILES, SQL
from .checks import ORACLE as CHECKS
from .history import rounded
from .planning import rlike
from .scanning import IS_TEST, re2, violations_sql

QUERIES, ORACLE = {}, {}


def add(name: str, function, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(function(files(spark, sf_dir, SAMPLES)))
    ORACLE[name] = sql


LEXER = re2(text.LEXERS["hash"])
PLAIN, SOURCE = quoted(r"^import\s+([\w., ]+)$"), quoted(r"^from\s+[\w.]+\s+import\s+([\w, ]+)$")
DEAD = f""", lexed AS (SELECT file_id, code, regexp_extract_all(code, {LEXER}) AS m, string_split_regex(code, {LEXER}) AS g FROM files WHERE lang = 'python'),
    bare AS (SELECT file_id, code, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(regexp_replace(m[i], '[^\n]', ' ', 'g'), '')), '') AS masked FROM lexed),
    code_lines AS (SELECT file_id, rtrim(unnest(string_split(masked, chr(10))), ' ') AS c FROM bare),
    used AS (SELECT file_id, unnest(regexp_extract_all(c, '([A-Za-z_]\\w*)', 1)) AS name FROM code_lines WHERE NOT regexp_matches(c, {PLAIN}) AND NOT regexp_matches(c, {SOURCE})
        UNION ALL SELECT file_id, unnest(regexp_extract_all(regexp_extract(code, '(?m)^__all__\\s*\\+?=\\s*[\\[(]([^\\])]*)[\\])]', 1), '([A-Za-z_]\\w*)', 1)) FROM bare),
    spoken AS (SELECT file_id, line, regexp_replace(text, '\\s*#.*$', '') AS c FROM py),
    parts AS (SELECT file_id, line, regexp_matches(c, {PLAIN}) AS plain, unnest(string_split(CASE WHEN regexp_matches(c, {PLAIN}) THEN regexp_extract(c, {PLAIN}, 1) ELSE regexp_extract(c, {SOURCE}, 1) END, ',')) AS n
        FROM spoken WHERE (regexp_matches(c, {PLAIN}) OR regexp_matches(c, {SOURCE})) AND NOT regexp_matches(c, '^from\\s+__future__')),
    imported AS (SELECT file_id, line, CASE WHEN regexp_matches(n, '\\sas\\s') THEN regexp_extract(n, '\\sas\\s+(\\w+)', 1) WHEN plain THEN split_part(trim(n, ' '), '.', 1) ELSE trim(n, ' ') END AS name FROM parts)
    SELECT * FROM imported i WHERE name <> '' AND NOT EXISTS (FROM used u WHERE u.file_id = i.file_id AND u.name = i.name)"""
add("l15_dead_imports", full.dead_imports, SQL + DEAD)

#: Parts of the full scan that have a query of their own: rule, query, line, and where the rule holds.
TESTED, IMPORTING = f"file_id IN (SELECT file_id FROM files WHERE {IS_TEST})", "file_id IN (SELECT file_id FROM files WHERE regexp_matches(code, {}))"
FASTAPI, REACT = IMPORTING.format("'from fastapi|import fastapi'"), IMPORTING.format("'from [''\"]react[''\"]|require\\(''react''\\)'")
PARTS = [
    ("AI001", "l01_placeholders", "line", ""), ("AI003", "l02_over_engineering", "line", ""), ("AI004", "l03_duplicate_blocks", "line", ""), ("AI005", "l04_mixed_handlers", "line", ""), ("AI006", "l05_heavy_imports", "line", ""),
    ("AI007", "l06_security_theatre", "line", ""), ("AI008", "l07_injection", "line", ""), ("PERF001", "l08_orm_query_in_loop", "hit", ""), ("PERF002", "l09_unbounded_growth", "hit", ""), ("PERF003", "l10_blocking_calls", "hit", ""),
    ("PERF004", "l11_unbounded_query", "line", ""), ("PERF005", "l12_costly_in_loop", "hit", ""), ("PY015", "l16_unreachable", "line", ""), ("ARCH003", "l17_untyped_functions", "line", ""), ("ARCH004", "l17_deep_functions", "start", ""),
    ("ARCH005", "l17_big_classes", "line", ""), ("REACT003", "l19_maps_without_key", "line", REACT), ("NEXT001", "l20_missing_use_client", "1", IMPORTING.format("'from [''\"]next'")), ("FAPI001", "l21_route_handlers", "line", f"kind = 'sync handler' AND {FASTAPI}"),
    ("FAPI002", "l21_route_handlers", "line", f"kind = 'no response model' AND {FASTAPI}"), ("DEEP001", "l23_swallowed_exceptions", "line", ""), ("DEEP004", "l23_raises_without_cause", "line", ""), ("TEST005", "l24_many_patches", "line", TESTED),
    ("TEST007", "l27_no_edge_cases", "1", TESTED),
]
KINDS = {"TEST001": "regexp_matches(body, '\\A(?:pass|\\.\\.\\.)?\\z')", "TEST002": "body = 'assert True'", "TEST009": "regexp_matches(body, '(?m)^(?:global|nonlocal)\\s')", "TEST010": "regexp_matches(body, 'pytest\\.raises\\s*\\(\\s*Exception\\s*\\)|assertRaises\\s*\\(\\s*Exception\\s*\\)')"}
KINDS["TEST003"] = f"NOT {KINDS['TEST001']} AND NOT {rlike('body', k.ASSERTION)}"
OWN = [
    f"SELECT DISTINCT file_id, 'PY014', line FROM ({SQL}{DEAD})", f"{SQL} SELECT file_id, 'ARCH001', start FROM bodies WHERE stop - start + 1 > 30", f"{SQL} SELECT file_id, 'ARCH002', 1 FROM py GROUP BY 1, 2, 3 HAVING count(*) FILTER (NOT blank AND NOT starts_with(ltrim(text, ' '), '#')) > 300",
    *[f"{SQL} SELECT file_id, '{rule}', start FROM bodies WHERE starts_with(name, 'test_') AND {where} AND {TESTED}" for rule, where in KINDS.items()],
    f"{SQL} SELECT file_id, 'TEST006', start FROM bodies WHERE starts_with(name, 'test_') AND body <> '' AND {TESTED} QUALIFY row_number() OVER (PARTITION BY file_id, body ORDER BY start) > 1",
    f"{SQL}, w AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY file_id ORDER BY line), '') AS prior FROM lines) SELECT file_id, 'TEST008', line FROM w WHERE lang = 'python' AND regexp_matches(text, '^\\s*assert\\b.*[^\\w.][0-9]{{2,}}') AND NOT contains(text, '#') AND NOT starts_with(ltrim(prior, ' '), '#') AND {TESTED}",
    f"{SQL}, w AS (SELECT *, bool_or(regexp_matches(text, '//.*SAFETY')) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS safe FROM lines) SELECT file_id, 'RS003', line FROM w WHERE lang = 'rust' AND regexp_matches(text, '\\bunsafe\\s*\\{{') AND NOT safe",
    f"WITH {FILES}, {PAIRED}{STRUCTURE.format(longest=30, deepest=4)} SELECT file_id, rule_id, line FROM r WHERE rule_id IS NOT NULL", f"WITH {FILES}, {PAIRED}{HOOKS} SELECT file_id, rule_id, line FROM misplaced WHERE rule_id IS NOT NULL",
    f"WITH {FILES} SELECT file_id, 'TSARCH002', 1 FROM files WHERE lang IN ('typescript', 'javascript') AND len(list_filter(string_split(code, chr(10)), lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(x, '^\\s*(?://|/\\*|\\*)'))) > 300",
]
CUSTOM = [Rule("OWN1", "", "open-bracket", r"\(\s*a\b", "info"), Rule("OWN2", "", "broken", "(?P<n>a)", "info")]
RULES = full.replaced_rules() + [CUSTOM[0]._replace(ignore_case=True)]
add(
    "r05_full_scan", lambda f: full.full_scan(f, CUSTOM),
    f"WITH {FILES}, {violations_sql(RULES)} SELECT file_id, rule_id, line FROM violations" + "".join(f" UNION ALL SELECT file_id, '{rule}', {column}::INT FROM ({CHECKS[name]})" + f" WHERE {where}" * bool(where) for rule, name, column, where in PARTS)
    + "".join(f" UNION ALL SELECT * FROM ({sql})" for sql in OWN),
)
