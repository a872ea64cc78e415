"""Registered queries of the checks on brackets of scripts, with their SQL."""

from __future__ import annotations

from ..functions import text
from ..operators import brackets
from ..sources.corpus import files, files_sql, quoted
from ..sources.samples import SCRIPTS
from .history import rounded
from .scanning import re2

QUERIES, ORACLE = {}, {}


def pattern(p: str) -> str:
    return quoted(p.replace("*+", "*"))


LEXER = re2(text.LEXERS["template"])
SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
#: The brackets of each file, paired: what the operators' windows do, over the same masked code.
PAIRED = f"""lexed AS (SELECT file_id, lang, regexp_matches(code, 'from [''"]react[''"]|require\\(''react''\\)') AS react, regexp_extract_all(code, {LEXER}) AS m, string_split_regex(code, {LEXER}) AS g FROM files WHERE lang IN ('typescript', 'javascript')),
    bare AS (SELECT file_id, lang, react, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(regexp_replace(m[i], '[^\\n]', ' ', 'g'), '')), '') || '(' AS code FROM lexed),
    cut AS (SELECT file_id, lang, react, regexp_extract_all(code, '[^{{}}()]*[{{}}()]') AS p FROM bare),
    part AS (SELECT file_id, lang, react, len(p) AS n, unnest(p) AS part, generate_subscripts(p, 1) AS seq FROM cut),
    event AS (SELECT file_id, lang, react, seq, CASE WHEN seq = n THEN '' ELSE part[-1:] END AS ch, part[:-2] AS gap FROM part),
    sided AS (SELECT *, CASE WHEN ch IN ('{{', '}}') THEN 'b' WHEN ch IN ('(', ')') THEN 'p' END AS kind, CASE WHEN ch IN ('{{', '(') THEN 1 WHEN ch IN ('}}', ')') THEN -1 ELSE 0 END AS step,
        1 + sum(length(gap) - length(replace(gap, chr(10), ''))) OVER (PARTITION BY file_id ORDER BY seq {SO_FAR}) AS line FROM event),
    deep AS (SELECT *, CASE WHEN kind IS NOT NULL THEN sum(step) OVER (PARTITION BY file_id, kind ORDER BY seq {SO_FAR}) + (step < 0)::INT END AS level,
        lead(ch) OVER w AS next_ch, lead(gap) OVER w AS next_gap, lead(seq) OVER w AS next_seq FROM sided WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
    paired AS (SELECT *, CASE WHEN step > 0 THEN lead(seq) OVER p END AS close_seq, CASE WHEN step > 0 THEN lead(line) OVER p END AS close_line, CASE WHEN step < 0 THEN lag(gap) OVER p END AS head
        FROM deep WINDOW p AS (PARTITION BY file_id, kind, level ORDER BY seq)),
    opening AS (SELECT o.*, c.next_ch AS c_ch, c.next_gap AS c_gap, c.next_seq AS c_seq, l.close_seq AS l_close, z.next_ch AS z_ch, z.next_gap AS z_gap, z.next_seq AS z_seq
        FROM paired o LEFT JOIN paired c ON c.file_id = o.file_id AND c.seq = o.close_seq LEFT JOIN paired l ON l.file_id = o.file_id AND l.seq = c.next_seq AND l.ch = '{{' LEFT JOIN paired z ON z.file_id = o.file_id AND z.seq = l.close_seq WHERE o.step > 0),
    behind AS (SELECT *, CASE WHEN c_ch = '{{' AND NOT regexp_matches(c_gap, '\\A\\s*:\\s*\\z') THEN c_seq WHEN c_ch = '{{' AND z_ch = '{{' THEN z_seq END AS body, CASE WHEN c_ch = '{{' AND NOT regexp_matches(c_gap, '\\A\\s*:\\s*\\z') THEN c_gap WHEN c_ch = '{{' AND z_ch = '{{' THEN z_gap END AS body_gap,
        regexp_extract(gap, {pattern(brackets.DECLARED)}, 1) AS declared, regexp_extract(gap, {pattern(brackets.ARROW)}, 1) AS arrow, regexp_extract(gap, {pattern(brackets.BARE_ARROW)}, 1) AS bare FROM opening),
    tailed AS (SELECT *, CASE WHEN ch = '(' AND declared <> '' THEN declared WHEN ch = '(' AND regexp_matches(body_gap, '=>\\s*\\z') THEN arrow WHEN ch = '{{' THEN bare ELSE '' END AS name,
        ltrim(CASE WHEN declared <> '' THEN regexp_extract(gap, {pattern(brackets.DECLARED)}, 0) WHEN ch = '(' THEN regexp_extract(gap, {pattern(brackets.ARROW)}, 0) ELSE regexp_extract(gap, {pattern(brackets.BARE_ARROW)}, 0) END, chr(10)) AS tail FROM behind),
    named AS (SELECT file_id, lang, name, ch = '(' AND declared <> '' AS is_declared, (line - (length(tail) - length(replace(tail, chr(10), ''))))::INT AS line, ch = '(' AND coalesce(regexp_matches(c_gap, '\\A\\s*:'), false) AS typed, CASE WHEN ch = '(' THEN body ELSE seq END AS seq, close_line AS ends FROM tailed WHERE name <> ''),
    ends AS (SELECT file_id, max(line) AS last FROM paired GROUP BY 1),
    functions AS (SELECT n.file_id, n.lang, n.name, n.is_declared AS declared, n.line, (CASE WHEN n.seq IS NULL THEN n.ends ELSE coalesce(b.close_line, last) END - n.line + 1)::INT AS length,
        coalesce((SELECT max(i.level) - b.level FROM paired i WHERE i.file_id = n.file_id AND i.ch = '{{' AND i.seq >= b.seq AND i.seq < coalesce(b.close_seq, 1000000000)), 0)::INT AS nesting, typed, n.seq
        FROM named n JOIN ends USING (file_id) LEFT JOIN paired b ON b.file_id = n.file_id AND b.seq = n.seq)"""


def add(name: str, function, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(function(files(spark, sf_dir, SCRIPTS)))
    ORACLE[name] = f"WITH {files_sql(SCRIPTS)}, {PAIRED}{sql}"


add("l18_script_functions", brackets.functions, " SELECT file_id, lang, name, declared, line, length, nesting, typed FROM functions")
STRUCTURE = """, r AS (SELECT file_id, line, name, unnest([CASE WHEN length > {longest} THEN 'TSARCH001' END, CASE WHEN declared AND nesting > {deepest} THEN 'TSARCH003' END, CASE WHEN declared AND lang = 'typescript' AND NOT typed AND NOT starts_with(name, '_') THEN 'TSARCH004' END]) AS rule_id FROM functions)"""
LONG = "len(list_filter(string_split(code, chr(10)), lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(x, '^\\s*(?://|/\\*|\\*)')))"
add(
    "l18_script_structure", lambda f: brackets.structure(f, longest=8, deepest=2, most_lines=20),
    STRUCTURE.format(longest=8, deepest=2) + f" SELECT file_id, rule_id, line, name FROM r WHERE rule_id IS NOT NULL UNION ALL SELECT file_id, 'TSARCH002', 1, NULL FROM files WHERE lang IN ('typescript', 'javascript') AND {LONG} > 20",
)
#: Hooks by containment: blocks that are open where a hook stands, counted by their borders.
HOOKS = """, prior AS (SELECT *, lag(ch) OVER w AS p_ch, lag(head) OVER w AS p_head FROM paired WHERE react WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
    asked AS (SELECT *, coalesce(p_ch = ')' AND regexp_matches(p_head, '\\b(?:if|for|while|switch)\\s*\\z'), false) AS asked FROM prior),
    blocks AS (SELECT file_id, seq, close_seq, true AS conditional FROM asked WHERE ch = '{' AND (regexp_matches(gap, '\\belse\\s*\\z') OR trim(gap, ' ' || chr(9) || chr(10) || chr(13)) = '' AND asked)
        UNION ALL SELECT f.file_id, f.seq, b.close_seq, false FROM functions f JOIN paired b ON b.file_id = f.file_id AND b.seq = f.seq),
    hooks AS (SELECT file_id, seq, asked, regexp_extract(gap, '\\b(use[A-Z]\\w*)\\s*(?:<[^>]*>)?\\s*\\z', 1) AS hook, (line - (length(regexp_extract(gap, '\\b(use[A-Z]\\w*)\\s*(?:<[^>]*>)?\\s*\\z', 0)) - length(replace(regexp_extract(gap, '\\b(use[A-Z]\\w*)\\s*(?:<[^>]*>)?\\s*\\z', 0), chr(10), ''))))::INT AS line FROM asked WHERE ch = '('),
    held AS (SELECT h.file_id, h.line, h.hook, h.asked, count(*) FILTER (conditional) AS conditions, count(*) FILTER (NOT conditional) AS functions FROM hooks h LEFT JOIN blocks b ON b.file_id = h.file_id AND b.seq < h.seq AND coalesce(b.close_seq, 1000000000) > h.seq WHERE hook <> '' GROUP BY h.file_id, h.seq, h.line, h.hook, h.asked),
    misplaced AS (SELECT file_id, line, hook, unnest([CASE WHEN conditions > 0 OR asked THEN 'REACT001' END, CASE WHEN functions > 1 THEN 'REACT002' END]) AS rule_id FROM held)"""
add("l19_misplaced_hooks", brackets.misplaced_hooks, HOOKS + " SELECT file_id, rule_id, line, hook FROM misplaced WHERE rule_id IS NOT NULL")
