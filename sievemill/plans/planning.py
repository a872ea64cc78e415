"""Registered queries of plans, with their SQL."""

from __future__ import annotations

from ..operators import planning as p
from ..sources.corpus import FILES_SQL, files, quoted
from ..sources.plans import PLANS_SQL, plans
from .history import rounded

QUERIES, ORACLE = {}, {}


def rlike(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def extract(column: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({column}, {quoted(pattern)}, {group})"


def all_of(column: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({column}, {quoted(pattern)}, {group})"


def split(column: str, pattern: str) -> str:
    return f"string_split_regex({column}, {quoted(pattern)})"


def mask(column: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({column}, {quoted(pattern)}, {quoted(by)}, 'g')"


def listed(cases: dict[str, str]) -> str:
    """The names of the cases that hold, as a list."""
    return "list_filter([" + ", ".join(f"CASE WHEN {where} THEN {quoted(name)} END" for name, where in cases.items()) + "], lambda x: x IS NOT NULL)"


def rest(column: str, pattern: str) -> str:
    """What follows the first match."""
    marked = f"regexp_replace({column}, {quoted(pattern)}, chr(1))"
    return f"substring({marked}, strpos({marked}, chr(1)) + 1)"


PATH = mask(mask(mask(extract("body", p.FILE, 2), "^`+|`+$", ""), "^[\"']+|[\"']+$", ""), "[.,;:]+$", "")
NEW = f"{extract('body', p.FILE)} <> ''"
DETAILS = f"{split(extract('body', p.DETAILS), p.AFTER_DETAILS)}[1]"
SQL = f"""WITH RECURSIVE {FILES_SQL}, {PLANS_SQL},
    cuts AS (SELECT plan_id, {all_of('text', p.STEP)} AS numbers, {split('text', p.STEP)} AS parts FROM plans),
    steps AS (SELECT plan_id, i::INT AS pos, numbers[i] AS step, parts[i + 1] AS body FROM (SELECT *, unnest(range(1, len(numbers) + 1)) AS i FROM cuts)),
    named AS (SELECT plan_id, pos, step, {PATH} AS path, {NEW} AS new FROM steps WHERE {rlike('body', p.FILE)}),
    folders AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS folder FROM (SELECT parts, unnest(range(1, len(parts))) AS n FROM (SELECT string_split(path, '/') AS parts FROM files))),
    phantom AS (SELECT plan_id, pos, step, path FROM named WHERE NOT new AND contains(path, '/') AND contains(string_split(path, '/')[-1], '.') AND path NOT IN (SELECT path FROM files)
        UNION ALL SELECT plan_id, pos, step, path FROM named WHERE new AND contains(path, '/') AND regexp_replace(path, '/[^/]*$', '') NOT IN (SELECT folder FROM folders)),
    needs AS (SELECT plan_id, pos, step, unnest({all_of(f"trim({extract('body', p.DEPENDS)}, ' ')", '([0-9]+)')}) AS need FROM steps WHERE lower(trim({extract('body', p.DEPENDS)}, ' ')) NOT IN ({', '.join(map(quoted, p.NO_DEPENDS))})),
    dependency AS (SELECT * FROM needs n WHERE NOT EXISTS (FROM steps s WHERE s.plan_id = n.plan_id AND s.step = n.need)),
    held AS (SELECT n.plan_id, n.step, n.need FROM needs n JOIN (SELECT plan_id, step, max(pos) AS pos FROM steps GROUP BY ALL) USING (plan_id, step, pos)),
    reach AS (SELECT plan_id, step AS a, need AS b FROM held UNION SELECT r.plan_id, r.a, h.need FROM reach r JOIN held h ON h.plan_id = r.plan_id AND h.step = r.b),
    circle AS (SELECT r.plan_id, r.a AS step, min(r.b) AS first FROM reach r JOIN reach o ON o.plan_id = r.plan_id AND o.a = r.b AND o.b = r.a GROUP BY ALL),
    depends AS (SELECT plan_id, step, need FROM dependency UNION ALL SELECT DISTINCT plan_id, first, '(cycle)' FROM circle),
    vague AS (SELECT plan_id, pos, step, unnest({listed({n: rlike('body', x) for n, x in p.CROSS_REFERENCES.items()})}) AS phrase FROM steps),
    fields AS (SELECT plan_id, pos, step, unnest({listed({f: f"NOT {rlike('body', f'(?i)[*][*]{f}:[*][*]')}" for f in p.FIELDS})}) AS field FROM steps),
    edits AS (SELECT *, {all_of('body', p.ANCHOR)} AS a, {all_of('body', p.REPLACE)} AS r FROM steps WHERE {rlike('body', p.EDIT)} AND NOT {rlike('body', p.CAPABLE)}),
    anchors AS (SELECT plan_id, pos, step, CASE WHEN len(a) <> 1 OR len(r) <> 1 THEN 'blocks' ELSE 'empty' END AS issue FROM edits WHERE len(a) <> 1 OR len(r) <> 1 OR NOT regexp_matches(a[1], '\\S')),
    asked AS (SELECT plan_id, pos, step, {PATH} AS path, {mask('a[1]', chr(92) + 'A' + chr(92) + 'n+|' + chr(92) + 'n+' + chr(92) + 'z', '')} AS anchor FROM edits WHERE len(a) = 1 AND {rlike('body', p.FILE)} AND NOT ({NEW})),
    uniqueness AS (SELECT plan_id, pos, step, path, ((length(code) - length(replace(code, anchor, ''))) // length(anchor))::INT AS n FROM asked JOIN files USING (path)
        WHERE regexp_matches(anchor, '\\S') AND (length(code) - length(replace(code, anchor, ''))) // length(anchor) <> 1),
    atomicity AS (SELECT plan_id, pos, step, unnest({listed({'files': f"len({all_of('body', '[*][*]File:[*][*]', 0)}) > 1", 'action': rlike('body', p.CONJUNCTION), 'details': rlike(mask(DETAILS, p.FENCE), p.COMPOUND_DETAILS)})}) AS issue
        FROM steps WHERE NOT {rlike('body', p.CAPABLE)}),
    segments AS (SELECT plan_id, {split(rest('text', p.DECISIONS), p.HEADING)}[1] AS part FROM plans WHERE {rlike('text', p.DECISIONS)} UNION ALL SELECT plan_id, {DETAILS} FROM steps),
    masked AS (SELECT plan_id, {mask(mask(mask('part', p.MASKED[0]), p.MASKED[1]), p.MASKED[2])} AS part FROM segments),
    unresolved AS (SELECT DISTINCT plan_id, unnest({listed({n: rlike(mask('part', p.NEGATION + f'(?:{x})'), x) for n, x in p.MARKERS.items()})}) AS marker FROM masked)
"""


def add(name: str, function, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(function(files(spark, sf_dir)))
    ORACLE[name] = SQL + sql


def on_steps(name: str, function, sql: str) -> None:
    add(name, lambda f: function(p.plan_steps(plans(f))), sql)


on_steps("x03_plan_steps", lambda s: s, "SELECT plan_id, pos, step, body FROM steps")
VERSION = f"coalesce(try_cast({extract(extract('text', p.FRONT), p.VERSION)} AS INT), 1)"
add("x04_format_version", lambda f: _versions(f), f"SELECT plan_id, {VERSION} AS version FROM plans")
on_steps("x05_vague_references", p.vague_references, "SELECT * FROM vague")
on_steps("x06_missing_fields", p.missing_fields, "SELECT * FROM fields")
add("x06_missing_sections", lambda f: p.missing_sections(plans(f)), f"SELECT plan_id, unnest({listed({n: 'NOT ' + rlike('text', x) for n, x in p.SECTIONS.items()})}) AS section FROM plans")
add(
    "x07_design_gaps", lambda f: p.design_gaps(plans(f)),
    f""", said AS (SELECT plan_id, array_to_string(parts[2:], chr(10)) AS steps, unnest(string_split({split(rest('text', p.DESIGN), p.NEXT_SECTION)}[1], chr(10))) AS line FROM plans JOIN cuts USING (plan_id) WHERE {rlike('text', p.DESIGN)}),
        tagged AS (SELECT *, {extract('line', p.TAG)} AS tag, {extract('line', p.SYMBOL)} AS symbol FROM said WHERE {rlike('line', p.TAG)})
        SELECT plan_id, CASE tag WHEN 'NEW' THEN symbol ELSE substring(trim(line, ' '), 1, 80) END AS interface, tag FROM tagged
        WHERE tag = 'EXISTING' AND NOT {rlike('line', p.CITATION)} OR tag = 'NEW' AND symbol <> '' AND NOT contains(steps, symbol)""",
)
on_steps("x08_edit_anchors", p.edit_anchors, "SELECT * FROM anchors")
on_steps("x09_atomicity", p.atomicity, "SELECT * FROM atomicity")
add("x10_unresolved_decisions", lambda f: p.unresolved_decisions(plans(f), p.plan_steps(plans(f))), "SELECT * FROM unresolved")
add("j17_phantom_files", lambda f: p.phantom_files(p.plan_steps(plans(f)), f), "SELECT * FROM phantom")
add("j18_anchor_uniqueness", lambda f: p.anchor_uniqueness(p.plan_steps(plans(f)), f), "SELECT * FROM uniqueness")
on_steps("x11_cycles_of_plans", p.plan_cycles, "SELECT * FROM circle")
on_steps("j19_dangling_references", p.dangling_references, "SELECT * FROM dependency")
_COUNTS = " + ".join(f"len({all_of('text', x, 0)})" for x in p.VAGUE + p.OPEN)
_SECTIONS = " + ".join(f"(NOT {rlike('text', x)})::INT" for x in p.SECTIONS.values())
_COMPOUND = " + ".join(f"{rlike('text', x)}::INT" for x in p.COMPOUND)
add(
    "a26_plan_scores", lambda f: p.plan_scores(plans(f)),
    f""", n AS (SELECT plan_id, {_COUNTS} AS v, {_SECTIONS} AS s, coalesce(f, 0) + {_COMPOUND} AS t, {_COMPOUND} AS c FROM plans LEFT JOIN (SELECT plan_id, count(*) AS f FROM fields GROUP BY 1) USING (plan_id)),
        e AS (SELECT *, greatest(0, 1 - v * 0.1::DOUBLE) AS clarity, greatest(0, 1 - s * 0.25::DOUBLE) AS completeness, greatest(0, 1 - t * 0.1::DOUBLE) AS grounding, greatest(0, 1 - c * 0.2::DOUBLE) AS atomicity FROM n),
        o AS (SELECT *, clarity * 0.25::DOUBLE + completeness * 0.25::DOUBLE + grounding * 0.3::DOUBLE + atomicity * 0.2::DOUBLE AS overall FROM e)
        SELECT plan_id, round(clarity, 9) AS clarity, round(completeness, 9) AS completeness, round(grounding, 9) AS grounding, round(atomicity, 9) AS atomicity, round(overall, 9) AS overall, v + s + t = 0 AND overall >= 0.95::DOUBLE AS ready FROM o""",
)
_KINDS = {k: k for k in p.PENALTIES} | {"grounding": "(SELECT * FROM fields WHERE field = 'Grounding')", "dependency": "depends"}
_LOST = " + ".join(f"CASE WHEN version >= 2 OR {k in p.SOFT} THEN {k} ELSE 0 END * {x}::DOUBLE" for k, x in p.PENALTIES.items())
_HELD = " + ".join(f"CASE WHEN version >= 2 OR {k in p.SOFT} THEN {k} ELSE 0 END" for k in p.PENALTIES)
add(
    "a28_plan_verify", lambda f: p.verify(plans(f), f),
    ", kinds AS (" + " UNION ALL ".join(f"SELECT plan_id, '{k}' AS kind FROM {t}" for k, t in _KINDS.items()) + "), counts AS (SELECT plan_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in _KINDS) + " FROM kinds GROUP BY 1),"
    + f" v AS (SELECT plan_id, {VERSION} AS version, " + ", ".join(f"coalesce({k}, 0) AS {k}" for k in _KINDS) + f" FROM plans LEFT JOIN counts USING (plan_id)) SELECT *, round(greatest(0, 1 - ({_LOST})), 9) AS coverage, {_HELD} = 0 AS verified FROM v",
)


def _versions(f):
    table = plans(f)
    return table.select("plan_id", p.format_version(table["text"]).alias("version"))
