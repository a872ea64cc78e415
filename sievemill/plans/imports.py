"""Registered queries of imports against declarations, with their SQL."""

from __future__ import annotations

from ..operators import imports
from ..sources import reports as made
from ..sources.corpus import files, files_sql, quoted
from ..sources.samples import IMPORT_SAMPLES
from ..sources.tables import table
from .scanning import spans_sql

QUERIES, ORACLE = {}, {}


def add(name: str, function, sql: str) -> None:
    QUERIES[name] = function
    ORACLE[name] = sql


def _unknown(spark, sf_dir):
    """Files that import, and what the manifests of their projects declare."""
    declared = imports.declared(made.manifest_files(table(spark, sf_dir, "documents")))
    return imports.unknown_imports(files(spark, sf_dir, IMPORT_SAMPLES), declared)


def _single(langs: str, pattern: str) -> str:
    return f"SELECT file_id, project, lang, code, s.start AS pos, regexp_extract(s.text, {quoted(pattern)}, 1) AS module FROM (SELECT *, unnest({spans_sql('code', quoted(pattern))}) AS s FROM files WHERE lang IN ({langs}))"


LINE = "length(substr(code, 1, pos)) - length(replace(substr(code, 1, pos), chr(10), '')) + 1"
SCRIPTS = "'typescript', 'javascript'"
#: What the five manifests declare is worked out from the numbers in them, without the operator's parser.
IMPORTS = f"""WITH {files_sql(IMPORT_SAMPLES)},
    single AS ({_single("'python'", r'(?m)^import\s+(\w+)')} UNION ALL {_single("'python'", r'(?m)^from\s+(\w+)')} UNION ALL {_single(SCRIPTS, r'''(?m)^[ \t]*import\s+[^\n]*?\s+from\s+['"]([^'"./][^'"]*?)['"]''')}
        UNION ALL {_single(SCRIPTS, r'''\brequire\s*\(\s*['"]([^'"./][^'"]*?)['"]''')} UNION ALL {_single("'go'", r'(?m)^[ \t]*import\s+"([^"]+)"')} UNION ALL {_single("'rust'", r'(?m)^[ \t]*use\s+(\w+)::')}),
    blocks AS (SELECT file_id, project, lang, code, s.start AS pos, string_split(s.text, chr(10)) AS rows FROM (SELECT *, unnest({spans_sql('code', quoted(r'import\s*\([^)]*\)'))}) AS s FROM files WHERE lang = 'go')),
    placed AS (SELECT file_id, project, lang, {LINE} AS line, module FROM single
        UNION ALL SELECT file_id, project, lang, {LINE} + generate_subscripts(rows, 1) - 1, regexp_extract(unnest(rows), '"([^"]+)"', 1) FROM blocks),
    said AS (SELECT DISTINCT file_id, project, lang, line::INT AS line, CASE WHEN lang NOT IN ({SCRIPTS}) THEN module WHEN starts_with(module, '@') THEN array_to_string(string_split(module, '/')[1:2], '/') ELSE string_split(module, '/')[1] END AS module FROM placed WHERE module <> ''),
    declared AS (SELECT source AS project, unnest(CASE doc_id % 6 WHEN 0 THEN ['pkg_' || (doc_id % 40) || '_core', 'flask'] WHEN 1 THEN ['fast_api', 'pkg_' || (doc_id % 40)] WHEN 2 THEN ['django', 'pkg_' || (doc_id % 40)]
        WHEN 3 THEN ['react', '@scope/pkg-' || (doc_id % 40), 'next'] WHEN 4 THEN ['github.com/a/pkg' || (doc_id % 40), 'golang.org/x/net'] END) AS package FROM documents)
"""
add(
    "j01_unknown_imports", _unknown,
    IMPORTS + f"""SELECT file_id, project, lang, line, module FROM said s WHERE project IN (SELECT project FROM declared WHERE package IS NOT NULL)
        AND NOT EXISTS (FROM declared d WHERE d.project = s.project AND (d.package = module OR lang = 'go' AND starts_with(module, d.package || '/'))) AND module NOT IN ({', '.join(map(quoted, imports.BROUGHT))})
        AND NOT CASE lang WHEN 'python' THEN module IN ({', '.join(map(quoted, imports.PYTHON))}) WHEN 'go' THEN NOT contains(string_split(module, '/')[1], '.') WHEN 'rust' THEN module IN ('std', 'crate') ELSE module IN ('fs', 'path') OR starts_with(module, 'node:') END""",
)
add("j01_imports", lambda spark, sf_dir: imports.imports(files(spark, sf_dir, IMPORT_SAMPLES)), IMPORTS + "SELECT file_id, project, lang, line, module FROM said")
