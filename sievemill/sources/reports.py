"""Lint reports and manifests as text in their real formats, made from the document table for tests and registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import quoted

TOOLS = ["ruff", "mypy", "eslint"]
CODES = ["E501", "S101", "F401", "W291", "E999"]
REPORTS = [
    '[{"code":"{code}","message":"m {id}","location":{"row":{line},"column":7}},{"code":"E902","message":"x"},{"message":"no code"}]',
    '{"file":"a.py","line":{line},"column":1,"severity":"note","message":"n {id}","code":"misc"}\nnot json\n\n{"file":"b.py","line":9,"message":"e"}\n',
    '[{"filePath":"a.js","messages":[{"ruleId":"no-var","severity":2,"message":"v {id}","line":{line},"column":2},{"ruleId":null,"severity":1,"message":"parse"}]},{"filePath":"b.js","messages":[]}]',
]
NAMES = ["requirements.txt", "pyproject.toml", "setup.cfg", "package.json", "go.mod", "README.md"]
MANIFESTS = [
    "# pinned\nPkg_{n}.Core>=1.{m} # why\n-r base.txt\nflask\nbad line here\n",
    "[project]\nname = \"x\"\ndependencies = [\n    \"Fast.API>={m}.5 ; python_version > '3'\",\n    'pkg-{n}[extra]~=2.{m}',\n]\n[tool.x]\nother = [\"y\"]\n",
    "[options]\ninstall_requires =\n    Django>={m}.1\n    pkg_{n}\n[options.extras]\nall =\n    none\n",
    '{"name":"p","dependencies":{"react":"^{m}.2.0","@scope/pkg-{n}":"latest"},"devDependencies":{"next":"~13.{m}"}}',
    "module x\n\nrequire (\n\tgithub.com/a/pkg{n} v1.{m}.0\n\tgolang.org/x/net v0.{m}.1 // indirect\n)\n",
    "no manifest {n} {m}",
]
LOCK = '{"packages":{"":{"version":"1"},"node_modules/react":{"version":"{m}.9.9"},"node_modules/@scope/pkg-{n}":{"version":""},"lib/y":{"version":"2"}}}'


def _pick(items: list[str], by: str = "doc_id"):
    return F.element_at(F.array(*map(F.lit, items)), (F.col(by) % len(items)).cast("int") + 1)


def _filled(text, **values):
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def reports(docs: DataFrame) -> DataFrame:
    """file_id, tool, raw: a report for each document; every eleventh isn't JSON."""
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("doc_id") % len(CODES)).cast("int") + 1)
    raw = F.when(F.col("doc_id") % 11 == 0, "oops").otherwise(_filled(_pick(REPORTS), id=F.col("doc_id"), line=F.col("doc_id") % 50 + 1, code=code))
    return docs.select(F.col("doc_id").alias("file_id"), _pick(TOOLS).alias("tool"), raw.alias("raw"))


def manifest_files(docs: DataFrame) -> DataFrame:
    """project, path, text."""
    text = _filled(_pick(MANIFESTS), n=F.col("doc_id") % 40, m=F.col("doc_id") % 4)
    return docs.select(F.col("source").alias("project"), F.concat(F.lit("d"), F.col("doc_id"), F.lit("/"), _pick(NAMES)).alias("path"), text.alias("text"))


def locks(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("source").alias("project"), _filled(F.lit(LOCK), n=F.col("doc_id") % 40, m=F.col("doc_id") % 4).alias("text"))


def listed(items: list[str]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def filled_sql(text: str, **values: str) -> str:
    for name, value in values.items():
        text = f"replace({text}, '{{{name}}}', ({value})::VARCHAR)"
    return text


REPORTS_SQL = (
    f"reports AS (SELECT doc_id AS file_id, {listed(TOOLS)}[doc_id % 3 + 1] AS tool, CASE WHEN doc_id % 11 = 0 THEN 'oops' ELSE "
    + filled_sql(f"{listed(REPORTS)}[doc_id % 3 + 1]", id="doc_id", line="doc_id % 50 + 1", code=f"{listed(CODES)}[doc_id % 5 + 1]") + " END AS raw FROM documents)"
)
MANIFESTS_SQL = (
    f"manifest_files AS (SELECT source AS project, 'd' || doc_id || '/' || {listed(NAMES)}[doc_id % 6 + 1] AS path, {listed(NAMES)}[doc_id % 6 + 1] AS name, "
    + filled_sql(f"{listed(MANIFESTS)}[doc_id % 6 + 1]", n="doc_id % 40", m="doc_id % 4") + " AS text FROM documents)"
)
