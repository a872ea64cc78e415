"""What comes in as text: lint reports, diffs, manifests, locks, advisories. And what goes out: SARIF and JSON for each file, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_package
from . import lines, scan
from .scan import RULE_ROWS

#: Package ecosystems by the manifest's name, and frameworks by package.
ECOSYSTEMS = {
    "pyproject.toml": "PyPI", "requirements.txt": "PyPI", "setup.cfg": "PyPI", "package.json": "npm", "Cargo.toml": "crates.io", "go.mod": "Go", "pom.xml": "Maven",
}
FRAMEWORKS = {
    "fastapi": "fastapi", "django": "django", "flask": "flask", "sqlalchemy": "sqlalchemy", "langchain": "langchain", "langgraph": "langgraph", "chromadb": "chromadb",
    "pinecone-client": "pinecone", "faiss-cpu": "faiss", "neo4j": "neo4j", "weaviate-client": "weaviate", "pymilvus": "milvus", "qdrant-client": "qdrant",
    "anthropic": "anthropic-sdk", "openai": "openai-sdk", "llama-index": "llamaindex", "pyautogen": "autogen", "instructor": "instructor", "pydantic-ai": "pydantic-ai",
    "haystack-ai": "haystack", "opentelemetry-api": "opentelemetry", "react": "react", "next": "next.js", "vue": "vue", "express": "express", "@prisma/client": "prisma",
    "tailwindcss": "tailwind", "@tanstack/react-query": "tanstack-query", "zustand": "zustand", "graphql": "graphql", "@anthropic-ai/sdk": "anthropic-sdk", "ai": "vercel-ai",
    "axum": "axum",
}
#: How versions and requirements are written.
SPECIFIED, NPM_VERSION, GO_REQUIRE = r"[><=!~]+\s*([0-9][0-9.]*)", r"[\^~>=<]*\s*([0-9][0-9.]*)", r"^\s+(\S+)\s+v([0-9.]+)"
LEVELS = {"error": "error", "warning": "warning", "info": "note"}

_RUFF = "array<struct<code:string,message:string,location:struct<row:int,column:int>>>"
_MYPY = "struct<file:string,line:int,column:int,severity:string,message:string,code:string>"
_ESLINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int,column:int>>>>"


def lint_reports(reports: DataFrame) -> DataFrame:
    """Violations of the reports (file_id, tool, raw): ruff's array, mypy's lines, ESLint's files. What is no JSON has none.

    Narrow: each report is parsed in its row. ESLint's messages without a rule are parse errors."""
    rows = reports.select("file_id", "tool", "raw")
    out = lambda kind, rule, severity, message, line, col: F.struct(
        F.concat(F.lit(kind), rule[0]).alias("rule_id"), rule[1].alias("rule"), F.lit("style").alias("category"), severity.alias("severity"), message.alias("message"), line.alias("line"), col.alias("col")
    )
    ruff = rows.where("tool = 'ruff'").select("file_id", F.explode(F.from_json("raw", _RUFF)).alias("e"))
    code = F.coalesce("e.code", F.lit(""))
    ruff = ruff.select("file_id", out("RUFF-", (code, code), F.when(code.rlike("^(?:S|E9)"), "error").otherwise("warning"), F.coalesce("e.message", F.lit("")), F.col("e.location.row"), F.col("e.location.column")).alias("v"))
    mypy = rows.where("tool = 'mypy'").select("file_id", F.explode(F.split("raw", "\n")).alias("l")).select("file_id", F.from_json("l", _MYPY).alias("e")).where("coalesce(e.file, e.severity, e.message, e.code) is not null")
    severity = F.coalesce("e.severity", F.lit("error"))
    names = (F.coalesce("e.code", F.lit("E")), F.coalesce("e.code", F.lit("error")))
    mypy = mypy.select("file_id", out("MYPY-", names, F.when(severity == "note", "info").otherwise(severity), F.coalesce("e.message", F.lit("")), F.col("e.line"), F.col("e.column")).alias("v"))
    eslint = rows.where("tool = 'eslint'").select("file_id", F.explode(F.from_json("raw", _ESLINT)).alias("f")).select("file_id", F.explode("f.messages").alias("e"))
    names = (F.coalesce("e.ruleId", F.lit("unknown")), F.coalesce("e.ruleId", F.lit("parse-error")))
    eslint = eslint.select("file_id", out("ESLINT-", names, F.when(F.col("e.severity") == 2, "error").otherwise("warning"), F.coalesce("e.message", F.lit("")), F.col("e.line"), F.col("e.column")).alias("v"))
    return ruff.unionByName(mypy).unionByName(eslint).select("file_id", "v.*")


def diff_lines(diff: DataFrame) -> DataFrame:
    """diff_id, seq, kind (file, hunk, added, removed, kept, other) of unified diffs' lines."""
    t = F.col("text")
    kind = F.when(t.rlike(r"^(?:\+\+\+|---) "), "file").when(t.startswith("@@"), "hunk").when(t.startswith("+"), "added").when(t.startswith("-"), "removed").when(t.startswith(" "), "kept").otherwise("other")
    return diff.select("diff_id", "seq", kind.alias("kind"))


def diff_scan(violations: DataFrame, changed: DataFrame) -> DataFrame:
    """Violations on changed lines (file_id, line); those about whole files go."""
    return violations.where(~F.col("rule_id").isin("ARCH002", "TSARCH002")).join(changed.select("file_id", "line").distinct(), ["file_id", "line"], "left_semi")


#: Languages of files by the ends of their names.
SUFFIXES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "go": "go", "java": "java", "cs": "csharp"}


def added_texts(added: DataFrame) -> DataFrame:
    """file_id, lang, code of what diffs add to each file (diff_id, path, line, added), as a text of its own: file_id holds diff_id, path, and lines, the file's own numbers of the text's
    lines. The language is told by the name's end, else by the text."""
    each = added.groupBy("diff_id", "path").agg(F.array_sort(F.collect_list(F.struct("line", "added"))).alias("rows"))
    code = each.select(F.struct("diff_id", "path", F.transform("rows", lambda r: r["line"]).alias("lines")).alias("file_id"), F.array_join(F.transform("rows", lambda r: r["added"]), "\n").alias("code"))
    known = F.create_map(*[F.lit(v) for pair in SUFFIXES.items() for v in pair])
    suffix = F.lower(F.regexp_extract("file_id.path", r"\.(\w+)$", 1))
    return code.select("file_id", F.coalesce(F.try_element_at(known, suffix), scan.detect_language(F.col("code"))["best"]).alias("lang"), "code")


def scan_diff(diff: DataFrame, files: DataFrame, check=scan.rule_scan) -> DataFrame:
    """diff_id, path, rule_id, rule, severity, category, line, col, snippet of what unified diffs (diff_id, seq, text) add.

    Of a file that is there (file_id, path, lang, code; paths are unique), `check` sees the whole, and what it finds on added lines counts, but for findings about whole files. Of any other
    file it sees the added lines as one text, and its lines become the file's again; the numbers travel with the text, so no join is needed for that. A file's lines are one row, as its code is."""
    added = lines.changed_lines(diff).withColumn("path", F.regexp_replace("path", "^b/", ""))
    there = files.select("file_id", "path")
    changed = added.select("diff_id", "path", "line").distinct().join(there, "path")
    met = check(files.join(changed.select("file_id").distinct(), "file_id", "left_semi")).where(~F.col("rule_id").isin("ARCH002", "TSARCH002"))
    columns = ["rule_id", "rule", "severity", "category", "line", "col", "snippet"]
    whole = met.join(changed, ["file_id", "line"]).select("diff_id", "path", *columns)
    found = check(added_texts(added.join(there, "path", "left_anti")))
    parts = found.withColumn("line", F.get("file_id.lines", F.col("line") - 1)).select("file_id.diff_id", "file_id.path", *columns)
    return whole.unionByName(parts)


def manifests(files: DataFrame) -> DataFrame:
    """project, path, ecosystem, text of the files (project, path, text) that are manifests, told by their names."""
    name = F.element_at(F.split("path", "/"), -1)
    ecosystem = F.lit(None).cast("string")
    for manifest, kind in ECOSYSTEMS.items():
        ecosystem = F.when(name == manifest, kind).otherwise(ecosystem)
    return files.select("project", "path", ecosystem.alias("ecosystem"), "text").where("ecosystem is not null")


def dependencies(found: DataFrame) -> DataFrame:
    """project, ecosystem, package, version, dev of manifests: requirement lines, PEP 508 strings in a project's dependencies or below
    install_requires, package.json's two maps, go.mod's requires. No version: an empty one."""
    name = F.element_at(F.split("path", "/"), -1)
    out = lambda rows, package, version, dev: rows.select("project", "ecosystem", package.alias("package"), version.alias("version"), dev.alias("dev"))
    no = F.lit(False)

    def pep508(rows: DataFrame) -> DataFrame:
        said = rows.select("project", "ecosystem", F.trim(F.split_part("d", F.lit(";"), F.lit(1))).alias("d")).where(F.col("d").rlike("^[A-Za-z0-9]"))
        return out(said, normalize_package(F.regexp_extract("d", r"^([A-Za-z0-9][\w.-]*)", 1)), F.regexp_extract("d", SPECIFIED, 1), no)

    pinned = found.where(name == "requirements.txt").select("project", "ecosystem", F.explode(F.split("text", "\n")).alias("d")).select("project", "ecosystem", F.trim(F.split_part("d", F.lit("#"), F.lit(1))).alias("d"))
    pinned = pinned.where(F.col("d").rlike(r"^[A-Za-z0-9_][A-Za-z0-9._-]*\s*(?:[><=!~].*)?$"))
    required = out(pinned, normalize_package(F.regexp_extract("d", r"^([A-Za-z0-9_][A-Za-z0-9._-]*)", 1)), F.regexp_extract("d", r"[><=!~][^0-9]*([0-9][0-9.]*)", 1), no)
    block = F.regexp_extract("text", r"(?ms)^dependencies\s*=\s*\[(.*?)^?\]\s*$", 1)
    project = pep508(found.where(name == "pyproject.toml").select("project", "ecosystem", F.explode(F.transform(F.regexp_extract_all(block, F.lit("\"[^\"\\n]+\"|'[^'\\n]+'"), F.lit(0)), lambda q: F.btrim(q, F.lit("\"'")))).alias("d")))
    requires = F.regexp_extract("text", r"(?m)^install_requires =\n((?:[ \t]+\S.*\n?)*)", 1)
    setup = pep508(found.where(name == "setup.cfg").select("project", "ecosystem", F.explode(F.split(requires, "\n")).alias("d")))
    both = F.from_json("text", "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    npm = found.where(name == "package.json").select("project", "ecosystem", both.alias("j"))
    npm = npm.select("project", "ecosystem", F.explode("j.dependencies").alias("package", "v"), no.alias("dev")).unionByName(npm.select("project", "ecosystem", F.explode("j.devDependencies").alias("package", "v"), F.lit(True).alias("dev")))
    npm = out(npm, F.col("package"), F.regexp_extract("v", NPM_VERSION, 1), F.col("dev"))
    go = found.where(name == "go.mod").select("project", "ecosystem", F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").rlike(GO_REQUIRE))
    go = out(go, F.element_at(F.split(F.regexp_extract("l", GO_REQUIRE, 1), "/"), -1), F.regexp_extract("l", GO_REQUIRE, 2), no)
    return required.unionByName(project).unionByName(setup).unionByName(npm).unionByName(go)


def lock_versions(locks: DataFrame) -> DataFrame:
    """project, package, locked of package-lock files (project, text): the packages below node_modules that state a version."""
    each = locks.select("project", F.explode(F.from_json("text", "struct<packages:map<string,struct<version:string>>>").getField("packages")).alias("name", "info"))
    return each.where(F.startswith("name", F.lit("node_modules/")) & (F.col("info.version") != "")).select("project", F.expr("substring(name, 14)").alias("package"), F.col("info.version").alias("locked"))


def frameworks(found: DataFrame) -> DataFrame:
    """project, framework, version (of several the newest) of the dependencies that are one: a small table, which is sent to all."""
    known = found.sparkSession.createDataFrame(list(FRAMEWORKS.items()), "package string, framework string")
    return found.join(F.broadcast(known), "package").groupBy("project", "framework").agg(F.max_by("version", F.struct(version_order(F.col("version")), "version")).alias("version"))


def version_order(version: Column) -> Column:
    """What versions are in order by: their numbers."""
    return F.transform(F.regexp_extract_all(version, F.lit("([0-9]+)"), F.lit(1)), lambda n: n.try_cast("decimal(38,0)"))


def fixed_version(advisory: Column) -> Column:
    """The first fixed version that an advisory's JSON names in its affected ranges; empty if none."""
    parsed = F.from_json(advisory, "struct<affected:array<struct<ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>>")
    ranges = F.flatten(F.transform(parsed["affected"], lambda a: a["ranges"]))
    fixed = F.filter(F.transform(F.flatten(F.transform(ranges, lambda r: r["events"])), lambda e: e["fixed"]), lambda v: v.isNotNull())
    return F.coalesce(F.get(fixed, F.lit(0)), F.lit(""))


def vulnerable_imports(imports: DataFrame, findings: DataFrame) -> DataFrame:
    """Violations of files that import (file_id, project, module) a package with a finding (project, package, vuln_id, severity):
    equal but for case and - for _; critical and high are errors."""
    name = F.lower(F.split_part("module", F.lit("."), F.lit(1)))
    said = imports.select("file_id", "project", name.alias("module")).distinct()
    known = findings.select("project", F.lower(F.replace("package", F.lit("-"), F.lit("_"))).alias("module"), "package", "vuln_id", "severity")
    severity = F.when(F.col("severity").isin("critical", "high"), "error").otherwise("warning")
    return said.join(known, ["project", "module"]).select("file_id", F.lit("SEC014").alias("rule_id"), "package", "vuln_id", severity.alias("severity"))


def sarif(violations: DataFrame, paths: DataFrame) -> DataFrame:
    """file_id, sarif: one SARIF 2.1.0 text for each file (file_id, path) with violations; rules in the order they are first met. A file
    bounds what is held at once, so no project meets in one task."""
    level = F.lit("warning")
    for severity, name in LEVELS.items():
        level = F.when(F.col("severity") == severity, name).otherwise(level)
    each = violations.select("file_id", F.struct(F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("col", F.lit(0)).alias("col"), "rule_id", "rule", level.alias("level")).alias("v"))
    held = each.groupBy("file_id").agg(F.array_sort(F.collect_list("v")).alias("vs")).join(paths.select("file_id", "path"), "file_id")
    ids = F.array_distinct(F.transform("vs", lambda v: v["rule_id"]))
    rules = F.transform(ids, lambda i: F.filter("vs", lambda v: v["rule_id"] == i)[0])
    rules = F.transform(rules, lambda v: F.struct(v["rule_id"].alias("id"), F.struct(v["rule"].alias("text")).alias("shortDescription"), F.struct(v["level"].alias("level")).alias("defaultConfiguration")))
    region = lambda v: F.struct(F.greatest(v["line"], F.lit(1)).alias("startLine"))
    place = lambda v: F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region(v).alias("region")).alias("physicalLocation"))
    results = F.transform("vs", lambda v: F.struct(v["rule_id"].alias("ruleId"), v["level"].alias("level"), F.struct(v["rule"].alias("text")).alias("message"), F.array(place(v)).alias("locations")))
    run = F.struct(F.struct(F.struct(F.lit("sievemill").alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), results.alias("results"))
    return held.select("file_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def json_results(scores: DataFrame, violations: DataFrame) -> DataFrame:
    """file_id, json: each file's score and violations as one JSON text; files without violations have an empty list."""
    held = violations.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line", "col", "rule_id", "severity"))).alias("violations"))
    joined = scores.join(held, "file_id", "left").withColumn("violations", F.coalesce("violations", F.array().cast("array<struct<line:int,col:int,rule_id:string,severity:string>>")))
    return joined.select("file_id", F.to_json(F.struct("path", "score", "passed", "violations")).alias("json"))


def write_rules(rules: DataFrame, folder: str) -> None:
    """Mined rules as JSON lines, which read_rules reads."""
    rules.write.mode("overwrite").json(folder)


def read_rules(spark, folder: str) -> DataFrame:
    return spark.read.schema("id string, pattern string, severity string").json(folder)


def read_rule_rows(spark, folder: str, by_project: bool = False) -> DataFrame:
    """Whole rules as scan.known_rules takes them; with their project, as scan.scan_by_rules does."""
    return spark.read.schema(RULE_ROWS + ", project string" * by_project).json(folder)


def append_overrides(overrides: DataFrame, folder: str) -> None:
    """Overrides (rule_id, file_path, reason, ts) added to what the folder holds."""
    overrides.select("rule_id", "file_path", "reason", "ts").write.mode("append").parquet(folder)


def read_overrides(spark, folder: str) -> DataFrame:
    return spark.read.schema("rule_id string, file_path string, reason string, ts timestamp").parquet(folder)
