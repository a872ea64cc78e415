"""Scores, reports and conventions from violations (file_id, rule_id, severity, category) and files (file_id, project, lang, code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import RULE_ROWS

# What a violation costs, by severity.
WEIGHTS = {"error": 0.25, "warning": 0.08, "info": 0.02}
OTHER_WEIGHT = 0.05


def cost(severity: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in WEIGHTS.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out


def file_scores(files: DataFrame, violations: DataFrame) -> DataFrame:
    """Each file's score, 1 less the cost of its violations, 0 at least; passed without an error. Files without any: 1, passed."""
    by_file = violations.groupBy("file_id").agg(
        F.sum(cost(F.col("severity"))).alias("cost"), *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in WEIGHTS], F.count_if(F.col("category") == "security").alias("security")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = files.select("file_id", "project", "lang", "path").join(by_file, "file_id", "left")
    score = F.greatest(F.lit(0.0), 1 - F.coalesce("cost", F.lit(0.0)))
    return out.select("file_id", "project", "lang", "path", score.alias("score"), (F.coalesce("errors", F.lit(0)) == 0).alias("passed"), zero("errors"), zero("warnings"), zero("infos"), zero("security"))


def report(scores: DataFrame) -> DataFrame:
    """Files, average score, pass rate and totals by severity: of all (project null) and of each project, in one rollup."""
    return scores.rollup("project").agg(
        F.count("*").alias("files"), F.avg("score").alias("avg_score"), F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        *[F.sum(c).alias(c) for c in ("errors", "warnings", "infos")], F.grouping("project").cast("int").alias("total"),
    )


def project_report(scores: DataFrame) -> DataFrame:
    """The report of each project, with the language of most of its files."""
    spoken = majority_language(scores).withColumnRenamed("project", "_project")
    return report(scores).where("total = 0").drop("total").join(spoken, F.col("project").eqNullSafe(F.col("_project"))).drop("_project")


def majority_language(files: DataFrame) -> DataFrame:
    """Each project's most frequent language (ties: the first name)."""
    n = files.groupBy("project", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("project").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("lang"))


def top_rules(violations: DataFrame, k: int = 10) -> DataFrame:
    n = violations.groupBy("rule_id").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "rule_id").limit(k)


def worst_files(scores: DataFrame, k: int = 20) -> DataFrame:
    return scores.orderBy(F.round("score", 9), "file_id").limit(k).select("file_id", "score")


def convention_scan(files: DataFrame, scores: DataFrame, violations: DataFrame, k: int = 10) -> DataFrame:
    """Files, average score and pass rate of each project, the language of most files, and the `k` rules that it breaks most often (ties by name); files: those whose language counts.

    Violations are counted by project and rule before ranks are taken, so a project's window holds a row for each rule."""
    n = violations.join(scores.select("file_id", "project"), "file_id").groupBy("project", "rule_id").agg(F.count("*").alias("n"))
    ranked = n.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "rule_id"))).where(F.col("rank") <= k)
    top = ranked.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rule_id"))), lambda r: r["rule_id"]), ",").alias("top_rules"))
    return project_report(scores).drop("lang").join(majority_language(files), "project").join(top, "project", "left")


def violation_conventions(scores: DataFrame, violations: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """Rules that at least `least` files and a `share` of the project's files break: (project, rule_id, files, n, confidence)."""
    files = scores.groupBy("project").agg(F.count("*").alias("total"))
    met = violations.join(scores.select("file_id", "project"), "file_id").groupBy("project", "rule_id").agg(F.count_distinct("file_id").alias("files"), F.count("*").alias("n"))
    part = F.col("files") / F.col("total")
    return met.join(files, "project").where((F.col("files") >= least) & (part >= share)).select("project", "rule_id", "files", "n", F.least(F.lit(0.95), 0.6 + part * 0.3).alias("confidence"))


def clean_projects(scores: DataFrame) -> DataFrame:
    """Projects of 5 files or more of which over 70 percent have no violation at all."""
    clean = F.count_if(F.col("errors") + F.col("warnings") + F.col("infos") == 0)
    return scores.groupBy("project").agg(F.count("*").alias("files"), clean.alias("clean")).where("files >= 5 and clean / files > 0.7")


def naming_convention(files: DataFrame, least: int = 10) -> DataFrame:
    """Python projects whose function names are over 80 percent snake_case, or camelCase."""
    found = files.where("lang = 'python'").select("project", F.explode(F.regexp_extract_all("code", F.lit(r"def\s+(\w+)\s*\("), F.lit(1))).alias("name"))
    names = found.withColumn("name", F.regexp_replace("name", "^_+", "")).where("name <> ''")
    snake, camel = F.col("name").rlike("^[a-z][a-z0-9_]*$"), F.col("name").rlike("^[a-z][a-zA-Z0-9]*$")
    out = names.groupBy("project").agg(F.count("*").alias("functions"), F.avg(snake.cast("double")).alias("snake"), F.avg((camel & ~snake).cast("double")).alias("camel"))
    style = F.when(F.col("snake") > 0.8, "snake_case").when(F.col("camel") > 0.8, "camelCase")
    return out.where(F.col("functions") >= least).select("project", "functions", style.alias("style"), F.least(F.lit(0.95), F.greatest("snake", "camel")).alias("confidence")).where("style is not null")


def import_convention(files: DataFrame, least: int = 5) -> DataFrame:
    """Shares of a project's Python files with future annotations and with type-checking blocks."""
    out = files.where("lang = 'python'").groupBy("project").agg(
        F.count("*").alias("files"), F.avg(F.contains("code", F.lit("from __future__ import annotations")).cast("double")).alias("future"), F.avg(F.contains("code", F.lit("TYPE_CHECKING")).cast("double")).alias("type_checking")
    )
    return out.where(F.col("files") >= least).select("project", "files", "future", "type_checking", (F.col("future") > 0.5).alias("future_convention"), (F.col("type_checking") > 0.3).alias("type_checking_convention"))


def docstring_convention(files: DataFrame) -> DataFrame:
    """Share of Python functions whose next line begins with a triple quote: a convention over 0.6, its lack under 0.2 (of 10)."""
    pattern = r'(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+\w+[^\n]*:[^\n]*\n(?:[ \t]*"""|)'
    found = files.where("lang = 'python'").select("project", F.explode(F.regexp_extract_all("code", F.lit(pattern), F.lit(0))).alias("d"))
    out = found.groupBy("project").agg(F.count("*").alias("functions"), F.avg(F.endswith("d", F.lit('"""')).cast("double")).alias("documented"))
    return out.withColumn("convention", F.when((F.col("functions") >= 10) & (F.col("documented") > 0.6), "documented").when((F.col("functions") >= 10) & (F.col("documented") < 0.2), "undocumented"))


def quality_convention(scores: DataFrame) -> DataFrame:
    out = scores.groupBy("project").agg(F.avg("score").alias("avg_score"))
    return out.withColumn("fact", F.when(F.round("avg_score", 9) >= 0.9, "high").when(F.round("avg_score", 9) < 0.6, "low"))


def rules_from_conventions(conventions: DataFrame, least: float = 0.8) -> DataFrame:
    """Conventions of at least this confidence as rule rows that custom_rules takes."""
    return conventions.where(F.col("confidence") >= least).groupBy("rule_id").agg(F.count("*").alias("projects"), F.max("confidence").alias("confidence")).select(
        F.concat(F.lit("CONV-"), "rule_id").alias("id"), "projects", "confidence"
    )


#: Rules that conventions become. Their case counts, though users' rules are met without regard to it.
SNAKE_RULE = ("CONV-snake-case-functions", "convention-snake-case-functions", r"(?-i:def\s+[a-z]+[A-Z]\w*\s*\()", "warning", "style", "python", "A function in camelCase where the project has snake_case.", "Rename it in snake_case.")
DOCSTRING_RULE = ("CONV-docstrings", "convention-docstrings", r"def\s+\w+\s*\([^)]*\)\s*(?:->[^\n:]*)?:[ \t]*\n\s+[^\s\"']", "info", "style", "python", "A function without a docstring where the project has them.", "Add a docstring.")


def mined_rules(naming: DataFrame, docstrings: DataFrame, broken: DataFrame, least: float = 0.8) -> DataFrame:
    """Conventions of at least this confidence as rules (scan.RULE_ROWS and project), which scan.scan_by_rules takes: names in snake_case (see naming_convention), documented functions (see
    docstring_convention), and rules that are often broken (see violation_conventions), which have no pattern of their own: what they stand for is scanned for already."""
    names = [c.split()[0] for c in RULE_ROWS.split(", ")]
    fixed = lambda rule: [F.lit(v).alias(n) for n, v in zip(names, rule, strict=True)]
    snake = naming.where((F.col("style") == "snake_case") & (F.col("confidence") >= least)).select(*fixed(SNAKE_RULE), "project")
    told = docstrings.where((F.col("convention") == "documented") & (F.col("documented") >= least)).select(*fixed(DOCSTRING_RULE), "project")
    said = (F.concat(F.lit("CONV-enforce-"), "rule_id"), F.concat(F.lit("convention-enforce-"), F.lower("rule_id")), F.lit(""), F.lit("info"), F.lit("style"), F.lit("_custom"), F.concat(F.lit("Often broken: "), "rule_id"), F.lit("Enforce it."))
    often = broken.where(F.col("confidence") >= least).select(*[c.alias(n) for n, c in zip(names, said, strict=True)], "project")
    return snake.unionByName(told).unionByName(often)


def common_rules(scores: DataFrame, violations: DataFrame) -> DataFrame:
    """Rules that every project with violations breaks (two projects at least)."""
    met = violations.join(scores.select("file_id", "project"), "file_id").select("project", "rule_id").distinct()
    n = met.agg(F.count_distinct("project").alias("n"))
    return met.groupBy("rule_id").agg(F.count("*").alias("projects")).join(F.broadcast(n), F.expr("projects = n and n >= 2"), "left_semi")


def category_breakdown(violations: DataFrame) -> DataFrame:
    """Violations by category, with each category's most frequent rule."""
    n = violations.groupBy("category", "rule_id").agg(F.count("*").alias("n"))
    return n.groupBy("category").agg(F.sum("n").alias("violations"), F.count("*").alias("rules"), F.min_by("rule_id", F.struct(-F.col("n"), F.col("rule_id"))).alias("top_rule"))


def gate(scores: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """PASS for projects without an error and without a critical or high finding (project, severity) about their dependencies; how many files have errors, and how many such findings there are."""
    out = scores.groupBy("project").agg(F.sum("errors").alias("errors"), F.count_if(F.col("errors") > 0).alias("files_with_errors"))
    if findings is None:
        held = out.withColumn("severe", F.lit(0).cast("long"))
    else:
        severe = findings.where(F.col("severity").isin("critical", "high")).groupBy("project").agg(F.count("*").alias("severe"))
        held = out.join(severe, "project", "left").fillna(0, ["severe"])
    return held.select("project", F.when((F.col("errors") == 0) & (F.col("severe") == 0), "PASS").otherwise("FAIL").alias("gate"), "files_with_errors", "severe")


def confidence(scores: DataFrame) -> DataFrame:
    """low with an error or a security finding, medium with more than three warnings or without a test, high otherwise."""
    level = F.when((F.col("errors") > 0) | (F.col("security") > 0), "low").when((F.col("warnings") > 3) | ~F.col("path").contains("/tests/"), "medium").otherwise("high")
    return scores.select("file_id", level.alias("confidence"))


#: How many standards of a topic a level of stringency asks for.
ITEMS = {"strict": 5, "moderate": 3, "permissive": 1}


def stringency(level: Column) -> Column:
    return F.when(level >= 0.7, "strict").when(level >= 0.3, "moderate").otherwise("permissive")


def items(level: Column) -> Column:
    """How many standards of a topic to give at a level between 0 and 1."""
    name = stringency(level)
    return F.when(name == "strict", ITEMS["strict"]).when(name == "moderate", ITEMS["moderate"]).otherwise(ITEMS["permissive"])


def suggest_profile(scores: DataFrame) -> DataFrame:
    """A profile for each project by its average score, pass rate and number of files."""
    out = scores.groupBy("project").agg(F.round(F.avg("score"), 9).alias("avg_score"), F.round(F.avg(F.col("passed").cast("double")), 9).alias("pass_rate"), F.count("*").alias("files"))
    good = (F.col("avg_score") >= 0.9) & (F.col("pass_rate") >= 0.9)
    profile = F.when(good & (F.col("files") > 50), "enterprise").when(good, "library").when(F.col("avg_score") >= 0.7, "default").when(F.col("avg_score") >= 0.5, "startup").otherwise("prototype")
    return out.select("project", "files", profile.alias("profile"))


def thresholds(files: DataFrame, overrides: DataFrame, default: float) -> DataFrame:
    """The least score of each file: that of the first override (ord, pattern as a regex, least; null inherits) whose glob its path matches."""
    found = files.select("file_id", "path").join(F.broadcast(overrides), F.expr("rlike(path, pattern)"), "left")
    out = found.groupBy("file_id").agg(F.min_by("least", "ord").alias("least"))
    return out.select("file_id", F.coalesce("least", F.lit(default)).alias("least"))


def resolve_prefix(files: DataFrame, projects: DataFrame) -> DataFrame:
    """The project (name, prefix) with the longest prefix of each file's path."""
    found = files.select("file_id", "path").join(F.broadcast(projects), F.expr("startswith(path, prefix)"), "left")
    return found.groupBy("file_id").agg(F.max_by("name", F.length("prefix")).alias("name"))


def tokens(files: DataFrame) -> DataFrame:
    """An estimate of each project's tokens: a quarter of the characters of each file, 1 at least."""
    return files.groupBy("project").agg(F.sum(F.greatest(F.lit(1), F.floor(F.length("code") / 4))).alias("tokens"))
