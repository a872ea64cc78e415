"""Dependencies and advisories, plans and prompts: jobs that are joins with small or large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_package
from ..places import cut


def cvss_severity(score: Column) -> Column:
    """critical, high, medium or low by a score of 9, 7 or 4; medium where there is none."""
    number = F.expr("try_cast(score AS DOUBLE)") if score is None else score.try_cast("double")
    return F.when(number >= 9, "critical").when(number >= 7, "high").when(number >= 4, "medium").when(number.isNotNull(), "low").otherwise("medium")


def parse_requirements(manifests: DataFrame) -> DataFrame:
    """(project, package, version) of requirement lines (project, text): comments and options go, names are normalised, the version is the
    first number of the specifier."""
    rows = manifests.select("project", F.explode(F.split("text", "\n")).alias("l")).where(F.trim("l").rlike("^[A-Za-z0-9]"))
    return rows.select("project", normalize_package(F.regexp_extract("l", r"^\s*([A-Za-z0-9][\w.-]*)", 1)).alias("package"), F.regexp_extract("l", r"[=<>~!]=?\s*v?([0-9][\w.]*)", 1).alias("version"))


def lock_enriched(dependencies: DataFrame, locks: DataFrame) -> DataFrame:
    """Dependencies with the version of the lock (project, package, locked), where there is one."""
    return dependencies.join(locks, ["project", "package"], "left").select("project", "package", F.coalesce("locked", "version").alias("version"))


def findings(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies that an advisory (package, version, vuln_id, score) is about. Where both name an ecosystem it must be the same, so that packages of one name don't meet."""
    keys = [k for k in ("ecosystem", "package", "version") if k in dependencies.columns and k in advisories.columns]
    return dependencies.join(advisories, keys).select("project", "package", "version", "vuln_id", cvss_severity(F.col("score")).alias("severity"))


def finding_counts(found: DataFrame) -> DataFrame:
    """Findings of each project by severity, as columns."""
    return found.groupBy("project").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")], F.count_distinct("package").alias("packages"))


def dangling(steps: DataFrame) -> DataFrame:
    """References (plan_id, step, needs) to steps that the plan doesn't have."""
    each = steps.select("plan_id", "step", F.explode("needs").alias("need"))
    return each.join(steps.select("plan_id", F.col("step").alias("need")), ["plan_id", "need"], "left_anti").select("plan_id", "step", "need")


def reach(steps: DataFrame) -> DataFrame:
    """plan_id, a, b: which steps lead to which by dependencies (plan_id, step, needs), over any number of steps: paths are doubled until no path is new. Each doubling is an
    equi join within plans and cuts the lineage; there are as many as the longest path has binary digits."""
    paths = cut(steps.select("plan_id", F.col("step").alias("a"), F.explode("needs").alias("b")).distinct())
    known = -1
    while known != (n := paths.count()):
        known = n
        left, right = paths.withColumnRenamed("b", "m"), paths.withColumnRenamed("a", "m")
        paths = cut(paths.union(left.join(right, ["plan_id", "m"]).select("plan_id", "a", "b")).distinct())
    return paths


def cycles(steps: DataFrame) -> DataFrame:
    """Steps on a cycle of dependencies, of any length."""
    return reach(steps).where("a = b").select("plan_id", F.col("a").alias("step"))


def cycle_groups(steps: DataFrame) -> DataFrame:
    """plan_id, step, first: steps on a cycle, with the first of those that lead to each other."""
    paths = reach(steps)
    back = paths.select("plan_id", F.col("b").alias("a"), F.col("a").alias("b"))
    return paths.join(back, ["plan_id", "a", "b"]).groupBy("plan_id", F.col("a").alias("step")).agg(F.min("b").alias("first"))


def guidance(prompts: DataFrame, triggers: DataFrame, most: int = 2) -> DataFrame:
    """The domains (domain, ord, trigger) with most triggers in each prompt (prompt_id, text), `most` at most; ties by ord. The triggers
    are a small table that is sent to all."""
    met = prompts.join(F.broadcast(triggers), F.expr("contains(lower(text), trigger)"))
    n = met.groupBy("prompt_id", "domain").agg(F.count("*").alias("hits"), F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("hits"), "ord"))
    return n.withColumn("rank", rank).where(F.col("rank") <= most).select("prompt_id", "domain", "hits", "rank")
