"""Advice: what a violation means, which standards, layers and stacks a prompt touches, which findings are beyond doubt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain
from .architecture import _checked, layer_of
from .checks import DEF
from .entities import entities
from .prompts import LANGUAGES, frameworks, scores
from .quality import ITEMS

#: Bodies that do nothing, after a docstring or without one.
_NOTHING = r"(?:pass|\.\.\.|raise NotImplementedError(?:\([^\n]*\))?)"
_DOCSTRING = r'''(?:[rRuU]?(?:"""[^"]*(?:"{1,2}[^"]+)*"""|\'\'\'[^\']*(?:\'{1,2}[^\']+)*\'\'\'|"[^"\n]*"|\'[^\'\n]*\')\n)?'''
STUB, STATEMENT = rf"\A{_DOCSTRING}{_NOTHING}\z", rf"^\s*{_NOTHING}\s*(?:#.*)?$"
INLINE, ABSTRACT = rf"^\s*(?:async\s+)?def\s+\w+.*:\s*{_NOTHING}\s*(?:#.*)?$", r"^\s*@(?:\w+\.)*abstractmethod\s*(?:#.*)?$"


def confirmed_placeholders(table: DataFrame, functions: DataFrame) -> DataFrame:
    """file_id, line of the one statement of Python functions that do nothing, but abstract methods. table: marked lines; functions: as
    lines.functions gives them. Only lines that are such statements meet functions that have such a body."""
    real = table.where((F.col("lang") == "python") & (F.trim("c") != ""))
    other = (~F.ltrim("c").startswith("@")).cast("int")
    group = F.coalesce(F.sum(other).over(Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    real = real.withColumn("g", group).withColumn("abstract", F.max(F.col("c").rlike(ABSTRACT)).over(Window.partitionBy("file_id", "g")))
    defs = real.where(F.col("c").rlike(DEF) & ~F.col("abstract"))
    inline = defs.where(F.col("c").rlike(INLINE)).select("file_id", "line")
    alone = functions.where(F.col("body").rlike(STUB)).select("file_id", "start", "stop").join(defs.select("file_id", F.col("line").alias("start")), ["file_id", "start"])
    said = table.where((F.col("lang") == "python") & F.col("c").rlike(STATEMENT)).select("file_id", "line")
    last = alone.join(said, "file_id").where("line > start and line <= stop").groupBy("file_id", "start").agg(F.max("line").alias("line"))
    return inline.unionByName(last.select("file_id", "line")).distinct()


def mark_verifiable(violations: DataFrame, confirmed: DataFrame) -> DataFrame:
    """violations (file_id, rule_id, category, line) with `verifiable`: false for what only patterns say (category ai_quality), unless it is a
    placeholder (AI001) on a confirmed line."""
    sure = confirmed.select("file_id", "line", F.lit(True).alias("sure"))
    held = F.coalesce((F.col("rule_id") == "AI001") & F.col("sure"), F.lit(False))
    return violations.join(sure, ["file_id", "line"], "left").withColumn("verifiable", (F.col("category") != "ai_quality") | held).drop("sure")


def explain(violations: DataFrame, rules: DataFrame, texts: DataFrame, overridden: DataFrame, conventions: DataFrame, often: int = 5) -> DataFrame:
    """violations with `explanation` and `overrides`. rules (rule_id, category, severity): the catalogue, which is explained once a rule, so that
    violations meet a small table. texts (kind, ord, name, text): of a rule (its id, or the first that its id begins with), a category, a severity.
    overridden (rule_id, n). conventions (ord, name, category, tags): the first of the category, or with a tag that holds the id's first two letters.
    What no text is known of is named by its id and its rule."""
    kinds, told = rules.select("rule_id", "category", "severity").distinct(), _checked(texts)
    by_id = F.broadcast(told.where("kind = 'rule'").select("ord", "name", "text"))
    of_rule = kinds.select("rule_id").distinct().join(by_id, F.expr("startswith(rule_id, name)")).groupBy("rule_id").agg(F.min_by("text", F.struct(F.col("rule_id") != F.col("name"), F.col("ord"))).alias("of_rule"))
    of = lambda kind: told.where(F.col("kind") == kind).select(F.col("name").alias(kind), F.col("text").alias(f"of_{kind}"))
    tagged = F.exists("tags", lambda t: F.contains(F.lower(t), F.lower(F.substring("rule_id", 1, 2))))
    near = kinds.join(F.broadcast(_checked(conventions).withColumnRenamed("category", "_category")), (F.col("category") == F.col("_category")) | tagged)
    near = near.groupBy("rule_id", "category").agg(F.min_by("name", "ord").alias("convention"))
    n = F.col("overrides")
    lowered = F.when(n >= often, F.format_string("Overridden %d times; its severity may be too high.", n)).when(n > 0, F.format_string("Overridden %d times before.", n))
    each = kinds.join(of_rule, "rule_id", "left").join(of("category"), "category", "left").join(of("severity"), "severity", "left").join(near, ["rule_id", "category"], "left")
    each = each.join(overridden.select("rule_id", F.col("n").alias("overrides")), "rule_id", "left").fillna(0, ["overrides"])
    said = F.concat_ws(" ", "of_rule", "of_category", "of_severity", lowered, F.concat(F.lit("See the convention "), "convention", F.lit(".")))
    each = each.select("rule_id", "category", "severity", F.nullif(said, F.lit("")).alias("explanation"), "overrides")
    out = violations.join(each, ["rule_id", "category", "severity"], "left").fillna(0, ["overrides"])
    return out.withColumn("explanation", F.coalesce("explanation", F.concat(F.lit("Violation "), "rule_id", F.lit(": "), "rule")))


def layer_context(prompts: DataFrame, layers: DataFrame, rules: DataFrame) -> DataFrame:
    """prompt_id, path, layer, forbidden: the layers of the files that a prompt names, each once with the first such file, and what they must not
    import. Layers that may import all are left out. A leading ./ is no part of a path."""
    path = F.regexp_replace("named", r"^\./", "")
    named = entities(prompts).where("kind = 'file_path'").select("prompt_id", "start", path.alias("path"), layer_of(path, layers).alias("layer"))
    first = named.where("layer is not null").groupBy("prompt_id", "layer").agg(F.min_by("path", "start").alias("path"))
    forbidden = _checked(rules).where("kind = 'forbid'").groupBy("layer").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("forbidden"))
    return first.join(F.broadcast(forbidden), "layer").select("prompt_id", "path", "layer", "forbidden")


def stack_facts(prompts: DataFrame) -> DataFrame:
    """key, content, first_id, prompts: each language with the frameworks named beside it, once, in the words of the first prompt."""
    low = plain(F.lower("text"))
    found = prompts.select("prompt_id", F.get(scores(low, LANGUAGES), F.lit(0))["name"].alias("language"), frameworks(low).alias("frameworks"))
    found = found.where(F.col("language").isNotNull() & (F.size("frameworks") > 0))
    key = F.concat(F.lit("stack:"), "language", F.lit(":"), F.array_join(F.array_sort("frameworks"), ","))
    content = F.concat("language", F.lit(" with "), F.array_join("frameworks", ", "))
    return found.groupBy(key.alias("key")).agg(F.min_by(content, "prompt_id").alias("content"), F.min("prompt_id").alias("first_id"), F.count("*").alias("prompts"))


def standards_for(intents: DataFrame, standards: DataFrame, versions: DataFrame, levels: dict[str, str] | None = None) -> DataFrame:
    """prompt_id, topic, ord, text: the standards that classified prompts call for. standards (topic, ord from 1, text) has topics language:x,
    framework:x, framework:x-major, security:authentication, security:input_validation, rag, graph, testing, architecture. versions (framework,
    version): a framework's topic for its major version, where there is one, replaces the general one. levels: how strict each of language,
    framework, security, testing and architecture is (moderate otherwise), which bounds how many of a topic are given. The join is on topics;
    prompts are many, standards few, and nothing forces a side."""
    cap = lambda kind: F.lit(ITEMS[(levels or {}).get(kind, "moderate")])
    topic = lambda name, kind: F.struct(name.alias("topic"), cap(kind).alias("cap"))
    when = lambda held, name, kind: F.when(held, topic(F.lit(name), kind))
    named = F.transform(F.filter(F.split("frameworks", ","), lambda f: f != ""), lambda f: topic(F.concat(F.lit("framework:"), f), "framework"))
    rest = F.array(
        F.when(F.col("language").isNotNull(), topic(F.concat(F.lit("language:"), "language"), "language")),
        when(F.col("security"), "security:authentication", "security"), when(F.col("security"), "security:input_validation", "security"),
        when(F.col("rag"), "rag", "framework"), when(F.col("graph"), "graph", "framework"), when(F.col("task") == "test", "testing", "testing"),
        topic(F.lit("architecture"), "architecture"),
    )
    asked = intents.select("prompt_id", F.explode(F.array_compact(F.concat(named, rest))).alias("t")).select("prompt_id", "t.topic", "t.cap")
    major = F.concat(F.lit("framework:"), "framework", F.lit("-"), F.split_part("version", F.lit("."), F.lit(1)))
    newer = versions.select(major.alias("topic"), F.concat(F.lit("framework:"), "framework").alias("general")).join(standards, "topic")
    newer = newer.select(F.col("general").alias("topic"), "ord", "text")
    held = standards.join(newer.select("topic").distinct(), "topic", "left_anti").select("topic", "ord", "text").unionByName(newer)
    return asked.join(held, "topic").where(F.col("ord") <= F.col("cap")).select("prompt_id", "topic", "ord", "text")
