"""Layers of paths and the imports between them, import graphs, knowledge that validations leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Layers (layer, ord, pattern), rules and triggers are a user's configuration, written by hand; more than this is an error.
MOST_LAYERS = 1000


def _small(table: DataFrame) -> list:
    rows = table.limit(MOST_LAYERS + 1).collect()
    if len(rows) > MOST_LAYERS:
        raise ValueError(f"more than {MOST_LAYERS} layers or rules")
    return rows


def _checked(table: DataFrame) -> DataFrame:
    """The table, which is small enough to be sent to all."""
    _small(table)
    return table


def layer_of(path: Column, layers: DataFrame) -> Column:
    """The first layer whose pattern the path matches; null if none does. The layers become one expression, so nothing is joined."""
    out = F.lit(None).cast("string")
    for row in sorted(_small(layers), key=lambda r: -r["ord"]):
        out = F.when(path.rlike(row["pattern"]), row["layer"]).otherwise(out)
    return out


def drift(imports: DataFrame, layers: DataFrame, rules: DataFrame) -> DataFrame:
    """file_id, layer, target, kind of imports (file_id, path, target: the path imported) that a layer's rules (layer, kind, target) forbid, or
    that aren't among those it allows, where it names any. A layer may always import itself."""
    placed = imports.select("file_id", layer_of(F.col("path"), layers).alias("layer"), layer_of(F.col("target"), layers).alias("target")).where("layer is not null and target is not null").distinct()
    forbidden = placed.join(F.broadcast(_checked(rules).where("kind = 'forbid'").select("layer", "target")), ["layer", "target"], "left_semi").withColumn("kind", F.lit("forbidden"))
    allowed = F.broadcast(rules.where("kind = 'allow'"))
    strict = placed.where("layer <> target").join(F.broadcast(allowed.select("layer").distinct()), "layer", "left_semi")
    other = strict.join(allowed.select("layer", "target"), ["layer", "target"], "left_anti").withColumn("kind", F.lit("not allowed"))
    return forbidden.unionByName(other).select("file_id", "layer", "target", "kind")


def import_graph(files: DataFrame) -> DataFrame:
    """folder, modules: the distinct top modules that the dotted imports of each folder's Python files name, in order."""
    module = F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"(?m)^\s*(?:import|from)\s+(\w+)\.\w"), F.lit(1))))
    edges = files.where("lang = 'python'").select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), module.alias("module")).distinct()
    return edges.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_set("module")), ",").alias("modules"))


def knowledge(scores: DataFrame, violations: DataFrame) -> DataFrame:
    """key, kind, files: what validations teach, once a key: rules broken three times or more in a file, security in a file, clean files (0.95
    and more). Counts are combined before they are shuffled."""
    each = violations.groupBy("file_id", "rule_id").agg(F.count("*").alias("n"), F.max(F.col("category") == "security").alias("security"))
    often = each.where("n >= 3").select(F.concat(F.lit("rule:"), "rule_id").alias("key"), F.lit("recurring").alias("kind"), "file_id")
    secure = each.where("security").select(F.concat(F.lit("security:"), "rule_id").alias("key"), F.lit("security").alias("kind"), "file_id")
    clean = scores.where("score >= 0.95").select(F.concat(F.lit("clean:"), "lang").alias("key"), F.lit("clean").alias("kind"), "file_id")
    return often.unionByName(secure).unionByName(clean).groupBy("key", "kind").agg(F.count_distinct("file_id").alias("files"), F.min("file_id").alias("first_id"))


def workspace_patterns(entries: DataFrame, least: int = 2, most: int = 1000) -> DataFrame:
    """tag, projects, content, confidence, names of entries (project, tags, content): tags of `least` projects or more, the content most often said (of
    equals the first), min(1, projects / all entries + 0.3), and the first `most` projects by name."""
    all_ = entries.agg(F.count("*").alias("all_entries"))
    each = entries.select("project", F.explode("tags").alias("tag"), "content")
    of = each.groupBy("tag", "project").agg(F.lit(1).alias("_one"))
    of = of.withColumn("place", F.row_number().over(Window.partitionBy("tag").orderBy("project")))
    of = of.groupBy("tag").agg(F.count("*").alias("projects"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.col("project")))), ",").alias("names")).where(F.col("projects") >= least)
    said = each.groupBy("tag", "content").agg(F.count("*").alias("n"))
    best = said.groupBy("tag").agg(F.min_by("content", F.struct(-F.col("n"), F.col("content"))).alias("content"))
    confidence = F.least(F.lit(1.0), F.col("projects") / F.col("all_entries") + 0.3)
    return of.join(best, "tag").crossJoin(F.broadcast(all_)).select("tag", "projects", "content", confidence.alias("confidence"), "names")


def missing_conventions(project: DataFrame, workspace: DataFrame) -> DataFrame:
    """project, tag: tags of the workspace's conventions that a project (project, tags) lacks."""
    has = project.select("project", F.explode("tags").alias("tag")).distinct()
    tags = [r["tag"] for r in _small(workspace.select("tag").distinct())]  # a workspace has few conventions
    wanted = project.select("project").distinct().select("project", F.explode(F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>")).alias("tag"))
    return wanted.join(has, ["project", "tag"], "left_anti")


def guardrails(prompts: DataFrame, triggers: DataFrame, most: int = 3) -> DataFrame:
    """prompt_id, domain, items: as guidance, but at most `most` items for all domains of a prompt together; the last may be cut. triggers:
    (domain, ord, trigger, n_items), a table of a user."""
    met = prompts.join(F.broadcast(_checked(triggers)), F.expr("contains(lower(text), trigger)"))
    n = met.groupBy("prompt_id", "domain").agg(F.count("*").alias("hits"), F.min("ord").alias("ord"), F.min("n_items").alias("n_items"))
    order = Window.partitionBy("prompt_id").orderBy(F.desc("hits"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_items").over(order), F.lit(0))
    return n.withColumn("before", before).where(F.col("before") < most).select("prompt_id", "domain", F.least(F.col("n_items"), most - F.col("before")).cast("int").alias("items"))
