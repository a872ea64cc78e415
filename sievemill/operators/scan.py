"""The rule scan: files (file_id, lang, code, ...) to violations (file_id, rule_id, severity, category, line, col, snippet)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.catalogue import LANGUAGE_SIGNS, RULES, TEST_FREE, TEST_SIGNS, Rule


def is_test(code):
    """Whether code looks like tests. Each sign is asked of texts that have its literals, which takes a part of the time of one pattern of all signs."""
    return reduce(lambda a, b: a | b, (text.has(code, s) for s in TEST_SIGNS))


def is_minified(code):
    """A line of over 500 characters, or lines of over 200 on average in under 5 lines."""
    lines = F.split(F.trim(code), "\n")
    mean = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / F.size(lines)
    return F.exists(lines, lambda x: F.length(x) > 500) | ((mean > 200) & (F.size(lines) < 5))


def weighted(code, signs: list[tuple[str, int]]):
    """The matches of all signs, each times its weight."""
    return sum((text.count(code, p) * w for p, w in signs), F.lit(0))


def best_match(scores: dict, high: int = 8, margin: int = 3, medium: int = 4):
    """(best, score, confidence) of named scores; ties go to the first name; null and low where nothing matched."""
    table = F.array(*[F.struct(v.alias("score"), F.lit(-i).alias("at"), F.lit(k).alias("name")) for i, (k, v) in enumerate(scores.items())])

    def told(top):
        first, second = top[0], top[1]
        sure = F.when((first["score"] >= high) & (first["score"] - second["score"] >= margin), "high").when(first["score"] >= medium, "medium").otherwise("low")
        found = first["score"] > 0
        return F.struct(F.when(found, first["name"]).alias("best"), first["score"].alias("score"), F.when(found, sure).otherwise("low").alias("confidence"))

    return text.bound(F.reverse(F.array_sort(table)), told)


def detect_language(code):
    return text.bound(code, lambda c: best_match({lang: weighted(c, signs) for lang, signs in LANGUAGE_SIGNS.items()}))


def conditions(rule: Rule, test) -> list:
    """What holds of a file (code, lang, _lower) that the rule matches, the cheapest first, for text.when_all(). test: whether it is test code."""
    code = F.col("code")
    return [F.col("lang") == rule.lang] * bool(rule.lang) + text.has_steps(code, rule.regex, F.col("_lower")) + [~test] * (rule.slug in TEST_FREE)


def _found(rule: Rule):
    """What a rule matches in files of its language, and what is between; null where it doesn't match."""
    code = F.col("code")
    found = F.regexp_extract_all(code, F.lit(rule.regex), F.lit(0))
    return text.when_all(conditions(rule, is_test(code)), F.struct(F.lit(rule.id).alias("rule_id"), found.alias("found"), F.split(code, rule.regex, -1).alias("parts")))


def _outside(found, spans, lines, *more):
    """Of placed matches, those that start in no literal or comment: line, col, text, and the line they start in."""
    real = F.filter(found, lambda m: ~text.in_skip(m["start"], spans))
    return F.transform(real, lambda m: F.struct(*more, m["line"].alias("line"), m["col"].alias("col"), m["match"].alias("match"), F.trim(F.get(lines, m["line"] - 1)).alias("snippet")))


def _lexed():
    return F.struct(text.skip_spans(F.col("code"), F.col("lang")).alias("spans"), F.split("code", "\n").alias("lines"))


def rule_scan(files: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Every match of every rule of the file's language (or of all languages) that doesn't start inside a literal or comment.

    One narrow stage: all rules are expressions of one array, so a file is read once and nothing is shuffled. Files that a rule matches are lexed, once; places are
    worked out for the rules that match only, in time in proportion to matches and lexemes. All that is one expression, which is exploded: only places leave
    it, no texts are copied. Empty and blank files have no violations.
    """
    rules = list(rules)
    spark = files.sparkSession
    known = spark.createDataFrame([(r.id, r.slug, r.severity, r.category) for r in rules], "rule_id string, rule string, severity string, category string")
    places = lambda hits, f: F.flatten(F.transform(hits, lambda h: _outside(text.placed(h["parts"], h["found"]), f["spans"], f["lines"], h["rule_id"].alias("rule_id"))))
    met = text.bound(F.array_compact(F.array(*map(_found, rules))), lambda hits: F.when(F.size(hits) > 0, text.bound(_lexed(), lambda f: places(hits, f))))
    # not a column alone is exploded: of that Spark would first ask whether it is empty, which works it out twice
    each = files.where(F.trim("code") != "").withColumn("_lower", F.lower("code")).select("file_id", F.explode(met).alias("m")).select("file_id", "m.rule_id", "m")
    real = F.lit(True)
    for rule in rules:
        if rule.unless:
            real = real & ~((F.col("rule_id") == rule.id) & F.col("m.match").rlike(rule.unless))
    return each.where(real).join(F.broadcast(known), "rule_id").select("file_id", "rule_id", "rule", "severity", "category", "m.line", "m.col", "m.snippet")


#: Rules of a table that is sent to all tasks, at most.
MOST_RULES = 1000
RULE_ROWS = "id string, rule string, pattern string, severity string, category string, language string, message string, suggestion string"


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether the JVM, which runs the scan, takes a pattern."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  the JVM's exceptions have no common Python type but this
        return False
    return True


def known_rules(rules: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """A table of user rules (RULE_ROWS) as scan_by_rules takes it: without rows that have no pattern or one that the JVM doesn't take. More than `most` rows are an error."""
    spark = rules.sparkSession
    rows = rules.select(*[c.split()[0] for c in RULE_ROWS.split(", ")]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rules; give them by project")
    return spark.createDataFrame([tuple(r) for r in rows if r["pattern"] and compiles(spark, r["pattern"])], RULE_ROWS)


def scan_by_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations as rule_scan gives them, and message, of rules that are known only at run time: rows (RULE_ROWS) with a pattern, of which a file meets those of its language
    (`_custom`: all). Case doesn't count. A user's table goes through known_rules and is sent to all tasks; rules with a `project` meet that project's files by a join
    on it, however many there are."""
    own = "project" in rules.columns
    told = rules.where("pattern <> ''").select(F.col("id").alias("rule_id"), "rule", F.concat(F.lit("(?i)"), "pattern").alias("pattern"), "severity", "category", "language", "message", *["project"] * own)
    speaks = (F.col("language") == F.col("lang")) | (F.col("language") == "_custom")
    wanted = (files.where(F.trim("code") != "").join(told, "project") if own else files.where(F.trim("code") != "").join(F.broadcast(told))).where(speaks & F.rlike("code", F.col("pattern")))
    parts, found = F.split("code", F.col("pattern"), -1), F.regexp_extract_all("code", F.col("pattern"), F.lit(0))
    lines, spans = F.split("code", "\n").alias("lines"), text.skip_spans(F.col("code"), F.col("lang")).alias("spans")
    # an array of one, so that what is exploded is worked out once
    hits = wanted.select("file_id", "rule_id", "rule", "severity", "category", "message", lines, spans, F.explode(F.array(F.struct(parts.alias("parts"), found.alias("found")))).alias("h"))
    each = hits.select("file_id", "rule_id", "rule", "severity", "category", "message", F.explode(_outside(text.placed(F.col("h.parts"), F.col("h.found")), F.col("spans"), F.col("lines"))).alias("m"))
    return each.select("file_id", "rule_id", "rule", "severity", "category", "m.line", "m.col", "m.snippet", "message")


def security_scan(files: DataFrame) -> DataFrame:
    return rule_scan(files, [r for r in RULES if not r.lang])


def quick_scan(files: DataFrame, scope: str = "security") -> DataFrame:
    """security: the rules for all languages; essential: also those of the file's language that are errors."""
    return rule_scan(files, [r for r in RULES if not r.lang or scope == "essential" and r.severity == "error"])


def custom_rules(rules: Iterable[Rule], base: Iterable[Rule] = RULES) -> list[Rule]:
    """base with the user's rules: a known id only changes the severity; a pattern that the JVM doesn't take is left out. User rules ignore case."""
    spark = SparkSession.active()
    out = {r.id: r for r in base}
    for rule in rules:
        if rule.id in out:
            out[rule.id] = out[rule.id]._replace(severity=rule.severity)
            continue
        if compiles(spark, rule.pattern):
            out[rule.id] = rule._replace(ignore_case=True)
    return list(out.values())


def at_least(violations: DataFrame, severity: str) -> DataFrame:
    """Violations of a severity or a worse one."""
    return violations.where(text.severity_rank(F.col("severity")) <= {"error": 0, "info": 2}.get(severity, 1))


def near_changes(violations: DataFrame, changed: DataFrame, reach: int = 2) -> DataFrame:
    """Violations within `reach` lines of a changed line (file_id, line), and those without a line. An equi join on widened lines, which reads the violations once."""
    wide = changed.select("file_id", F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)).alias("line")).distinct()
    return violations.join(wide.withColumn("_near", F.lit(True)), ["file_id", "line"], "left").where("_near or line is null").select(*violations.columns)


def replaced(violations: DataFrame, checked: DataFrame, ids: list[str]) -> DataFrame:
    """Violations with those of the rules `ids` replaced by the ones of another check."""
    return violations.where(~F.col("rule_id").isin(*ids)).unionByName(checked.where(F.col("rule_id").isin(*ids)))


def first_seen(violations: DataFrame) -> DataFrame:
    """Each rule's first violation, by file, line and column."""
    return violations.groupBy("rule_id").agg(F.min(F.struct("file_id", "line", "col")).alias("f"), F.count("*").alias("n")).select("rule_id", "f.file_id", "f.line", "f.col", "n")


def related(violations: DataFrame) -> DataFrame:
    """Other rules of the same category that a violation's file breaks."""
    each = violations.select("file_id", "category", "rule_id").distinct()
    other = each.withColumnRenamed("rule_id", "other")
    pairs = each.join(other, ["file_id", "category"]).where("rule_id <> other")
    return pairs.groupBy("file_id", "rule_id").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("related"))


def compare_candidates(scores: DataFrame) -> DataFrame:
    """The winner of each group of variants (group, label, score, errors): highest score, fewest errors, first label."""
    return scores.groupBy("group").agg(F.min_by("label", F.struct(-F.col("score"), F.col("errors"), F.col("label"))).alias("winner"), F.count("*").alias("variants"))
