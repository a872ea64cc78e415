"""Fixes of violations: what is suggested, and what is made in the code."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import RULES, Rule


class Patch(NamedTuple):
    """What a rule's fix replaces in its line, by what (with \\1 for the first group), and how sure it is."""

    rule_id: str
    pattern: str
    by: str
    confidence: float


#: The text that is suggested for a rule, and how sure it is.
TEMPLATES = {
    "PY003": ("except Exception:", 0.95), "PY004": ("=None", 0.85), "PY005": ("# Use native types: list[], dict[], set[], tuple[], X | None, X | Y", 0.8), "PY006": ("isinstance(obj, cls)", 0.9),
    "PY008": ("with open(path) as f:", 0.75), "PY009": ('"""TODO: Add docstring."""', 0.7), "PY011": ("# Use pathlib.Path instead of os.path", 0.8), "PY012": ("logging.getLogger(__name__)", 0.75),
    "JS001": ("const", 0.9), "JS002": ("===", 0.95), "JS003": ("// TODO: Add error handling for this promise", 0.7), "TS001": (": unknown", 0.75), "TS004": ("as unknown", 0.9),
    "RS001": ('.expect("TODO: handle error")', 0.9), "RS002": ("// TODO: Use ? operator instead of .unwrap()", 0.8), "GO001": ("if err != nil { return err }", 0.85), "GO002": ("// TODO: Handle error from deferred call", 0.7),
    "JAVA001": ("private static final Logger logger = LoggerFactory.getLogger(ClassName.class);", 0.75), "SEC001": ('# TODO: Move secret to environment variable: os.environ["SECRET_KEY"]', 0.85),
    "SEC002": ("cursor.execute(query, params)", 0.9), "SEC003": ("subprocess.run(cmd, shell=False, check=True)", 0.85), "SEC004": ("# Validate path: os.path.realpath(user_path).startswith(base_dir)", 0.8),
    "SEC005": ("json.loads(data)", 0.9), "SEC006": ("https://", 0.95), "SEC007": ("verify=True", 0.95), "SEC008": ("cursor.execute(query, (param,))", 0.9), "SEC014": ("# Upgrade vulnerable dependency — see violation suggestion for target version", 0.5),
    "AI001": ("# TODO: Implement this function", 0.7), "AI003": ("# Consider simplifying: extract only needed functionality", 0.7), "AI006": ("# Consider using stdlib alternative", 0.7),
    "AI007": ("# SECURITY: Use proper cryptographic hashing (e.g., bcrypt, argon2)", 0.9), "AI008": ("# SECURITY: Use parameterized queries, not string interpolation", 0.9), "TS008": ("?.", 0.8),
    "GO010": ('fmt.Errorf("message: %w", err)', 0.9), "RS006": ("// TODO: Return Result<T, E> instead of panic!()", 0.75), "RS007": ("// TODO: Implement this functionality", 0.7),
    "JV008": ("preparedStatement.setString(1, param)", 0.9), "CS004": ("async Task", 0.95), "CS005": ("await Task.Delay(milliseconds)", 0.9), "CS007": ("System.Text.Json.JsonSerializer.Serialize(obj)", 0.9),
}
#: What a fix replaces in a line. Of several of a rule, the first that the line has is made.
PATCHES = [
    Patch("PY003", r"^(\s*)except\s*:", r"\1except Exception:", 0.95), Patch("PY005", r"\bList\[", "list[", 0.95), Patch("PY005", r"\bDict\[", "dict[", 0.95), Patch("PY005", r"\bTuple\[", "tuple[", 0.95),
    Patch("PY005", r"\bSet\[", "set[", 0.95), Patch("PY005", r"\bOptional\[(\w+)\]", r"\1 | None", 0.9), Patch("JS001", r"\bvar\b", "const", 0.85), Patch("JS002", r"([^!=])={2}([^=])", r"\1===\2", 0.9),
    Patch("JS002", r"!={1}([^=])", r"!==\1", 0.9), Patch("SEC006", r"http://", "https://", 0.95), Patch("SEC007", r"verify\s*=\s*False", "verify=True", 0.95),
]
#: Rules whose fixes are offered at once, and how sure these must be; and how sure a fix must be to be suggested.
QUICK, QUICK_SURE, SURE = [*(f"SEC00{n}" for n in range(1, 9)), "AI001", "AI007", "AI008"], 0.8, 0.7


def patched(line: Column, rule_id: Column, patches: Iterable[Patch]) -> Column:
    """The line with the first patch of the rule that it has; as it is where it has none."""
    out = None
    for p in patches:
        meets, made = (rule_id == p.rule_id) & line.rlike(p.pattern), F.regexp_replace(line, F.lit(p.pattern), F.lit(re.sub(r"\\(\d)", r"$\1", p.by)))
        out = F.when(meets, made) if out is None else out.when(meets, made)
    return line if out is None else out.otherwise(line)


def fix_plan(violations: DataFrame, sure: float = SURE, templates: Mapping[str, tuple[str, float]] = TEMPLATES, patches: Iterable[Patch] = tuple(PATCHES)) -> DataFrame:
    """file_id, rule_id, line, col, snippet, fixed, confidence, is_template of the violations (with a snippet) that have a fix of at least this confidence: the rule's text where it has
    one, else the line with the first patch that it has. Narrow but for a join with the table of texts, which is as small as the rules are few and is sent to all."""
    texts = violations.sparkSession.createDataFrame([(k, t, c) for k, (t, c) in templates.items()], "rule_id string, template string, certain double")
    snippet, rule = F.coalesce("snippet", F.lit("")), F.col("rule_id")
    by_patch = None
    for p in patches:
        meets, c = (rule == p.rule_id) & snippet.rlike(p.pattern), F.lit(p.confidence)
        by_patch = F.when(meets, c) if by_patch is None else by_patch.when(meets, c)
    fixed = F.coalesce("template", patched(snippet, rule, patches)).alias("fixed")
    confidence = F.coalesce("certain", by_patch if by_patch is not None else F.lit(None)).alias("confidence")
    told = violations.join(F.broadcast(texts), "rule_id", "left").select("file_id", "rule_id", "line", "col", "snippet", fixed, confidence, F.col("template").isNotNull().alias("is_template"))
    return told.where(F.col("confidence") >= sure)


def quick_fixes(violations: DataFrame) -> DataFrame:
    """The plan of the rules about security and the gravest about generated code alone, of which one can be surer."""
    return fix_plan(violations.where(F.col("rule_id").isin(*QUICK)), QUICK_SURE)


def patched_rules(rules: Iterable[Rule] = RULES, sure: float = SURE, patches: Iterable[Patch] = tuple(PATCHES)) -> list[Rule]:
    """The rules that apply_fixes has a patch for: it takes no notice of violations of others, which need not be looked for."""
    ids = {p.rule_id for p in patches if p.confidence >= sure}
    return [r for r in rules if r.id in ids]


def apply_fixes(files: DataFrame, violations: DataFrame, sure: float = SURE, patches: Iterable[Patch] = tuple(PATCHES)) -> DataFrame:
    """file_id, code, applied of the files that violations (file_id, rule_id, line, col) have a patch for: each violation, by rule and column, makes the first patch of its rule that its line
    still has, so several may change one line, in turn; applied counts those that changed it. A second run finds nothing to do.

    Violations meet the code once a file, by what is wrong on each line: a join on file_id, after which lines are changed where they are. No line is shuffled. Violations without a line,
    beyond the end, or of files that aren't there have no effect."""
    chosen = [p for p in patches if p.confidence >= sure]
    own = violations.where(F.col("rule_id").isin(*{p.rule_id for p in chosen}) & F.col("line").isNotNull())
    by_line = own.groupBy("file_id", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "col"))), lambda v: v["rule_id"]).alias("rules"))
    wrong = by_line.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("line", "rules"))).alias("wrong"))
    start = lambda t: F.struct(t.alias("text"), F.lit(0).alias("n"))

    def step(acc: Column, rule: Column) -> Column:
        new = patched(acc["text"], rule, chosen)
        return F.struct(new.alias("text"), (acc["n"] + F.when(new == acc["text"], 0).otherwise(1)).alias("n"))

    fix = lambda t, i: F.when(F.map_contains_key("wrong", i + 1), F.aggregate(F.element_at("wrong", i + 1), start(t), step)).otherwise(start(t))
    done = files.select("file_id", "code").join(wrong, "file_id").select("file_id", F.explode(F.array(F.transform(F.split("code", "\n"), fix))).alias("l"))
    applied = F.aggregate("l", F.lit(0), lambda acc, x: acc + x["n"])
    return done.select("file_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("code"), applied.alias("applied"))
