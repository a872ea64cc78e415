"""Plans (plan_id, text): steps, what is wrong with them, scores. A check is a table of findings (plan_id, step or marker, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count
from .joins import cycle_groups

#: How plans are written.
STEP = r"(?i)###?\s*Step\s+(\d+)[:\s]"
FRONT = r"(?s)\A---\n(.*?)\n---"
VERSION = r"(?m)^format_version:[ \t]*(\d+)[ \t]*$"
FILE = r"\*\*File:\*\*\s*(NEW:\s*)?([^\s(]+)"
DEPENDS = r"(?i)\*\*Depends\s+on:?\*\*\s*([^\n]+)"
NO_DEPENDS = ["—", "-", "", "none", "n/a", "na"]
CAPABLE = r"(?i)\*\*Action:\*\*[^\n]*\[target:\s*capable\]"
EDIT = r"(?i)\*\*Action:\*\*\s*Edit\b"
ANCHOR, REPLACE, FENCE = r"(?s)```anchor\b(.*?)```", r"(?s)```replace\b(.*?)```", r"(?s)```.*?```"
CONJUNCTION = r"(?i)\*\*Action:\*\*[^\n]*\b(?:and|then|also|plus)\b"
DETAILS, AFTER_DETAILS = r"(?is)\*\*Details:\*\*(.*)\z", r"(?i)\n\*\*(?:Depends\s+on|Verify|Grounding|Action|File):"
COMPOUND_DETAILS = r"(?i)\band\s+then\b|\bthen\s+also\b|\bfirst\b[^.\n]{0,60}\bthen\b"
COMPOUND = [r"(?i)\band\s+then\b", r"(?i)\bthen\s+also\b", r"(?i)\bfirst.*then\b"]
FIELDS = ["File", "Action", "Details", "Verify", "Grounding"]
SECTIONS = {"Research Notes": r"(?i)##?\s*Research\s+Notes", "Files Verified": r"(?i)###?\s*Files\s+Verified", "Plan Steps": r"(?i)###?\s*Step\s+\d+:"}
VAGUE = [
    r"(?i)\bshould\b", r"(?i)\bprobably\b", r"(?i)\blikely\b", r"(?i)\bmaybe\b", r"(?i)\baround\s+line\s+\d+", r"(?i)\bsomewhere\s+in\b", r"(?i)\bI\s+think\b",
    r"(?i)\bI\s+believe\b", r"(?i)\bassume\b", r"(?i)\bmight\b", r"(?i)\bpossibly\b",
]
OPEN = [r"(?i)\bTBD\b", r"(?i)\bTBC\b", r"(?i)\bdecide\s+(?:at|during|in)\s+(?:review|impl\w*)\b", r"(?i)\beither\b[^.\n]{0,40}\bor\b", r"(?i)\bif\s+\w+[^.\n]{0,40}\bthen\b[^.\n]{0,40}\belse\b"]
CROSS_REFERENCES = {
    "as discussed": r"(?i)\bas\s+discussed\b", "as mentioned above": r"(?i)\bas\s+mentioned\s+above\b", "from before": r"(?i)\bfrom\s+before\b",
    "function from earlier": r"(?i)\bthe\s+function\s+from\s+earlier\b", "see above": r"(?i)\bsee\s+above\b",
}
DECISIONS, HEADING = r"(?im)^#{2,4}\s+Design Decisions\s*$", r"(?m)^#{1,6}\s+\S"
MASKED = [FENCE, "`[^`]*`", r'"[^"\n]*"']
NEGATION = r"(?i:\b(?:no|not|without|resolve[ds]?|avoid|never)\b)[^.\n]{0,12}"
MARKERS = {
    "TBD": r"\bTBD\b", "TODO": r"\bTODO\b", "FIXME": r"\bFIXME\b", "TBC": r"\bTBC\b", "???": r"\?\?\?", "deferred": r"(?i:\bdecide\s+(?:at|during|in)\s+(?:review|impl\w*)\b)",
    "either/or": r"(?i:\beither\b[^.\n]{0,40}\bor\b)", "option or": r"(?i:\boption\s+[A-Z]\b[^.\n]{0,40}\bor\b)", "if/then/else": r"(?i:\bif\s+\w+[^.\n]{0,40}\bthen\b[^.\n]{0,40}\belse\b)",
}
DESIGN, NEXT_SECTION, TAG = r"(?im)^##\s+Low-?Level Design\s*$", r"(?m)^##\s+\S", r"\[(NEW|EXISTING)\]"
CITATION, SYMBOL = r"/[\w.-]+\.[A-Za-z]{1,5}\b|[\w.-]+\.[A-Za-z]{1,5}:\d+", r"`(?:def |class |async def )?([A-Za-z_][\w.]*)"
#: Plans of epics, stories and subtasks, with what stories and subtasks must have.
LAYER_SECTIONS = {"Research Notes": SECTIONS["Research Notes"], "Epic Layer": r"(?i)##?\s*Epic\s+Layer", "Story Layer": r"(?i)##?\s*Story\s+Layer"}
STORY, SUBTASK = r"(?im)^###\s+Story\s+[\w.\-]+", r"(?m)^#####\s+[\w.\-]+"
STORY_FIELDS = [r"(?i)\*\*As\*\*", r"(?i)\*\*I want\*\*", r"(?i)\*\*So that\*\*", r"(?i)\*\*Acceptance Criteria:?\*\*"]
SUBTASK_FIELDS = [*(rf"(?i)\*\*{f}:\*\*" for f in FIELDS), r"(?i)\*\*Depends on:?\*\*"]
#: What a finding takes from a plan's score, and from which score on a model may do the plan.
PENALTIES = {"phantom": 0.15, "dependency": 0.10, "grounding": 0.05, "vague": 0.03, "anchors": 0.10, "uniqueness": 0.10, "unresolved": 0.07, "atomicity": 0.05}
SOFT = ("phantom", "dependency", "grounding", "vague")
READY = {"haiku": 0.95, "flash": 0.90, "cheap": 0.95, "capable": 0.75}


def plan_steps(plans: DataFrame) -> DataFrame:
    """plan_id, pos (from 1), step (its number as written), body (what follows the heading)."""
    numbers, parts = F.regexp_extract_all("text", F.lit(STEP), F.lit(1)), F.split("text", STEP, -1)
    each = F.zip_with(numbers, F.slice(parts, 2, F.size(parts) - 1), lambda n, b: F.struct(n.alias("step"), b.alias("body")))
    return plans.select("plan_id", F.posexplode(each).alias("at", "s")).select("plan_id", (F.col("at") + 1).alias("pos"), "s.step", "s.body")


def format_version(text: Column) -> Column:
    """The version that the front matter states; 1 where it states none or no number."""
    return F.coalesce(F.regexp_extract(F.regexp_extract(text, FRONT, 1), VERSION, 1).try_cast("int"), F.lit(1))


def step_path(body: Column) -> Column:
    """The path of a step's File field, without the marks around it."""
    path = F.regexp_extract(body, FILE, 2)
    for what in ("^`+|`+$", "^[\"']+|[\"']+$", "[.,;:]+$"):
        path = F.regexp_replace(path, what, "")
    return path


def is_new(body: Column) -> Column:
    return F.regexp_extract(body, FILE, 1) != ""


def details(body: Column) -> Column:
    return F.split(F.regexp_extract(body, DETAILS, 1), AFTER_DETAILS, 2)[0]


def phantom_files(steps: DataFrame, paths: DataFrame) -> DataFrame:
    """plan_id, step, path of steps whose file isn't there, or whose new file's folder isn't. Names without a folder and an extension are no paths."""
    named = steps.where(F.col("body").rlike(FILE)).select("plan_id", "pos", "step", step_path(F.col("body")).alias("path"), is_new(F.col("body")).alias("new"))
    old = named.where(~F.col("new") & F.col("path").contains("/") & F.element_at(F.split("path", "/"), -1).contains(".")).join(paths.select("path").distinct(), "path", "left_anti")
    parts = F.split("path", "/")
    folders = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder")).distinct()
    new = named.where(F.col("new") & F.col("path").contains("/")).withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).join(folders, "folder", "left_anti")
    return old.select("plan_id", "pos", "step", "path").unionByName(new.select("plan_id", "pos", "step", "path"))


def references(steps: DataFrame) -> DataFrame:
    """plan_id, pos, step, need: the numbers in each step's Depends-on field."""
    raw = F.trim(F.regexp_extract("body", DEPENDS, 1))
    return steps.where(~F.lower(raw).isin(*NO_DEPENDS)).select("plan_id", "pos", "step", F.explode(F.regexp_extract_all(raw, F.lit(r"(\d+)"), F.lit(1))).alias("need"))


def dangling_references(steps: DataFrame) -> DataFrame:
    known = steps.select("plan_id", F.col("step").alias("need")).distinct()
    return references(steps).join(known, ["plan_id", "need"], "left_anti").select("plan_id", "pos", "step", "need")


def plan_cycles(steps: DataFrame) -> DataFrame:
    """plan_id, step, first: steps of plans that depend on themselves by way of others, with the first step (as text) of each group that leads to each other. Of steps with one number
    the last counts; references to steps that a plan doesn't have lead nowhere."""
    last = steps.groupBy("plan_id", "step").agg(F.max("pos").alias("pos"))
    edges = references(steps).join(last, ["plan_id", "step", "pos"], "left_semi").select("plan_id", "step", F.array("need").alias("needs"))
    return cycle_groups(edges)


def dependency_errors(steps: DataFrame) -> DataFrame:
    """plan_id, step, need: references to steps that aren't there, and `(cycle)` once for each group of steps that depend on each other."""
    circles = plan_cycles(steps).select("plan_id", F.col("first").alias("step"), F.lit("(cycle)").alias("need")).distinct()
    return dangling_references(steps).select("plan_id", "step", "need").unionByName(circles)


def vague_references(steps: DataFrame) -> DataFrame:
    """plan_id, pos, step, phrase: references that say nothing outside their context, each once a step."""
    found = F.array_compact(F.array(*[F.when(F.col("body").rlike(p), name) for name, p in CROSS_REFERENCES.items()]))
    return steps.select("plan_id", "pos", "step", F.explode(found).alias("phrase"))


def missing_fields(steps: DataFrame) -> DataFrame:
    gone = F.array_compact(F.array(*[F.when(~F.col("body").rlike(rf"(?i)\*\*{f}:\*\*"), f) for f in FIELDS]))
    return steps.select("plan_id", "pos", "step", F.explode(gone).alias("field"))


def missing_sections(plans: DataFrame) -> DataFrame:
    gone = F.array_compact(F.array(*[F.when(~F.col("text").rlike(p), name) for name, p in SECTIONS.items()]))
    return plans.select("plan_id", F.explode(gone).alias("section"))


def edit_anchors(steps: DataFrame) -> DataFrame:
    """plan_id, pos, step, issue of edits that lack one anchor that isn't empty and one replacement."""
    anchors, replaced = F.regexp_extract_all("body", F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all("body", F.lit(REPLACE), F.lit(1))
    issue = F.when((F.size(anchors) != 1) | (F.size(replaced) != 1), "blocks").when(~anchors[0].rlike(r"\S"), "empty")
    return steps.where(F.col("body").rlike(EDIT) & ~F.col("body").rlike(CAPABLE)).select("plan_id", "pos", "step", issue.alias("issue")).where("issue is not null")


def anchor_uniqueness(steps: DataFrame, files: DataFrame) -> DataFrame:
    """plan_id, pos, step, path, n of edits whose anchor is in its file (path, code) not at all or more than once."""
    anchors = F.regexp_extract_all("body", F.lit(ANCHOR), F.lit(1))
    asked = steps.where(F.col("body").rlike(EDIT) & ~F.col("body").rlike(CAPABLE) & (F.size(anchors) == 1) & F.col("body").rlike(FILE) & ~is_new(F.col("body")))
    asked = asked.select("plan_id", "pos", "step", step_path(F.col("body")).alias("path"), F.regexp_replace(anchors[0], r"\A\n+|\n+\z", "").alias("anchor")).where(F.col("anchor").rlike(r"\S"))
    n = ((F.length("code") - F.length(F.replace("code", F.col("anchor"), F.lit("")))) / F.length("anchor")).cast("int")
    return asked.join(files.select("path", "code"), "path").select("plan_id", "pos", "step", "path", n.alias("n")).where("n <> 1")


def atomicity(steps: DataFrame) -> DataFrame:
    """plan_id, pos, step, issue: several files, several actions, or several things in the details. Steps for capable models are exempt."""
    prose = F.regexp_replace(details(F.col("body")), FENCE, " ")
    found = F.array_compact(F.array(
        F.when(count(F.col("body"), r"\*\*File:\*\*") > 1, "files"), F.when(F.col("body").rlike(CONJUNCTION), "action"), F.when(prose.rlike(COMPOUND_DETAILS), "details")
    ))
    return steps.where(~F.col("body").rlike(CAPABLE)).select("plan_id", "pos", "step", F.explode(found).alias("issue"))


def unresolved_decisions(plans: DataFrame, steps: DataFrame) -> DataFrame:
    """plan_id, marker, once each: markers of open decisions in the section on decisions and in steps' details, outside code and
    quotes and not after a negation on their line."""
    section = F.when(F.col("text").rlike(DECISIONS), F.split(F.split("text", DECISIONS, 2)[1], HEADING, 2)[0])
    segments = plans.select("plan_id", section.alias("part")).where("part is not null").unionByName(steps.select("plan_id", details(F.col("body")).alias("part")))
    masked = F.col("part")
    for what in MASKED:
        masked = F.regexp_replace(masked, what, " ")
    found = F.array_compact(F.array(*[F.when(F.regexp_replace(masked, NEGATION + f"(?:{p})", " ").rlike(p), name) for name, p in MARKERS.items()]))
    return segments.select("plan_id", F.explode(found).alias("marker")).distinct()


def design_gaps(plans: DataFrame) -> DataFrame:
    """plan_id, interface, tag: interfaces said to exist without a citation, and new ones that no step names. Advice only."""
    section = F.when(F.col("text").rlike(DESIGN), F.split(F.split("text", DESIGN, 2)[1], NEXT_SECTION, 2)[0])
    parts = F.split("text", STEP, -1)
    said = plans.select("plan_id", F.array_join(F.slice(parts, 2, F.size(parts)), "\n").alias("steps"), F.explode(F.split(section, "\n")).alias("line")).where(F.col("line").rlike(TAG))
    tag, symbol = F.regexp_extract("line", TAG, 1), F.regexp_extract("line", SYMBOL, 1)
    old = (tag == "EXISTING") & ~F.col("line").rlike(CITATION)
    new = (tag == "NEW") & (symbol != "") & ~F.contains("steps", symbol)
    return said.where(old | new).select("plan_id", F.when(old, F.substring(F.trim("line"), 1, 80)).otherwise(symbol).alias("interface"), tag.alias("tag"))


def plan_scores(plans: DataFrame, model: str = "haiku") -> DataFrame:
    """plan_id, clarity, completeness, grounding, atomicity, overall, ready. Steps' fields are counted in the plan's own row: no shuffle."""
    zero = F.lit(0)
    yes = lambda c: F.when(c, 1).otherwise(0)
    vague = sum((count(F.col("text"), p) for p in VAGUE + OPEN), zero)
    sections = sum((yes(~F.col("text").rlike(p)) for p in SECTIONS.values()), zero)
    parts = F.split("text", STEP, -1)
    fields = F.aggregate(F.slice(parts, 2, F.size(parts)), zero, lambda a, b: a + sum((yes(~b.rlike(rf"(?i)\*\*{f}:\*\*")) for f in FIELDS), zero))
    compound = sum((yes(F.col("text").rlike(p)) for p in COMPOUND), zero)
    n = plans.select("plan_id", vague.alias("vague"), sections.alias("sections"), (fields + compound).alias("steps"), compound.alias("compound"))
    score = lambda c, penalty: F.greatest(F.lit(0.0), 1.0 - F.col(c) * penalty)
    each = n.select("plan_id", score("vague", 0.1).alias("clarity"), score("sections", 0.25).alias("completeness"), score("steps", 0.1).alias("grounding"), score("compound", 0.2).alias("atomicity"), (F.col("vague") + F.col("sections") + F.col("steps") == 0).alias("clean"))
    overall = F.col("clarity") * 0.25 + F.col("completeness") * 0.25 + F.col("grounding") * 0.30 + F.col("atomicity") * 0.20
    return each.withColumn("overall", overall).withColumn("ready", F.col("clean") & (F.col("overall") >= READY.get(model, 0.9))).drop("clean")


def layered_plan_scores(plans: DataFrame, model: str = "haiku") -> DataFrame:
    """The same columns for plans of epics, stories and subtasks: vague words, missing sections, and fields that stories and subtasks lack. A
    story reaches as far as the next story, a subtask as far as the next subtask. All is counted in the plan's own row: no shuffle."""
    yes = lambda c: F.when(c, 1).otherwise(0)

    def lacking(heading: str, fields: list[str]) -> Column:
        parts = F.split("text", heading, -1)
        return F.aggregate(F.slice(parts, 2, F.size(parts)), F.lit(0), lambda n, part: n + sum((yes(~part.rlike(f)) for f in fields), F.lit(0)))

    vague = sum((count(F.col("text"), p) for p in VAGUE + OPEN), F.lit(0))
    sections = sum((yes(~F.col("text").rlike(p)) for p in LAYER_SECTIONS.values()), F.lit(0))
    n = plans.select("plan_id", vague.alias("v"), sections.alias("s"), (lacking(STORY, STORY_FIELDS) + lacking(SUBTASK, SUBTASK_FIELDS)).alias("f"))
    score = lambda c, penalty: F.greatest(F.lit(0.0), 1.0 - F.col(c) * penalty)
    each = n.select("plan_id", score("v", 0.1).alias("clarity"), score("s", 0.25).alias("completeness"), score("f", 0.05).alias("grounding"), F.lit(1.0).alias("atomicity"), (F.col("v") + F.col("s") + F.col("f") == 0).alias("clean"))
    overall = F.col("clarity") * 0.25 + F.col("completeness") * 0.25 + F.col("grounding") * 0.30 + F.col("atomicity") * 0.20
    return each.withColumn("overall", overall).withColumn("ready", F.col("clean") & (F.col("overall") >= READY.get(model, 0.9))).drop("clean")


def verify(plans: DataFrame, files: DataFrame) -> DataFrame:
    """plan_id, version, a count for each kind of finding, coverage (1 less the penalties, 0 at least), verified. Plans of a version
    below 2 are held to the first four kinds alone."""
    steps = plan_steps(plans)
    found = {
        "phantom": phantom_files(steps, files), "dependency": dependency_errors(steps), "grounding": missing_fields(steps).where("field = 'Grounding'"), "vague": vague_references(steps),
        "anchors": edit_anchors(steps), "uniqueness": anchor_uniqueness(steps, files), "unresolved": unresolved_decisions(plans, steps), "atomicity": atomicity(steps),
    }
    kinds = None
    for name, table in found.items():
        one = table.select("plan_id", F.lit(name).alias("kind"))
        kinds = one if kinds is None else kinds.unionByName(one)
    counts = kinds.groupBy("plan_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in found])
    out = plans.select("plan_id", format_version(F.col("text")).alias("version")).join(counts, "plan_id", "left").fillna(0, list(found))
    held = {k: F.when((F.col("version") >= 2) | F.lit(k in SOFT), F.col(k)).otherwise(0) for k in found}
    lost = sum((held[k] * p for k, p in PENALTIES.items()), F.lit(0.0))
    return out.withColumn("coverage", F.greatest(F.lit(0.0), 1.0 - lost)).withColumn("verified", sum(held.values(), F.lit(0)) == 0)
