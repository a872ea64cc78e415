"""TypeScript and JavaScript by their brackets: blocks, functions and hooks from paired brackets, without a parser and without a join of all pairs.

Literals and comments are blanked, the rest is cut behind each bracket, and a running depth numbers the brackets of a file. Of the brackets of one depth, each
opener is followed by its closer, so one window pairs them; what a block is, is told by the text before its bracket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..places import dealt

SCRIPTS = ("typescript", "javascript")
# What stands before the brackets of functions, conditional blocks and hooks, and after parameters.
LINE_START = r"(?:\A|\n)[ \t]*(?:export\s+)?"
DECLARED = LINE_START + r"(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\z"
ARROW = LINE_START + r"(?:const|let|var)\s+(\w+)\s*(?::[^=\n;]+)?=\s*(?:async\s+)?\z"
BARE_ARROW = LINE_START + r"(?:const|let|var)\s+(\w+)\s*(?::[^=\n;]+)?=\s*(?:async\s+)?[A-Za-z_]\w*\s*=>\s*\z"
TYPED, TYPE_LITERAL, ARROW_BODY = r"\A\s*:", r"\A\s*:\s*\z", r"=>\s*\z"
CONDITION, ELSE = r"\b(?:if|for|while|switch)\s*\z", r"\belse\s*\z"
HOOK = r"\b(use[A-Z]\w*)\s*(?:<[^>]*>)?\s*\z"
REACT = r"from ['\"]react['\"]|require\('react'\)"
COMMENT_LINE = r"^\s*(?://|/\*|\*)"


def by_file(*more: str) -> Window:
    return Window.partitionBy("file_id", *more).orderBy("seq")


def _said(whole: Column, ch: Column) -> Column:
    """What the text between two brackets says, so that the text itself need not be dealt, sorted and handed on: names of functions, and how many lines above the bracket each stands, a hook's
    call, what it ends with, and what it begins with. Behind the last bracket only the beginning matters."""
    gap = F.when(ch == "", "").otherwise(whole)
    name = lambda pattern: F.regexp_extract(gap, pattern, 1)
    above = lambda pattern: text.newlines(F.ltrim(F.regexp_extract(gap, pattern, 0), F.lit("\n")))
    return F.struct(
        name(DECLARED).alias("declared"), above(DECLARED).alias("declared_above"), name(ARROW).alias("arrow"), above(ARROW).alias("arrow_above"), name(BARE_ARROW).alias("bare"), above(BARE_ARROW).alias("bare_above"),
        name(HOOK).alias("hook"), text.newlines(F.regexp_extract(gap, HOOK, 0)).alias("hook_above"), gap.rlike(ARROW_BODY).alias("arrow_body"), gap.rlike(CONDITION).alias("condition"), gap.rlike(ELSE).alias("otherwise"),
        (F.trim(gap, F.lit(" \t\n\r")) == "").alias("blank"), whole.rlike(TYPED).alias("typed"), whole.rlike(TYPE_LITERAL).alias("type_literal"), text.newlines(whole).alias("breaks"),
    )


def events(files: DataFrame) -> DataFrame:
    """The brackets of each script: file_id, lang, react, seq, ch, gap (what the text between the bracket before and this one says; see _said), line, kind, level. Brackets of a pair have
    one kind and level. What follows the last bracket is the gap of an event without one. Texts stay in the task that read them."""
    code = F.concat(text.masked(F.col("code"), F.col("lang")), F.lit("("))
    scripts = files.where(F.col("lang").isin(*SCRIPTS) & F.col("code").isNotNull())
    cut = lambda f: F.transform(f["parts"], lambda p, i: F.struct(i.alias("seq"), p.alias("part"), F.size(f["parts"]).alias("n"), f["react"].alias("react")))
    parts = F.struct(F.col("code").rlike(REACT).alias("react"), F.regexp_extract_all(code, F.lit(r"[^{}()]*+[{}()]"), F.lit(0)).alias("parts"))
    each = scripts.select("file_id", "lang", F.explode(text.bound(parts, cut)).alias("p")).select("file_id", "lang", "p.*")
    ch = F.when(F.col("seq") == F.col("n") - 1, "").otherwise(F.substring("part", F.length("part"), F.lit(1)))
    gap = F.substring("part", F.lit(1), F.length("part") - 1)
    each = dealt(each.select("file_id", "lang", "react", "seq", ch.alias("ch"), text.bound(gap, lambda g: _said(g, ch)).alias("gap")), scripts, F.regexp_count("code", F.lit("[{}()]")) + 1)
    kind = F.when(F.col("ch").isin("{", "}"), "{").when(F.col("ch").isin("(", ")"), "(")
    step = F.when(F.col("ch").isin("{", "("), 1).when(F.col("ch").isin("}", ")"), -1).otherwise(0)
    so_far = by_file().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("kind", kind).withColumn("line", (F.sum("gap.breaks").over(so_far) + 1).cast("int"))
    depth = F.when(kind == "{", F.sum(F.when(kind == "{", step).otherwise(0)).over(so_far)).otherwise(F.sum(F.when(kind == "(", step).otherwise(0)).over(so_far))
    return each.withColumn("level", F.when(F.col("kind").isNotNull(), depth + F.when(step < 0, 1).otherwise(0)).cast("int"))


def paired(found: DataFrame) -> DataFrame:
    """events with `next` (ch of the event after, and what its gap begins with), for openers `close` (line and next of their closer), for closers `head` and `head_line` (their opener's gap and line)."""
    pair, opens = by_file("kind", "level"), F.col("ch").isin("{", "(")
    ahead = found.withColumn("next", F.lead(F.struct("ch", "gap.typed", "gap.type_literal")).over(by_file()))
    return ahead.withColumn("close", F.when(opens, F.lead(F.struct("line", "next")).over(pair))).withColumn("head", F.when(~opens, F.lag("gap").over(pair))).withColumn("head_line", F.when(~opens, F.lag("line").over(pair)))


def told(files: DataFrame) -> DataFrame:
    """Paired events of scripts with what stands behind them: `function` (name, declared, line, typed; null if none) at the opener of a named function's block, or at the closer of the
    parameters of one without a block, and `conditions`, `functions`: how many conditional blocks and functions are open there, `asked`: right behind a condition.

    A block belongs to what its opener follows: the parameters of a declaration or of an arrow function with a name, or a return type that is one literal behind these. Braces in the types
    of parameters, and such return types, are no blocks."""
    each = paired(events(files))
    each = each.withColumn("before", F.lag(F.struct("ch", "head", "head_line")).over(by_file()))
    pair = by_file("kind", "level")
    # what a closer hands on: the text and line before the brackets of parameters, also past a return type in braces
    literal = (F.col("ch") == "{") & (F.col("before.ch") == ")") & F.col("gap.type_literal")
    passed = F.lag(F.when(literal, F.struct(F.col("before.head").alias("head"), F.col("before.head_line").alias("head_line")))).over(pair)
    each = each.withColumn("literal", F.coalesce(literal, F.lit(False))).withColumn("passed", F.when(F.col("ch") == "}", passed))
    each = each.withColumn("params", F.when(F.col("ch") == ")", F.struct("head", "head_line")).otherwise(F.col("passed"))).withColumn("prior", F.lag("params").over(by_file()))
    named = lambda head: F.coalesce(F.col(head), F.lit(""))
    declared, arrow, bare = named("prior.head.declared"), F.when(F.col("gap.arrow_body"), named("prior.head.arrow")).otherwise(""), F.col("gap.bare")
    opens = (F.col("ch") == "{") & ~F.col("literal")
    typed = F.col("gap.typed") | (F.col("before.ch") == "}")

    def function(name: Column, declared: bool, above: str, line: Column, typed: Column) -> Column:
        at = line - F.coalesce(F.col(above), F.lit(0))
        return F.struct(name.alias("name"), F.lit(declared).alias("declared"), at.cast("int").alias("line"), F.coalesce(typed, F.lit(False)).alias("typed"))

    own = named("params.head.declared")
    follows = F.col("next.ch") == "{"
    past = F.lead(F.when(F.col("literal"), F.col("close.next.ch"))).over(by_file())
    each = each.withColumn("past", past)
    without = (F.col("ch") == ")") & (own != "") & ~F.coalesce(follows & (~F.col("next.type_literal") | (F.col("past") == "{")), F.lit(False))
    found = (
        F.when(opens & (declared != ""), function(declared, True, "prior.head.declared_above", F.col("prior.head_line"), typed)).when(opens & (arrow != ""), function(arrow, False, "prior.head.arrow_above", F.col("prior.head_line"), typed))
        .when(opens & (bare != ""), function(bare, False, "gap.bare_above", F.col("line"), F.lit(False))).when(without, function(own, True, "params.head.declared_above", F.col("params.head_line"), F.col("next.typed")))
    )
    asked = F.coalesce((F.col("before.ch") == ")") & F.col("before.head.condition"), F.lit(False))
    conditional = (F.col("ch") == "{") & (F.col("gap.otherwise") | F.col("gap.blank") & asked)
    each = each.withColumn("function", found).withColumn("asked", asked)
    each = each.withColumn("opens", F.struct(conditional.cast("int").alias("condition"), ((F.col("ch") == "{") & F.col("function").isNotNull()).cast("int").alias("function")))
    each = each.withColumn("opener", F.when(F.col("ch") == "}", F.lag("opens").over(pair)))
    so_far = by_file().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = lambda what: F.sum(F.col(f"opens.{what}") - F.coalesce(F.col(f"opener.{what}"), F.lit(0))).over(so_far)
    return each.withColumn("conditions", inside("condition")).withColumn("functions", inside("function")).withColumn("last", F.max("line").over(Window.partitionBy("file_id")))


def measured(each: DataFrame) -> DataFrame:
    """told() as rows of two kinds: functions with line, length and nesting, and hooks with their rules. One stream: nothing is joined.

    Nesting: at each level that has functions, an opener lies in the last opener of that level before it, so that it counts once for each such level up to its own."""
    block = (F.col("ch") == "{") & F.col("function").isNotNull()
    each = each.withColumn("levels", F.collect_set(F.when(block, F.col("level"))).over(Window.partitionBy("file_id")))
    rules = F.array_compact(F.array(F.when((F.col("conditions") > 0) | F.col("asked"), "REACT001"), F.when(F.col("functions") > 1, "REACT002")))
    hook = F.col("gap.hook")
    is_hook = (F.col("ch") == "(") & F.col("react") & (hook != "") & (F.size(rules) > 0)
    alone = (F.col("ch") == ")") & F.col("function").isNotNull()
    none = F.array().cast("array<int>")
    at = F.when(F.col("ch") == "{", F.filter("levels", lambda x: x <= F.col("level"))).when(is_hook | alone, F.array(F.lit(None).cast("int"))).otherwise(none)
    rows = each.select(
        "file_id", "lang", "seq", "level", "line", "ch", "function", "last", F.col("close.line").alias("closed"), F.when(is_hook, rules).alias("rules"), F.when(is_hook, hook).alias("hook"),
        F.when(is_hook, F.col("line") - F.col("gap.hook_above")).cast("int").alias("hook_line"), F.explode(at).alias("at"),
    )
    own = F.col("at").isNull() | (F.col("level") == F.col("at"))
    so_far = Window.partitionBy("file_id", "at").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("outer", F.last(F.when(own, F.col("seq")), True).over(so_far))
    said = F.when(own, F.struct("lang", "line", "ch", "function", "last", "closed", "rules", "hook", "hook_line"))
    return inside.groupBy("file_id", "at", "outer").agg(F.max(F.coalesce(F.col("level") - F.col("at"), F.lit(0))).alias("nesting"), F.max_by(said, said.isNotNull()).alias("s")).select("file_id", "nesting", "s.*")


def functions(files: DataFrame) -> DataFrame:
    """Functions declared at the start of a line, and arrow functions with a block that get a name there: file_id, lang, name, declared, line, length in lines, nesting
    (the most braces open at once inside the block), typed (a return type follows the parameters). A block that is never closed reaches to the end of the file; a function
    without a block is as long as its parameters."""
    end = F.when(F.col("ch") == ")", F.col("line")).otherwise(F.coalesce("closed", "last"))
    return measured(told(files)).where("function is not null").select("file_id", "lang", "function.name", "function.declared", "function.line", (end - F.col("function.line") + 1).cast("int").alias("length"), "nesting", "function.typed")


def long_scripts(files: DataFrame, most: int = 300) -> DataFrame:
    """file_id, lines of scripts with more than `most` lines that are neither blank nor comments."""
    rows = F.filter(F.split("code", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(COMMENT_LINE))
    return files.where(F.col("lang").isin(*SCRIPTS)).select("file_id", F.size(rows).alias("lines")).where(F.col("lines") > most)


def findings(files: DataFrame, longest: int = 30, deepest: int = 4) -> DataFrame:
    """file_id, rule_id, line, name of scripts' functions of over `longest` lines (TSARCH001), declared functions that nest deeper than `deepest` (003) or, in TypeScript and without
    an underscore before their name, have no return type (004), and of calls of hooks, in files that import React, that stand in a conditional block or loop or right behind a
    condition (REACT001) or in a named function within another (002)."""
    end = F.when(F.col("ch") == ")", F.col("line")).otherwise(F.coalesce("closed", "last"))
    f = F.col("function")
    rules = F.array_compact(F.array(
        F.when(end - f["line"] + 1 > longest, "TSARCH001"), F.when(f["declared"] & (F.col("nesting") > deepest), "TSARCH003"),
        F.when(f["declared"] & (F.col("lang") == "typescript") & ~f["typed"] & ~f["name"].startswith("_"), "TSARCH004"),
    ))
    each = measured(told(files)).select("file_id", F.coalesce(f["line"], F.col("hook_line")).alias("line"), F.coalesce(f["name"], F.col("hook")).alias("name"), F.coalesce("rules", F.when(f.isNotNull(), rules)).alias("rules"))
    return each.select("file_id", F.explode("rules").alias("rule_id"), "line", "name")


def structure(files: DataFrame, longest: int = 30, deepest: int = 4, most_lines: int = 300) -> DataFrame:
    """file_id, rule_id, line, name of functions (see findings), and of files of over `most_lines` lines (TSARCH002)."""
    long = long_scripts(files, most_lines).select("file_id", F.lit("TSARCH002").alias("rule_id"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("name"))
    return findings(files, longest, deepest).where("rule_id like 'TSARCH%'").unionByName(long)


def misplaced_hooks(files: DataFrame) -> DataFrame:
    """file_id, rule_id, line, hook (see findings)."""
    return findings(files).where("rule_id like 'REACT%'").select("file_id", "rule_id", "line", F.col("name").alias("hook"))
