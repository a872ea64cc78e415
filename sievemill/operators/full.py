"""The full scan: all rules and checks in three passes over the files. What a file's own row tells is worked out in that row, without a shuffle; lines are dealt once, and every check that
looks around a line is an expression over windows of them; brackets of scripts are dealt once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.catalogue import RULES, TEST_FREE, Rule
from ..functions.text import bound
from ..places import dealt
from . import brackets, lines, scan
from . import checks as k

# Calls and defaults as a parser would see them, which replace the patterns of the same ids in Python.
CHECKED = [
    Rule("PY001", "python", "no-eval", r"(?:\.\s*|\bdef\s+)?\beval\s*\(", "error", r"^(?:\.|def)"),
    Rule("PY002", "python", "no-exec", r"(?:\.\s*|\bdef\s+)?\bexec\s*\(", "error", r"^(?:\.|def)"),
    Rule("PY003", "python", "no-bare-except", r"\bexcept\s*:", "error"),
    Rule("PY004", "python", "no-mutable-default", r"def\s+\w+\s*\([^)]*=\s*(?:\[|\{|[A-Za-z_][\w.]*\s*\()", "error"),
]
#: Checks by patterns that count once a line, whatever pattern it was.
ONCE_A_LINE = {"AI007": k.THEATRE, "AI008": k.INJECTION, "PERF004": k.UNBOUNDED}
#: Limits of length and depth.
LONG_FUNCTION, LONG_FILE, DEEP = 30, 300, 4
HIT = "struct<rule_id:string,finds:array<struct<found:array<string>,parts:array<string>,unless:string>>,at:array<int>>"


def replaced_rules(rules: Iterable[Rule] = RULES) -> list[Rule]:
    ids = {r.id for r in CHECKED}
    return [r for r in rules if r.id not in ids] + CHECKED


# -- what a file's own row tells -----------------------------------------------------------------------------


def _find(rule: Rule) -> Column:
    code = F.col("code")
    return text.when_all(scan.conditions(rule, F.col("test")), F.struct(F.regexp_extract_all(code, F.lit(rule.regex), F.lit(0)).alias("found"), F.split(code, rule.regex, -1).alias("parts"), F.lit(rule.unless).alias("unless")))


def _pattern_hit(rule_id: str, rules: list[Rule]) -> Column:
    finds = F.array_compact(F.array(*map(_find, rules)))
    return F.struct(F.lit(rule_id).alias("rule_id"), finds.alias("finds"), F.lit(None).cast("array<int>").alias("at")).cast(HIT)


def _at(rule_id: str, found: Column) -> Column:
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(None).cast("array<struct<found:array<string>,parts:array<string>,unless:string>>").alias("finds"), found.cast("array<int>").alias("at")).cast(HIT)


def _first_line(where: Column) -> Column:
    return F.when(where, F.array(F.lit(1)))


def _starts(found: Column, where) -> Column:
    return F.transform(F.filter(found, where), lambda d: d["start"])


def dead_import_lines(rows: Column, masked: Column, code: Column) -> Column:
    """(line, name) of the names that a Python file imports at its outer level and never uses outside literals and comments; names in __all__ are used."""
    plain, source = r"^import\s+([\w., ]+)$", r"^from\s+[\w.]+\s+import\s+([\w, ]+)$"
    bare = lambda t: F.regexp_replace(t, r"\s*#.*$", "")

    def names(t: Column, i: Column) -> Column:
        said = F.when(t.rlike(plain), F.regexp_extract(t, plain, 1)).when(t.rlike(source) & ~t.rlike(r"^from\s+__future__"), F.regexp_extract(t, source, 1))
        name = lambda n: F.when(n.rlike(r"\sas\s"), F.regexp_extract(n, r"\sas\s+(\w+)", 1)).when(t.rlike(plain), F.split_part(F.trim(n), F.lit("."), F.lit(1))).otherwise(F.trim(n))
        return F.when(said.isNotNull(), F.transform(F.split(said, ","), lambda n: F.struct((i + 1).alias("line"), name(n).alias("name"))))

    imported = F.flatten(F.array_compact(F.transform(F.transform(rows, bare), names)))
    rest = F.array_join(F.filter(masked, lambda t: ~F.rtrim(t).rlike(plain) & ~F.rtrim(t).rlike(source)), "\n")
    exported = F.regexp_extract_all(F.regexp_extract(code, r"(?m)^__all__\s*\+?=\s*[\[(]([^\])]*)[\])]", 1), F.lit(r"([A-Za-z_]\w*)"), F.lit(1))
    used = F.array_union(F.regexp_extract_all(rest, F.lit(r"([A-Za-z_]\w*)"), F.lit(1)), exported)

    def unused(both: Column) -> Column:
        left = F.array_except(F.transform(both["said"], lambda n: n["name"]), both["used"])
        return bound(left, lambda names: F.filter(both["said"], lambda n: (n["name"] != "") & F.array_contains(names, n["name"])))

    return bound(F.struct(imported.alias("said"), used.alias("used")), unused)


def dead_imports(files: DataFrame) -> DataFrame:
    """file_id, line, name (see dead_import_lines) of Python files."""
    masked = F.split(text.masked(F.col("code"), F.col("lang")), "\n")
    return files.where("lang = 'python'").select("file_id", F.explode(dead_import_lines(F.split("code", "\n"), masked, F.col("code"))).alias("d")).select("file_id", "d.line", "d.name")


def _classes(rows: Column) -> Column:
    """Lines of abstract classes with one subclass in the file, and of classes of over five type parameters."""
    found = F.filter(F.transform(rows, lambda t, i: F.when(t.rlike(k.CLASS), F.struct((i + 1).alias("line"), F.regexp_extract(t, k.CLASS, 1).alias("name"), F.regexp_extract(t, k.CLASS, 2).alias("bases")))), lambda c: c.isNotNull())

    def lone(classes: Column) -> Column:
        heirs = F.flatten(F.transform(classes, lambda c: F.array_distinct(F.regexp_extract_all(c["bases"], F.lit(r"(\w+)"), F.lit(1)))))
        alone = lambda c: c["bases"].rlike(r"\bABC\b") & (F.size(F.filter(heirs, lambda h: h == c["name"])) == 1)
        wide = lambda c: F.size(F.split(F.regexp_extract(c["bases"], r"\[([^\]]+)\]", 1), ",")) > 5
        return F.concat(F.transform(F.filter(classes, alone), lambda c: c["line"]), F.transform(F.filter(classes, wide), lambda c: c["line"]))

    return bound(found, lone)


def _heavy(code_lines: Column) -> Column:
    """Lines of imports of heavy libraries that the file names at most twice besides, in a trivial way."""

    def one(library: str, trivial: str) -> Column:
        at = F.array_min(F.filter(F.transform(code_lines, lambda t, i: F.when(t.rlike(rf"^(?:import\s+{library}|from\s+{library}\s+import)\b"), i + 1)), lambda x: x.isNotNull()))
        named = F.aggregate(code_lines, F.lit(0), lambda n, t: n + F.regexp_count(t, F.lit(rf"\b{library}\b")))
        return F.when((named <= 3) & F.exists(code_lines, lambda t: t.rlike(trivial)), at)

    return F.array_compact(F.array(*[one(*x) for x in k.HEAVY.items()]))


def _python_checks(rows: Column, functions: Column) -> list[Column]:
    py, test = F.col("lang") == "python", F.col("test")
    code_lines = F.transform(rows, lambda t: F.when(F.ltrim(t).rlike("^(?:#|//)"), "").otherwise(t))
    masked = F.split(text.masked(F.col("code"), F.col("lang")), "\n")
    made = lambda d: F.regexp_extract_all(d["body"], F.lit(r"return\s+(\w+)\s*\("), F.lit(1))
    factory = lambda d: d["name"].rlike("^(?:create_|make_|build_|get_)") & (F.size(made(d)) >= 2) & (F.size(F.array_distinct(made(d))) == 1)
    tests = lambda where: F.when(py & test, _starts(functions, lambda d: d["name"].startswith("test_") & where(d["body"])))
    empty = lambda b: b.rlike(r"\A(?:pass|\.\.\.)?\z")
    hashed = F.array_sort(F.transform(F.filter(functions, lambda d: d["name"].startswith("test_") & (d["body"] != "")), lambda d: F.struct(F.md5(d["body"]).alias("hash"), d["start"].alias("line"))))
    named = F.filter(functions, lambda d: d["name"].startswith("test_"))
    edge = F.exists(named, lambda d: F.lower(d["name"]).rlike("|".join(k.EDGE_WORDS)))
    real = F.size(F.filter(rows, lambda t: (F.trim(t) != "") & ~F.ltrim(t).startswith("#")))
    return [
        _at("PY014", F.when(py, F.array_distinct(F.transform(dead_import_lines(rows, masked, F.col("code")), lambda d: d["line"])))),
        _at("AI003", F.when(py, F.concat(_classes(code_lines), _starts(functions, factory)))),
        _at("AI006", F.when(py, _heavy(code_lines))),
        _at("ARCH001", _starts(functions, lambda d: d["stop"] - d["start"] + 1 > LONG_FUNCTION)), _at("ARCH002", _first_line(py & (real > LONG_FILE))), _at("ARCH004", _starts(functions, lambda d: d["depth"] > DEEP)),
        _at("TEST001", tests(empty)), _at("TEST002", tests(lambda b: b.rlike(r"\Aassert True\z"))), _at("TEST003", tests(lambda b: ~empty(b) & ~b.rlike(k.ASSERTION))),
        _at("TEST006", F.when(py & test, bound(hashed, lines.repeats))), _at("TEST007", _first_line(py & test & (F.size(named) >= 3) & ~edge)),
        _at("TEST009", tests(lambda b: b.rlike(r"(?m)^(?:global|nonlocal)\s"))),
        _at("TEST010", tests(lambda b: b.rlike(r"pytest\.raises\s*\(\s*Exception\s*\)|assertRaises\s*\(\s*Exception\s*\)"))),
    ]


def _script_checks(rows: Column) -> list[Column]:
    script, next_ = F.col("lang").isin(*brackets.SCRIPTS), F.col("code").rlike("from ['\"]next")
    real = F.size(F.filter(rows, lambda t: (F.trim(t) != "") & ~t.rlike(brackets.COMMENT_LINE)))
    client = F.exists(rows, lambda t: ~F.ltrim(t).rlike("^(?:#|//)") & F.trim(t).rlike(k.CLIENT_APIS) & ~F.trim(t).rlike(r"^(?:import |from |/\*)"))
    return [_at("TSARCH002", _first_line(script & (real > LONG_FILE))), _at("NEXT001", _first_line(script & next_ & ~F.col("code").rlike(k.USE_CLIENT) & client))]


def file_findings(files: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """file_id, rule_id, line of the rules, of the checks by pattern, and of what functions, classes and imports of a file tell. Nothing is shuffled."""
    rows = F.split("code", "\n")
    table = files.where(F.trim("code") != "").select("file_id", "lang", "code", F.lower("code").alias("_lower"), scan.is_test(F.col("code")).alias("test"))
    hits = [_pattern_hit(r.id, [r]) for r in rules] + [_pattern_hit(i, group) for i, group in ONCE_A_LINE.items()]
    functions = lambda r: F.when(F.col("lang") == "python", lines.function_list(r)).otherwise(F.array().cast("array<struct<name:string,start:int,stop:int,body:string,depth:int>>"))
    own = lambda r: bound(functions(r), lambda f: F.array(*_python_checks(r, f), *_script_checks(r), _at("AI004", lines.repeated_blocks(r))))
    told = table.select("file_id", text.skip_spans(F.col("code"), F.col("lang")).alias("spans"), F.concat(F.array(*hits), bound(rows, own)).alias("hits"))
    each = told.select("file_id", "spans", F.explode(F.filter("hits", lambda h: (F.size(h["finds"]) > 0) | (F.size(h["at"]) > 0))).alias("h"))
    real = lambda f: F.filter(text.placed(f["parts"], f["found"]), lambda m: ~text.in_skip(m["start"], F.col("spans")) & ((f["unless"] == "") | ~F.rlike(m["match"], f["unless"])))
    placed = F.flatten(F.transform("h.finds", lambda f: F.transform(real(f), lambda m: m["line"])))
    once = F.when(F.col("h.rule_id").isin(*ONCE_A_LINE), F.array_distinct(placed)).otherwise(placed)
    return each.select("file_id", "h.rule_id", F.explode(F.coalesce("h.at", once)).alias("line"))


# -- what lines tell ------------------------------------------------------------------------------------------


def line_findings(files: DataFrame) -> DataFrame:
    """file_id, rule_id, line of the checks that look around a line. Lines are dealt by file once; windows within files do the rest."""
    code, c, line = F.col("code"), F.col("c"), F.col("line")
    each = lines.flagged_lines(files.where(F.trim("code") != ""), react=code.rlike(brackets.REACT), fastapi=code.rlike("from fastapi|import fastapi"), test=scan.is_test(code))
    indent = F.length("text") - F.length(F.ltrim("text"))
    t = each.select("file_id", "lang", "react", "fastapi", "test", "line", "text", indent.alias("indent"), (F.trim("text") == "").alias("blank"), F.when(F.ltrim("text").rlike("^(?:#|//)"), "").otherwise(F.col("text")).alias("c"))
    t = dealt(t, files.where(F.trim("code") != ""), text.newlines(code) + 1).withColumn("real", F.trim("c") != "")
    w, whole = k.of_file(), Window.partitionBy("file_id")
    before, since = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = Window.partitionBy("file_id", "real").orderBy("line")
    py, script = F.col("lang") == "python", F.col("lang").isin(*brackets.SCRIPTS)
    is_def = c.rlike(k.DEF)
    first = lambda hit, reach: F.min(F.when(c.rlike(hit), line)).over(w.rowsBetween(0, reach - 1))
    count = lambda where, frame: F.coalesce(F.sum(where.cast("int")).over(frame), F.lit(0))
    last = lambda where, what, frame: F.last(F.when(where, what), True).over(frame)

    # neighbours: any lines, and lines that are neither blank nor comments
    t = t.withColumns({
        "lag_text": F.lag("text").over(w), "lead_text": F.lead("text").over(w), "lead_c": F.lead("c").over(w), "g": count(is_def, before),
        "orm": F.coalesce(*[first(h, 20) for h in k.ORM]), "blocking": first(k.BLOCKING, 50), "costly": first(k.COSTLY, 20), "grown": first(k.GROWTH, 30),
        "held": F.max(c.rlike(k.LIMIT)).over(w.rowsBetween(0, 29)), "safe": F.max(F.col("text").rlike(r"//.*SAFETY")).over(w.rowsBetween(-3, 0)), "specific": F.max(c.rlike(r"^\s*except\s+\w+")).over(whole),
        "owner": last(c.rlike(r"^\S") & ~F.col("blank"), F.when(c.rlike(r"^class\s"), line).otherwise(0), since),
        "handler": last(c.rlike(r"^\s*except\b.*:\s*$"), line, since), "handler_indent": last(c.rlike(r"^\s*except\b.*:\s*$"), F.col("indent"), since),
    })
    other = F.col("real") & ~F.ltrim("c").startswith("@")
    t = t.withColumns({
        "prior": F.lag("c").over(r), "prior_indent": F.lag("indent").over(r), "one": F.lead("c").over(r), "one_indent": F.lead("indent").over(r), "two_indent": F.lead("indent", 2).over(r),
        "stack": count(other, r.rowsBetween(Window.unboundedPreceding, -1)), "abstract": is_def & F.max(c.contains("@abstractmethod")).over(Window.partitionBy("file_id", "g")),
    })
    t = t.withColumns({"from": last(F.col("abstract"), line, since), "from_indent": last(F.col("abstract"), F.col("indent"), since)})
    running = lambda key: Window.partitionBy("file_id", key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = lambda key, depth, where: F.max(where & (line > F.col(key)) & (F.col("indent") <= F.col(depth))).over(running(key))
    inner = F.min(F.when((line > F.col("owner")) & F.col("real") & ~F.col("blank"), F.col("indent"))).over(Window.partitionBy("file_id", "owner"))
    t = t.withColumns({
        "left": gone("from", "from_indent", ~F.col("blank")), "handled": ~gone("handler", "handler_indent", F.col("real")), "inner": inner,
        "patches": F.count_if(c.rlike(r"^\s*@(?:\w+\.)*patch\b")).over(Window.partitionBy("file_id", "real", "stack")),
    })
    t = t.withColumn("methods", F.count_if(is_def & (F.col("indent") == F.col("inner"))).over(Window.partitionBy("file_id", "owner")))

    near = F.concat_ws("\n", "lag_text", "text", "lead_text")
    stands = c.rlike(r"raise\s+NotImplementedError\b") | F.col("text").rlike(r"^\s*pass\s*(?:#.*)?$") & near.rlike(k.TODO) | F.col("text").rlike(k.ELLIPSIS)
    public = is_def & ~F.regexp_extract("c", k.DEF, 1).startswith("_") & ~c.contains("->")
    nothing = F.col("one").rlike(r"^\s*(?:pass|\.\.\.|return(?:\s+None)?)\s*(?:#.*)?$") & (F.col("one_indent") > F.col("indent")) & (F.col("two_indent").isNull() | (F.col("two_indent") < F.col("one_indent")))
    route, jsx = c.rlike(k.ROUTE), F.col("text").contains(".map(") & F.col("text").contains("<") & ~F.col("text").contains("key=")
    magic = F.col("text").rlike(r"^\s*assert\b.*[^\w.][0-9]{2,}") & ~F.contains("text", F.lit("#")) & ~F.ltrim(F.coalesce("lag_text", F.lit(""))).startswith("#")
    hit = lambda rule_id, where, at=line: F.when(where & at.isNotNull(), F.struct(F.lit(rule_id).alias("rule_id"), at.cast("int").alias("line")))
    real = F.col("real")
    found = F.array_compact(F.array(
        hit("AI001", py & stands & (F.col("from").isNull() | F.col("left") | (line == F.col("from")))), hit("AI005", py & c.rlike(r"^\s*except\s*:") & F.col("specific")),
        hit("PERF001", c.rlike(k.LOOP), F.col("orm")), hit("PERF002", c.rlike(k.ENDLESS) & ~F.col("held"), F.col("grown")), hit("PERF003", c.rlike(k.ASYNC), F.col("blocking")), hit("PERF005", c.rlike(k.COSTLY_LOOP), F.col("costly")),
        hit("PY015", py & real & F.col("prior").rlike(k.TERMINAL) & (F.col("indent") == F.col("prior_indent")) & ~c.rlike(k.CLAUSE)),
        hit("ARCH003", py & real & public & ~F.coalesce("prior", F.lit("")).rlike(r"^\s*@(?:\w+\.)*(?:property|abstractmethod)\b")), hit("ARCH005", py & (line == F.col("owner")) & (F.col("methods") > 10)),
        hit("REACT003", script & F.col("react") & jsx), hit("FAPI001", py & F.col("fastapi") & route & F.col("lead_c").rlike(r"^[ \t]*def\s+\w+\s*\(")), hit("FAPI002", py & F.col("fastapi") & route & ~c.rlike(r"response_model\s*=")),
        hit("DEEP001", py & real & c.rlike(r"^\s*except\b.*:\s*$") & nothing), hit("DEEP004", py & real & F.col("handler").isNotNull() & F.col("handled") & c.rlike(r"^\s*raise\s+\w+") & ~c.rlike(r"\sfrom\s")),
        hit("RS003", (F.col("lang") == "rust") & F.col("text").rlike(r"\bunsafe\s*\{") & ~F.col("safe")), hit("TEST005", py & F.col("test") & real & c.rlike(r"^\s*(?:async\s+)?def\s+test_") & (F.col("patches") >= 4)),
        hit("TEST008", py & F.col("test") & magic),
    ))
    return t.select("file_id", F.explode(found).alias("f")).select("file_id", "f.rule_id", "f.line")


def full_scan(files: DataFrame, custom: Iterable[Rule] = ()) -> DataFrame:
    """file_id, rule_id, line: the rules of the file's language and for all, custom rules, and every check that needs no other table. PY001 to PY004 are found as a parser would find them, in place
    of their patterns; rules about tests hold in test code alone, rules of a framework in files that import it. Three passes over the files, of which lines and brackets are shuffled once
    each. Imports that aren't known (AI002, SEC014) and tests of what isn't tested (TEST004) need tables of their own: imports.unknown_imports, ingest.vulnerable_imports, checks.untested_names."""
    rules = replaced_rules(scan.custom_rules(custom) if custom else RULES)
    scripts = brackets.findings(files, LONG_FUNCTION, DEEP).select("file_id", "rule_id", "line")
    return file_findings(files, rules).unionByName(line_findings(files)).unionByName(scripts)
