"""Checks that look around a line: over `marked` lines (file_id, lang, test, line, text, indent, blank, c), where c is the text of
lines that are no comments. Windows within files; nothing else is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalogue import Rule
from . import scan
from .lines import flagged_lines

#: Rules that are patterns alone.
THEATRE = [
    Rule("AI007", "python", "hash-of-secret", r"\bhash\s*\(\s*\w*(?:password|secret|token|key|passw|pwd)\w*\s*\)", "error", category="ai_quality", ignore_case=True),
    Rule("AI007", "python", "validate-always-true", r"def\s+validate\w*\s*\([^)]*\)\s*(?:->\s*\w+\s*)?:\s*\n\s+return\s+True", "error", category="ai_quality"),
    Rule("AI007", "python", "md5-of-secret", r"(?:hashlib\.md5|MD5\.new|md5\s*\()[^\n]*?(?:password|secret|token|key|auth|cred)", "error", category="ai_quality", ignore_case=True),
    Rule("AI007", "python", "secret-in-md5", r"(?:password|secret|token|key|auth|cred)[^\n]*?(?:hashlib\.md5|md5\s*\()", "error", category="ai_quality", ignore_case=True),
]
INJECTION = [
    Rule("AI008", "", "sql-f-string", r"""f["'][^\n]*?(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b[^\n]*?\{""", "error", category="ai_quality", ignore_case=True),
    Rule("AI008", "", "eval-f-string", r"""\beval\s*\(\s*f["']""", "error", category="ai_quality"),
    Rule("AI008", "", "exec-f-string", r"""\bexec\s*\(\s*f["']""", "error", category="ai_quality"),
    Rule("AI008", "", "system-f-string", r"""\bos\.system\s*\(\s*f["']""", "error", category="ai_quality"),
    Rule("AI008", "", "subprocess-f-string", r"""\bsubprocess\.\w+\s*\([^)]*f["']""", "error", category="ai_quality"),
]
UNBOUNDED = [
    Rule("PERF004", "", "objects-all", r"\.objects\.all\s*\(\s*\)", "warning", category="performance"),
    Rule("PERF004", "", "query-all", r"session\.query\s*\([^)]*\)\.all\s*\(\s*\)", "warning", category="performance"),
    Rule("PERF004", "", "find-many", r"\.findMany\s*\(\s*\{?\s*\}?\s*\)", "warning", category="performance"),
    Rule("PERF004", "", "select-star", r'db\.Query\s*\(\s*"SELECT\s+\*[^"]*"[^\n]*', "warning", r'^db\.Query\s*\(\s*"SELECT\s+\*[^"]*"[^\n]*LIMIT', "performance"),
    Rule("PERF004", "", "to-list", r"\.ToListAsync?\s*\(\s*\)[^\n]*", "warning", r"(?:Take|Skip)", "performance"),
]
#: Loops, queries in them, blocking and costly calls, growth and its limits.
LOOP = r"for\s*\(|for\s+\w+|while\s*\(|\.forEach\s*\(|\.map\s*\(|for\s+.*range"
ORM = [
    r"session\.execute\s*\(", r"cursor\.execute\s*\(", r"\.objects\.get\s*\(", r"\.objects\.filter\s*\(", r"await\s+\w+\.findOne\s*\(", r"await\s+\w+\.findUnique\s*\(", r"await\s+\w+\.findFirst\s*\(",
    r"db\.(?:Query|QueryRow|Exec)\s*\(", r"entityManager\.find\s*\(", r"\.createQuery\s*\(", r"\.createNativeQuery\s*\(", r"sqlx::query\s*[!(]", r"\.fetch_one\s*\(", r"\.FindAsync\s*\(",
    r"\.FirstOrDefaultAsync\s*\(", r"\.SingleAsync\s*\(",
]
ASYNC = r"async\s+(?:def|function|fn)\s+\w+|async\s+\w+\s*\(|async\s+\(\s*\)\s*=>|async\s+Task[<\s]"
BLOCKING = (
    r"\btime\.sleep\s*\(|\brequests\.(?:get|post|put|delete|patch|head)\s*\(|\bopen\s*\([^)]*\)\.read|\bfs\.readFileSync\s*\(|\bfs\.writeFileSync\s*\(|\bchild_process\.execSync\s*\("
    r"|\bThread\.sleep\s*\(|\bThread\.Sleep\s*\(|\.Result\b|\.GetAwaiter\(\)\.GetResult\(\)|std::thread::sleep\s*\("
)
COSTLY = r"re\.compile\s*\(|os\.environ\.get\s*\(|process\.env\.\w+|Environment\.GetEnvironmentVariable\s*\(|os\.Getenv\s*\(|System\.getenv\s*\("
COSTLY_LOOP = LOOP + r"|loop\s*\{"
ENDLESS, GROWTH, LIMIT = r"while\s+(?:True|true|1)\s*[:{]|for\s*\{|loop\s*\{", r"\.append\s*\(|\.push\s*\(|\.add\s*\(|\.Add\s*\(|\+=\s*\[", r"(?:len\([^)]*\)|\.length|\.size|\.Count|\.Len\(\))\s*[><=]"
TODO, ELLIPSIS = r"(?i)#\s*(?:todo|fixme|placeholder|hack)\b", r"(?i)\.\.\.\s*#\s*(?:todo|fixme|placeholder|hack)\b"
DEF, CLASS = r"^\s*(?:async\s+)?def\s+(\w+)", r"^class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:"
TERMINAL, CLAUSE = r"^\s*(?:return|raise|continue|break)\b.*[^(\[{,\\]$|^\s*(?:return|raise|continue|break)$", r"^\s*(?:except|finally|else|elif|case|@|def |class |async def )"
#: Heavy libraries with what counts as trivial use.
HEAVY = {"requests": r"\brequests\.get\s*\(", "pandas": r"(?m)\bpd\.read_csv\s*\([^)]*\)\s*$", "numpy": r"\bnp\.(?:sum|mean|max|min|abs|sqrt)\s*\(\s*\["}
CLIENT_APIS = (
    r"\b(?:useState|useEffect|useRef|useCallback|useMemo|useReducer|useContext|useLayoutEffect|useImperativeHandle|useDebugValue|useSyncExternalStore|useTransition|useDeferredValue"
    r"|useId|useOptimistic|useFormStatus|onClick|onChange|onSubmit|onFocus|onBlur|onKeyDown|onKeyUp|onMouseEnter)\b"
)
USE_CLIENT = r"(?m)^['\"]use client['\"];?\s*$"
ROUTE = r"^[ \t]*@(?:app|router)\.(?:get|post|put|delete|patch|options|head)\s*\("
EDGE_WORDS = "empty none null zero negative boundary invalid error fail edge corner overflow large missing".split()
ASSERTION = r"\bassert\b|\.(?:raises|warns|approx)\s*\(|\.assert\w*\s*\("


def marked(files: DataFrame) -> DataFrame:
    each = flagged_lines(files, test=scan.is_test(F.col("code")))
    indent = F.length("text") - F.length(F.ltrim("text"))
    return each.select("file_id", "lang", "test", "line", "text", indent.alias("indent"), (F.trim("text") == "").alias("blank"), F.when(F.ltrim("text").rlike("^(?:#|//)"), "").otherwise(F.col("text")).alias("c"))


def one_a_line(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """file_id, line, kind: the first of the rules that a line breaks; rules may share an id."""
    numbered = [r._replace(id=f"{i}") for i, r in enumerate(rules)]
    found = scan.rule_scan(files, numbered)
    return found.groupBy("file_id", "line").agg(F.min_by("rule", F.col("rule_id").cast("int")).alias("kind"))


def of_file(*order: str) -> Window:
    return Window.partitionBy("file_id").orderBy(*(order or ("line",)))


def ahead(table: DataFrame, opener: str, hit: str, reach: int, own: bool = True) -> DataFrame:
    """file_id, line, hit: lines with an opener, and the first hit among them and the `reach` - 1 lines after them."""
    first = F.min(F.when(F.col("c").rlike(hit), F.col("line"))).over(of_file().rowsBetween(0 if own else 1, reach - 1))
    return table.withColumn("hit", first).where(F.col("c").rlike(opener) & F.col("hit").isNotNull()).select("file_id", "line", "hit")


def first_listed(table: DataFrame, opener: str, hits: list[str], reach: int) -> DataFrame:
    """file_id, line, hit: lines with an opener, and the first line of the first pattern listed that is among them and the `reach` - 1 lines after them."""
    block = of_file().rowsBetween(0, reach - 1)
    first = F.coalesce(*[F.min(F.when(F.col("c").rlike(h), F.col("line"))).over(block) for h in hits])
    return table.withColumn("hit", first).where(F.col("c").rlike(opener) & F.col("hit").isNotNull()).select("file_id", "line", "hit")


def unbounded_growth(table: DataFrame) -> DataFrame:
    """Endless loops whose 30 lines grow a collection and never look at a size: file_id, line, hit."""
    block = of_file().rowsBetween(0, 29)
    grown = table.withColumn("hit", F.min(F.when(F.col("c").rlike(GROWTH), F.col("line"))).over(block)).withColumn("held", F.max(F.col("c").rlike(LIMIT)).over(block))
    return grown.where(F.col("c").rlike(ENDLESS) & F.col("hit").isNotNull() & ~F.col("held")).select("file_id", "line", "hit")


def placeholders(table: DataFrame) -> DataFrame:
    """file_id, line, kind of Python lines that stand for code to come, outside the bodies of abstract methods."""
    py = table.where("lang = 'python'")
    is_def = F.col("c").rlike(DEF)
    group = F.coalesce(F.sum(is_def.cast("int")).over(of_file().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    py = py.withColumn("g", group).withColumn("abstract", is_def & F.max(F.col("c").contains("@abstractmethod")).over(Window.partitionBy("file_id", "g")))
    since = of_file().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    py = py.withColumn("from", F.last(F.when(F.col("abstract"), F.col("line")), True).over(since)).withColumn("depth", F.last(F.when(F.col("abstract"), F.col("indent")), True).over(since))
    left = (F.col("line") > F.col("from")) & ~F.col("blank") & (F.col("indent") <= F.col("depth"))
    py = py.withColumn("left", F.max(left).over(Window.partitionBy("file_id", "from").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    near = F.concat_ws("\n", F.lag("text").over(of_file()), "text", F.lead("text").over(of_file()))
    kind = F.when(F.col("c").rlike(r"raise\s+NotImplementedError\b"), "raise").when(F.col("text").rlike(r"^\s*pass\s*(?:#.*)?$") & F.col("near").rlike(TODO), "pass").when(F.col("text").rlike(ELLIPSIS), "ellipsis")
    outside = F.col("from").isNull() | F.col("left") | (F.col("line") == F.col("from"))
    return py.withColumn("near", near).withColumn("kind", kind).where(F.col("kind").isNotNull() & outside).select("file_id", "line", "kind")


def over_engineering(table: DataFrame, functions: DataFrame) -> DataFrame:
    """file_id, line, kind: abstract classes with one subclass in the file, classes of over five type parameters, factories of one type."""
    classes = table.where(F.col("lang").eqNullSafe("python") & F.col("c").rlike(CLASS)).select("file_id", "line", F.regexp_extract("c", CLASS, 1).alias("name"), F.regexp_extract("c", CLASS, 2).alias("bases"))
    abstract = classes.where(F.col("bases").rlike(r"\bABC\b")).select("file_id", "line", "name")
    heirs = classes.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("bases", F.lit(r"(\w+)"), F.lit(1)))).alias("name"))
    alone = abstract.join(heirs, ["file_id", "name"]).groupBy("file_id", "line").agg(F.count("*").alias("n")).where("n = 1").select("file_id", "line", F.lit("one subclass").alias("kind"))
    wide = classes.where(F.size(F.split(F.regexp_extract("bases", r"\[([^\]]+)\]", 1), ",")) > 5).select("file_id", "line", F.lit("type parameters").alias("kind"))
    made = F.regexp_extract_all("body", F.lit(r"return\s+(\w+)\s*\("), F.lit(1))
    factory = functions.where(F.col("name").rlike("^(?:create_|make_|build_|get_)") & (F.size(made) >= 2) & (F.size(F.array_distinct(made)) == 1)).select("file_id", F.col("start").alias("line"), F.lit("factory").alias("kind"))
    return alone.unionByName(wide).unionByName(factory)


def mixed_handlers(table: DataFrame) -> DataFrame:
    """Bare handlers of Python files that also have specific ones: file_id, line."""
    specific = F.max(F.col("c").rlike(r"^\s*except\s+\w+")).over(Window.partitionBy("file_id"))
    return table.where("lang = 'python'").withColumn("specific", specific).where(F.col("c").rlike(r"^\s*except\s*:") & F.col("specific")).select("file_id", "line")


def heavy_imports(table: DataFrame) -> DataFrame:
    """file_id, line, library of imports of heavy libraries that the file names at most twice besides, in a trivial way."""
    out = None
    for library, trivial in HEAVY.items():
        imported = F.col("c").rlike(rf"^(?:import\s+{library}|from\s+{library}\s+import)\b")
        found = table.where("lang = 'python'").groupBy("file_id").agg(
            F.min(F.when(imported, F.col("line"))).alias("line"), F.sum(F.regexp_count("c", F.lit(rf"\b{library}\b"))).alias("named"), F.max(F.col("c").rlike(trivial)).alias("trivial")
        )
        found = found.where("line is not null and named <= 3 and trivial").select("file_id", "line", F.lit(library).alias("library"))
        out = found if out is None else out.unionByName(found)
    return out


def unreachable(table: DataFrame) -> DataFrame:
    """file_id, line: the statement after a return, raise, continue or break in the same block. Blank and comment lines lie between."""
    real = table.where((F.col("lang") == "python") & (F.trim("c") != ""))
    real = real.withColumn("prior", F.lag("c").over(of_file())).withColumn("depth", F.lag("indent").over(of_file()))
    return real.where(F.col("prior").rlike(TERMINAL) & (F.col("indent") == F.col("depth")) & ~F.col("c").rlike(CLAUSE)).select("file_id", "line")


def untyped_functions(table: DataFrame) -> DataFrame:
    """file_id, line, name of public functions without a return type, but properties and abstract methods."""
    real = table.where((F.col("lang") == "python") & (F.trim("c") != "")).withColumn("prior", F.coalesce(F.lag("c").over(of_file()), F.lit("")))
    name = F.regexp_extract("c", DEF, 1)
    return real.where(F.col("c").rlike(DEF) & ~name.startswith("_") & ~F.col("c").contains("->") & ~F.col("prior").rlike(r"^\s*@(?:\w+\.)*(?:property|abstractmethod)\b")).select("file_id", "line", name.alias("name"))


def deep_functions(functions: DataFrame, most: int = 4) -> DataFrame:
    """file_id, name, start, depth: functions whose blocks nest deeper than `most`."""
    return functions.where(F.col("depth") > most).select("file_id", "name", "start", "depth")


def big_classes(table: DataFrame, most: int = 10) -> DataFrame:
    """file_id, line, methods of classes at the outer level with more than `most` methods."""
    top = F.col("c").rlike(r"^\S") & ~F.col("blank")
    since = of_file().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(top, F.when(F.col("c").rlike(r"^class\s"), F.col("line")).otherwise(0)), True).over(since)
    py = table.where("lang = 'python'").withColumn("owner", owner).where("owner > 0")
    first = F.min(F.when(F.col("line") > F.col("owner"), F.when(~F.col("blank") & (F.trim("c") != ""), F.col("indent")))).over(Window.partitionBy("file_id", "owner"))
    methods = F.count_if(F.col("c").rlike(DEF) & (F.col("indent") == F.col("first")))
    return py.withColumn("first", first).groupBy("file_id", "owner").agg(methods.alias("methods")).where(F.col("methods") > most).select("file_id", F.col("owner").alias("line"), "methods")


def brace_depth(table: DataFrame) -> DataFrame:
    """Lines with the depth of braces before and after them, counted outside comment lines."""
    opened = F.length("c") - F.length(F.replace("c", F.lit("{"), F.lit("")))
    closed = F.length("c") - F.length(F.replace("c", F.lit("}"), F.lit("")))
    after = F.sum(opened - closed).over(of_file().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return table.withColumn("after", after).withColumn("before", F.col("after") - (opened - closed))


def deepest_braces(table: DataFrame) -> DataFrame:
    """file_id, depth: the deepest nesting of braces of each TypeScript or JavaScript file."""
    return brace_depth(table.where("lang in ('typescript', 'javascript')")).groupBy("file_id").agg(F.max("after").alias("depth"))


def maps_without_key(table: DataFrame) -> DataFrame:
    jsx = F.col("text").contains(".map(") & F.col("text").contains("<") & ~F.col("text").contains("key=")
    return table.where("lang in ('typescript', 'javascript')").where(jsx).select("file_id", "line")


def missing_use_client(table: DataFrame, most: int = 5) -> DataFrame:
    """file_id, apis: up to `most` names of client APIs in files without the directive, in order."""
    ts = table.where("lang in ('typescript', 'javascript')")
    has = F.max(F.col("text").rlike(USE_CLIENT)).over(Window.partitionBy("file_id"))
    code = F.trim("c")
    used = ts.withColumn("has", has).where(~F.col("has") & code.rlike(CLIENT_APIS) & ~code.rlike(r"^(?:import |from |/\*)"))
    return used.groupBy("file_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set(F.regexp_extract(code, CLIENT_APIS, 0))), 1, most), ", ").alias("apis"))


def route_handlers(table: DataFrame) -> DataFrame:
    """file_id, line, kind of routes on one line: handlers that aren't async, and routes without a response model."""
    nxt = F.lead("c").over(of_file())
    found = F.array_compact(F.array(F.when(F.col("next").rlike(r"^[ \t]*def\s+\w+\s*\("), "sync handler"), F.when(~F.col("c").rlike(r"response_model\s*="), "no response model")))
    return table.where("lang = 'python'").withColumn("next", nxt).where(F.col("c").rlike(ROUTE)).select("file_id", "line", F.explode(found).alias("kind"))


def frameworks(files: DataFrame) -> DataFrame:
    code, ts = F.col("code"), F.col("lang").isin("typescript", "javascript")
    found = F.array_compact(F.array(
        F.when(ts & code.rlike(r"from ['\"]react['\"]|require\('react'\)"), "react"), F.when(ts & code.rlike("from ['\"]next"), "next.js"),
        F.when((F.col("lang") == "python") & code.rlike("from fastapi|import fastapi"), "fastapi"),
    ))
    return files.select("file_id", F.explode(found).alias("framework"))


def swallowed_exceptions(table: DataFrame) -> DataFrame:
    """file_id, line of handlers whose body is one pass, ellipsis, or return of nothing."""
    real = table.where((F.col("lang") == "python") & (F.trim("c") != ""))
    one, two = F.lead("c").over(of_file()), F.lead("indent", 2).over(of_file())
    real = real.withColumn("one", one).withColumn("deep", F.lead("indent").over(of_file())).withColumn("two", two)
    empty = F.col("one").rlike(r"^\s*(?:pass|\.\.\.|return(?:\s+None)?)\s*(?:#.*)?$") & (F.col("deep") > F.col("indent")) & (F.col("two").isNull() | (F.col("two") < F.col("deep")))
    return real.where(F.col("c").rlike(r"^\s*except\b.*:\s*$") & empty).select("file_id", "line")


def raises_without_cause(table: DataFrame) -> DataFrame:
    """file_id, line of raises of something new in a handler without `from`. A handler reaches as far as lines are further in."""
    real = table.where((F.col("lang") == "python") & (F.trim("c") != ""))
    since = of_file().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    handler = F.col("c").rlike(r"^\s*except\b.*:\s*$")
    real = real.withColumn("from", F.last(F.when(handler, F.col("line")), True).over(since)).withColumn("depth", F.last(F.when(handler, F.col("indent")), True).over(since))
    left = F.max((F.col("line") > F.col("from")) & (F.col("indent") <= F.col("depth"))).over(Window.partitionBy("file_id", "from").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return real.withColumn("left", left).where(F.col("from").isNotNull() & ~F.col("left") & F.col("c").rlike(r"^\s*raise\s+\w+") & ~F.col("c").rlike(r"\sfrom\s")).select("file_id", "line")


def weak_tests(functions: DataFrame) -> DataFrame:
    """file_id, name, kind of test functions (body without comments): empty, asserting nothing but True, without assertion, or catching any exception."""
    body, tests = F.col("body"), functions.where(F.startswith("name", F.lit("test_")))
    empty = body.rlike(r"\A(?:pass|\.\.\.)?\z")
    kinds = F.array_compact(F.array(
        F.when(empty, "empty"), F.when(body.rlike(r"\Aassert True\z"), "assert true"), F.when(~empty & ~body.rlike(ASSERTION), "no assertion"),
        F.when(body.rlike(r"pytest\.raises\s*\(\s*Exception\s*\)|assertRaises\s*\(\s*Exception\s*\)"), "any exception"), F.when(body.rlike(r"(?m)^(?:global|nonlocal)\s"), "shared state"),
    ))
    return tests.select("file_id", "name", F.explode(kinds).alias("kind"))


def many_patches(table: DataFrame, least: int = 4) -> DataFrame:
    """file_id, line, n: test functions under `least` patch decorators or more, which are the decorators right above them."""
    real = table.where((F.col("lang") == "python") & (F.trim("c") != ""))
    other = ~F.ltrim("c").startswith("@")
    group = F.coalesce(F.sum(other.cast("int")).over(of_file().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.count_if(F.col("c").rlike(r"^\s*@(?:\w+\.)*patch\b")).over(Window.partitionBy("file_id", "g"))
    return real.withColumn("g", group).withColumn("n", n).where(F.col("c").rlike(r"^\s*(?:async\s+)?def\s+test_") & (F.col("n") >= least)).select("file_id", "line", "n")


def no_edge_cases(functions: DataFrame, least: int = 3) -> DataFrame:
    """file_id, tests of files with `least` tests or more, none of which names an edge case."""
    tests = functions.where(F.startswith("name", F.lit("test_"))).groupBy("file_id").agg(F.count("*").alias("tests"), F.max(F.lower("name").rlike("|".join(EDGE_WORDS))).alias("edge"))
    return tests.where((F.col("tests") >= least) & ~F.col("edge")).select("file_id", "tests")


def tidy_suggestions(table: DataFrame, functions: DataFrame, long: int = 20, deep: int = 4, large: int = 300, most: int = 3) -> DataFrame:
    """file_id, kind, line, rank of what would make a file tidier, least effort first, `most` a file: nesting of `deep` levels of four spaces
    (small), functions of over `long` lines (medium), files of over `large` lines that aren't blank (large)."""
    level = F.when(~F.col("blank") & (F.trim("c") != ""), F.floor(F.col("indent") / 4))
    nested = table.groupBy("file_id").agg(F.max(level).alias("depth"), F.min(F.when(level.isNotNull(), F.struct((-level).alias("up"), F.col("line")))).alias("first")).where(F.col("depth") >= deep).select("file_id", "first.line")
    wide = functions.where(F.col("stop") - F.col("start") + 1 > long).select("file_id", F.lit("extract_method").alias("kind"), F.col("start").alias("line"), F.lit(2).alias("effort"))
    big = table.groupBy("file_id").agg(F.count_if(~F.col("blank")).alias("n")).where(F.col("n") > large).select("file_id", F.lit("split_file").alias("kind"), F.lit(1).alias("line"), F.lit(3).alias("effort"))
    every = nested.select("file_id", F.lit("simplify_conditional").alias("kind"), "line", F.lit(1).alias("effort")).unionByName(wide).unionByName(big)
    return every.withColumn("rank", F.row_number().over(of_file("effort", "line"))).where(F.col("rank") <= most).select("file_id", "kind", "line", "rank")


def inferred_severity(rule_id):
    """A rule's severity by the beginning of its id; what it would be eased to is the next lower one."""
    severe = rule_id.rlike("^(?:SEC|PY001|PY002|PY003|PY004|PY007|PY008|PY009|PY010)")
    return F.when(severe, "error").otherwise("warning")


def untested_names(tests: DataFrame, names: DataFrame) -> DataFrame:
    """group of the test files (group, token) none of whose words is a public name of the implementation (group, name) paired with them."""
    public = names.where(~F.startswith("name", F.lit("_"))).select("group", F.col("name").alias("token")).distinct()
    met = tests.join(public, ["group", "token"], "left_semi").select("group").distinct()
    return tests.select("group").distinct().join(public.select("group").distinct(), "group", "left_semi").join(met, "group", "left_anti")
