"""The scan's building blocks against Python's own regexes and a character loop, and rules by example."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemill.functions import text
from sievemill.functions.catalogue import RULES, TEST_FREE, TEST_SIGNS, Rule
from sievemill.operators import quality, scan
from sievemill.sources.corpus import SNIPPETS

SCHEMA = "file_id long, project string, path string, lang string, code string"


def loop_spans(code, lang):
    """Literals and comments, one character after the other."""
    out, i, n = [], 0, len(code)
    hash_, template = lang in text.HASH, lang in text.TEMPLATE
    while i < n:
        start, c, three = i, code[i], code[i : i + 3]
        if three in ('"""', "'''"):
            i += 3
            while i < n and code[i : i + 3] != three:
                i += 2 if code[i] == "\\" else 1
            i = min(n, i + 3)
        elif c == "#" and hash_ or code[i : i + 2] == "//":
            i = code.find("\n", i) + 1 or n
        elif code[i : i + 2] == "/*" and not hash_:
            end = code.find("*/", i + 2)
            i = n if end < 0 else end + 2
        elif c == "`" and template or c in "\"'":
            i += 1
            while i < n and code[i] != c and (c == "`" or code[i] != "\n"):
                i += 2 if code[i] == "\\" else 1
            i = min(n, i + (i < n and code[i] == c))
        else:
            i += 1
            continue
        out.append((start, i))
    return out


CODE = st.text(alphabet="ab =(\n\"'#/*`x.é", max_size=60)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(codes=st.lists(CODE, min_size=20, max_size=20))
def test_spans_and_matches(spark, codes):
    rows = spark.createDataFrame([(i, lang, c) for i, c in enumerate(codes) for lang in ("python", "typescript", "go")], "i int, lang string, code string")
    out = rows.select("lang", "code", text.skip_spans(F.col("code"), F.col("lang")).alias("s"), text.find_all(F.col("code"), "a[ab]*|x").alias("m"))
    for r in out.collect():
        assert [tuple(s) for s in r["s"]] == loop_spans(r["code"], r["lang"]), r
        assert [tuple(m) for m in r["m"]] == [m.span() for m in re.finditer("a[ab]*|x", r["code"])]


def ids(spark, lang, code):
    rows = spark.createDataFrame([(1, "p", "src/a", lang, code)], SCHEMA)
    return sorted((r["rule_id"], r["line"], r["col"]) for r in scan.rule_scan(rows, [r for r in RULES if r.lang in ("", lang)]).collect())


@pytest.mark.parametrize(
    ("lang", "code", "want"),
    [
        ("python", "x = eval(y)\n# eval(z)\ns = 'eval(q)'", [("PY001", 1, 5)]),
        ("python", "a()  # type: ignore\nb()  # type: ignore[x]", [("PY006", 1, 6)]),
        ("python", "yaml.load(a)\nyaml.load(a, Loader=L)\nyaml.load(a)  # Loader", [("PY009", 1, 1), ("PY009", 2, 1)]),
        ("python", 'password = "abcd1234"\npassword = ""', [("SEC002", 1, 1)]),
        ("python", 'q = "SELECT a FROM b WHERE c=" + d', [("SEC004", 1, 5)]),
        ("rust", "let a = b.unwrap();", [("RS001", 1, 10)]),
        ("rust", "#[test]\nfn t() { b.unwrap(); }", []),
        ("javascript", "/* var a */ var b = 1", [("JS001", 1, 13)]),
        ("go", "func init() {}\n// panic(1)\npanic(2)", [("GO002", 3, 1), ("GO011", 1, 1)]),
        ("python", "  \n ", []),
    ],
)
def test_rules(spark, lang, code, want):
    assert ids(spark, lang, code) == want


def test_scores(spark):
    files = spark.createDataFrame([(1, "p", "a", "python", "eval(x)"), (2, "p", "b", "python", "x = 1"), (3, "q", "c", "python", None)], SCHEMA)
    out = {r["file_id"]: r for r in quality.file_scores(files, scan.rule_scan(files)).collect()}
    assert (out[1]["score"], out[1]["passed"]) == (0.75, False) and (out[2]["score"], out[2]["passed"]) == (1.0, True) and out[3]["score"] == 1.0


def test_custom_rules():
    from sievemill.functions.catalogue import Rule

    out = {r.id: r for r in scan.custom_rules([Rule("PY001", "", "", "", "info"), Rule("X1", "", "x", "foo", "error"), Rule("X2", "", "x", "(", "error")])}
    assert out["PY001"].severity == "info" and out["PY001"].pattern and out["X1"].ignore_case and "X2" not in out


def test_folders(spark, tmp_path):
    from sievemill.sources.corpus import scan_files

    for name in ("a.py", "b.go", "c.txt", "node_modules/d.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\ny = 2\n")
    assert sorted((r["path"].rsplit("/", 1)[1], r["lang"], r["code"]) for r in scan_files(spark, str(tmp_path)).collect()) == [("a.py", "python", "x = 1\ny = 2\n"), ("b.go", "go", "x = 1\ny = 2\n")]


def test_places_of_many_matches(spark):
    code = "".join(("ab\n" if i % 7 == 0 else "a b " if i % 3 else "x" * (i % 5) + "'s\\n'") for i in range(2000)) + "ab"
    rows = spark.createDataFrame([(1, "go", code), (2, "go", ""), (3, "go", None), (4, "go", "none"), (5, "go", "ab" * 256), (6, "go", "ab" * 257)], "i int, lang string, code string")
    got = {r["i"]: r for r in rows.select("i", "code", text.matches(F.col("code"), F.lit("ab|b")).alias("m"), text.skip_spans(F.col("code"), F.col("lang")).alias("s")).collect()}
    for i, r in got.items():
        c = r["code"] or ""
        want = [(m.start(), m.end(), c.count("\n", 0, m.start()) + 1, m.start() - (c.rfind("\n", 0, m.start()) + 1) + 1, m.group()) for m in re.finditer("ab|b", c)]
        assert [tuple(m) for m in r["m"]] == want and (i == 3 or [tuple(s) for s in r["s"]] == loop_spans(c, "go"))


def test_in_skip_equals_a_loop(spark):
    from sievemill.sources.corpus import SNIPPETS

    for spans in ([], [(0, 3)], [(2, 3), (3, 9), (12, 20)], [(3 * i, 3 * i + 2) for i in range(300)]):
        rows = spark.createDataFrame([(at, spans) for at in range(0, 25 if len(spans) < 9 else 905)], "at int, s array<struct<start:int,end:int>>")
        assert all(r["x"] == any(a < r["at"] < b for a, b in spans) for r in rows.select("at", text.in_skip(F.col("at"), F.col("s")).alias("x")).collect())
    code = SNIPPETS[0][2]
    assert spark.createDataFrame([("python", code)], "lang string, code string").select(F.length(text.masked(F.col("code"), F.col("lang")))).first()[0] == len(code)


def test_a_long_file_is_scanned_in_time_in_proportion(spark):
    import time

    line = "eval(x)  # 'a' \"b\"\ny = 'c'\n"
    took = []
    for n in (4_000, 40_000):
        rows = spark.createDataFrame([(1, "p", "a.py", "python", line * n)], SCHEMA)
        began = time.time()
        assert scan.rule_scan(rows, [r for r in RULES if r.id == "PY001"]).agg(F.count("*"), F.max("line")).first() == (n, 2 * n - 1)
        took.append(time.time() - began)
    assert took[1] < 20 * took[0] + 5


RULE_ROWS = [
    ("N1", "camel", r"(?-i:def\s+[a-z]+[A-Z]\w*\s*\()", "warning", "style", "python", "no camels", ""), ("N2", "any", "TODO", "info", "style", "_custom", "to do", ""), ("N3", "named", "(?P<n>abc)", "error", "style", "_custom", "python only", ""),
    ("N4", "broken", "(", "error", "style", "_custom", "", ""), ("N5", "none", "", "error", "style", "_custom", "", ""), ("N6", None, None, None, None, None, None, None),
]


def test_rules_as_rows(spark, tmp_path):
    from sievemill.operators import ingest

    files = spark.createDataFrame([(1, "p", "a.py", "python", "def getIt(a):\n    return 'def itIs(b)'  # TODO\n\ndef get_it(): pass\n"), (2, "q", "b.go", "go", "todo()\n\n  x todo\n"), (3, "p", "c", "go", " "), (4, "p", "c", "go", None)], SCHEMA)
    rules = spark.createDataFrame(RULE_ROWS, scan.RULE_ROWS)
    ingest.write_rules(rules, f"{tmp_path}/rules")
    back = scan.known_rules(ingest.read_rule_rows(spark, f"{tmp_path}/rules"))
    assert {r["id"] for r in back.collect()} == {"N1", "N2"}
    want = {(1, "N1", 1, 1, "def getIt(a):"), (2, "N2", 1, 1, "todo()"), (2, "N2", 3, 5, "x todo")}
    got = scan.scan_by_rules(files, back)
    assert {(r["file_id"], r["rule_id"], r["line"], r["col"], r["snippet"]) for r in got.collect()} == want
    own = scan.scan_by_rules(files, back.withColumn("project", F.lit("q")))
    assert {r["file_id"] for r in own.collect()} == {2}
    with pytest.raises(ValueError):
        scan.known_rules(rules.crossJoin(spark.range(200).toDF("k")), most=1000)
    assert [r.id for r in scan.custom_rules([Rule(*RULE_ROWS[2][:1], "", "x", "(?P<n>abc)", "error"), Rule("X9", "", "x", "abc", "error")], [])] == ["X9"]


def test_conventions_become_rules(spark, tmp_path):
    from sievemill.operators import ingest

    snake = "".join(f"def load_{i}(a):\n    \"\"\"Loads.\"\"\"\n    return a\n" for i in range(12))
    files = spark.createDataFrame([(1, "p", "a.py", "python", snake), (2, "p", "b.py", "python", "def getIt(a):\n    return a\n# def notThis(a)\n"), (3, "q", "c.py", "python", "def getIt(a):\n    return a\n"), (4, "p", "d.go", "go", "def getIt(")], SCHEMA)
    mined = quality.mined_rules(quality.naming_convention(files), quality.docstring_convention(files), spark.createDataFrame([("p", "PY005", 0.9), ("p", "PY006", 0.7)], "project string, rule_id string, confidence double"))
    assert {(r["project"], r["id"], r["pattern"] != "") for r in mined.collect()} == {("p", "CONV-snake-case-functions", True), ("p", "CONV-docstrings", True), ("p", "CONV-enforce-PY005", False)}
    ingest.write_rules(mined, f"{tmp_path}/mined")
    back = ingest.read_rule_rows(spark, f"{tmp_path}/mined", by_project=True)
    assert back.columns == mined.columns and back.count() == 3
    assert {(r["file_id"], r["rule_id"], r["line"]) for r in scan.scan_by_rules(files, back).collect()} == {(2, "CONV-snake-case-functions", 1), (2, "CONV-docstrings", 1)}


def test_full_scan_reads_the_files_three_times(spark):
    from sievemill.operators import full
    from sievemill.sources.corpus import files

    plan = full.full_scan(files(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_full_scan_by_example(spark):
    from sievemill.operators import full

    code = "import json\nimport os\nx = 'json'\nmodel.eval()\n\n\ndef eval(a=foo(), b=[1]):\n    return os.path\n    print(1)\n\n\ndef f(a=(1,)):\n    try:\n        eval(a)\n    except:\n        pass\n"
    rows = spark.createDataFrame([(1, "p", "a.py", "python", code), (2, "p", "b.py", "python", " "), (3, "p", "c.py", "python", None), (4, "p", "d.py", None, "password = 'hunter22'")], SCHEMA)
    got = {(r["file_id"], r["rule_id"], r["line"]) for r in full.full_scan(rows, [Rule("OWN", "", "own", "hunter", "error"), Rule("BAD", "", "bad", "(?P<n>a)", "error")]).collect()}
    assert got == {(1, "PY014", 1), (1, "PY004", 7), (1, "PY015", 9), (1, "PY001", 14), (1, "PY003", 15), (1, "DEEP001", 15), (1, "ARCH003", 7), (1, "ARCH003", 12), (4, "SEC002", 1)}


def test_patterns_tell_what_a_match_needs(spark):
    assert text.required(r"\beval\s*\(") == [["eval"], ["("]]
    assert text.required(r"(?i)(?:password|pin)\s*=") == [["password", "pin"], ["="]] or all(any(x in "my password = 1" for x in q) for q in text.required(r"(?i)(?:password|pin)\s*="))
    assert not any(text.required(p) for p in (r"[!&&[^?]]", r"[+[-]]", r"\v+", r"\0101", r"\w+", r"(?i:eval)", r"(?<n>eval)", "(?x)a b c", "("))
    rules = [r for r in RULES if text.required(r.regex)]
    assert len(rules) > 90
    codes = [("python", "eval (a)"), ("python", "EVAL(a)"), ("go", 'PassWord = "abcdef"'), ("rust", "let a = 1;"), ("python", 'x = F"dElEtE {a}"'), ("python", "verify=K False")]
    files = spark.createDataFrame([(i, *c) for i, c in enumerate(codes)], "file_id long, lang string, code string")
    both = files.select(*[F.array(text.has(F.col("code"), r.regex, F.lower("code")), F.col("code").rlike(r.regex)).alias(f"r{i}") for i, r in enumerate(rules)]).collect()
    assert all(a == b for row in both for a, b in row) and sum(a for row in both for a, _ in row) >= 4


def test_only_places_leave_the_scan(spark):
    files = spark.createDataFrame([(i, lang, code) for i, (lang, _, code) in enumerate(SNIPPETS)] + [(90, None, "eval(1)"), (91, "python", " "), (92, "python", None), (93, "rust", "#[test]\nx.unwrap()")], "file_id long, lang string, code string")
    found = scan.rule_scan(files)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(") == 1  # before, texts and spans were copied for each rule that matched, and placed in a second one
    wanted = set()
    for r in files.where("trim(code) <> ''").collect():
        for rule in RULES:
            if rule.lang in ("", r["lang"]) and not (rule.slug in TEST_FREE and re.search("|".join(TEST_SIGNS), r["code"])):
                wanted |= {(r["file_id"], rule.id, r["code"].count("\n", 0, m.start()) + 1) for m in re.finditer(rule.regex, r["code"]) if not (rule.unless and re.search(rule.unless, m.group()))}
    got = {(r["file_id"], r["rule_id"], r["line"]) for r in found.collect()}
    assert got <= wanted and len(got) > 40
    spans = files.select("file_id", "code", text.skip_spans(F.col("code"), F.col("lang")).alias("s"))
    inside = {r["file_id"]: (r["code"], r["s"]) for r in spans.collect()}
    for i, rule_id, line in wanted - got:
        code, skipped = inside[i]
        rule = next(r for r in RULES if r.id == rule_id)
        assert any(s["start"] < m.start() < s["end"] for m in re.finditer(rule.regex, code) for s in skipped), (i, rule_id, line)


def test_short_rows_are_dealt_by_their_number(spark):
    from sievemill.operators import brackets
    from sievemill.places import dealt

    files = spark.range(40).select(F.col("id").alias("file_id"), F.lit("typescript").alias("lang"), F.repeat(F.lit("{}\n"), F.lit(50_000)).alias("code"))
    chars, lines, paired = 40 * 150_000, 40 * 50_001, 40 * 100_001
    tasks = lambda n, rows: -(-(n + 64 * rows) // (1 << 23))
    assert dealt(files, files, text.newlines(F.col("code")) + 1).rdd.getNumPartitions() == tasks(chars, lines) == 16  # before, 4: one for each 8M characters, but as many as there are cores
    plan = brackets.events(files)._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(file_id#\d+L, {tasks(chars, paired)}\)", plan)
