"""Advice on small tables, with nulls, ties and empty ones."""

from sievemill.operators import advice, checks, lines, planning, prompts

CODE = '''class A(ABC):
    @abstractmethod
    def one(self):
        pass

    def two(self):
        """Says "what" it does."""
        raise NotImplementedError("later")

    def three(self):
        x = """a"""
        pass

    def four(self): ...

    @cached
    def five(self):
        # nothing yet
        pass  # TODO

    def six(self):
        return 1
'''


def of_files(spark, *codes):
    return spark.createDataFrame([(i, "python", c) for i, c in enumerate(codes)], "file_id long, lang string, code string")


def test_placeholders_are_confirmed_by_their_bodies(spark):
    files = of_files(spark, CODE, "", None)
    sure = advice.confirmed_placeholders(checks.marked(files), lines.functions(files))
    assert {tuple(r) for r in sure.collect()} == {(0, 8), (0, 14), (0, 19)}
    found = spark.createDataFrame([(0, "AI001", "ai_quality", 8), (0, "AI001", "ai_quality", 12), (0, "AI007", "ai_quality", 8), (0, "PY001", "style", 8), (1, "AI001", "ai_quality", None)], "file_id long, rule_id string, category string, line int")
    got = {(r["rule_id"], r["line"]): r["verifiable"] for r in advice.mark_verifiable(found, sure).collect()}
    assert got == {("AI001", 8): True, ("AI001", 12): False, ("AI007", 8): False, ("PY001", 8): True, ("AI001", None): False}


def test_explanations_name_what_is_known(spark):
    found = spark.createDataFrame([(1, "SEC001a", "security", "error", "key"), (1, "ZZ1", "other", "odd", "slug")], "file_id long, rule_id string, category string, severity string, rule string")
    texts = spark.createDataFrame([("rule", 1, "SEC", "general"), ("rule", 2, "SEC001", "special"), ("category", 1, "security", "mend"), ("severity", 1, "error", "now")], "kind string, ord int, name string, text string")
    counts, none = spark.createDataFrame([("SEC001a", 2)], "rule_id string, n long"), spark.createDataFrame([], "ord int, name string, category string, tags array<string>")
    got = {r["rule_id"]: (r["explanation"], r["overrides"]) for r in advice.explain(found, found, texts, counts, none).collect()}
    assert got == {"SEC001a": ("general mend now Overridden 2 times before.", 2), "ZZ1": ("Violation ZZ1: slug", 0)}
    ties = spark.createDataFrame([(2, "second", "security", ["x"]), (1, "first", "none", ["my-SECrets"])], none.schema)
    said = {r["explanation"] for r in advice.explain(found, found, texts, counts.limit(0), ties).collect()}
    assert said == {"general mend now See the convention first.", "Violation ZZ1: slug"}


def test_standards_of_the_major_version(spark):
    held = spark.createDataFrame([("framework:react", n, f"r{n}") for n in range(1, 7)] + [("framework:react-19", 1, "new"), ("architecture", 1, "a"), ("architecture", 2, "b")], "topic string, ord int, text string")
    versions = spark.createDataFrame([("react", "19.0"), ("vue", "3")], "framework string, version string")
    asked = prompts.classify(spark.createDataFrame([(1, "build a react page"), (2, None), (3, "")], "prompt_id long, text string"), r"\bauth\b")
    got = sorted((r["prompt_id"], r["text"]) for r in advice.standards_for(asked, held, versions, {"architecture": "permissive"}).collect())
    assert got == [(1, "a"), (1, "new"), (2, "a"), (3, "a")]
    old = sorted(r["text"] for r in advice.standards_for(asked, held, versions.limit(0), {"framework": "strict"}).where("prompt_id = 1 and topic like 'framework%'").collect())
    assert old == ["r1", "r2", "r3", "r4", "r5"]


def test_layers_are_named_once(spark):
    layers = spark.createDataFrame([("web", 1, "^src/web/"), ("db", 2, "^src/db/")], "layer string, ord int, pattern string")
    rules = spark.createDataFrame([("web", "forbid", "db"), ("web", "forbid", "core"), ("db", "allow", "db")], "layer string, kind string, target string")
    asked = spark.createDataFrame([(1, "move src/web/b.py to src/web/a.py and src/db/x.py"), (2, "nothing"), (3, None)], "prompt_id long, text string")
    assert [tuple(r) for r in advice.layer_context(asked, layers, rules).collect()] == [(1, "src/web/b.py", "web", "core,db")]


def test_stacks_are_told_once(spark):
    asked = spark.createDataFrame([(2, "python with django and fastapi"), (1, "Python: FastAPI, Django"), (3, "django alone"), (4, None), (5, "python alone")], "prompt_id long, text string")
    assert [tuple(r) for r in advice.stack_facts(asked.where("prompt_id <> 3")).collect()] == [("stack:python:django,fastapi", "python with fastapi, django", 1, 2)]


def test_layered_plans(spark):
    plans = spark.createDataFrame([(1, "## Research Notes\n## Epic Layer\n## Story Layer\n### Story 1\n**As** x\n##### 1.1\n**File:** a\n"), (2, ""), (3, None)], "plan_id long, text string")
    got = {r["plan_id"]: (round(r["completeness"], 9), round(r["grounding"], 9), r["ready"]) for r in planning.layered_plan_scores(plans.where("text is not null")).collect()}
    assert got == {1: (1.0, 0.6, False), 2: (0.25, 1.0, False)}
    assert planning.layered_plan_scores(plans).count() == 3
