"""What files import, in the spelling of each language, against what their projects declare."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import ingest

#: How each language imports; the first group is the name. A Go block's names stand in quotes, one a line.
IMPORTS = {
    "python": [r"(?m)^import\s+(\w+)", r"(?m)^from\s+(\w+)"],
    "scripts": [r"""(?m)^[ \t]*import\s+[^\n]*?\s+from\s+['"]([^'"./][^'"]*?)['"]""", r"""\brequire\s*\(\s*['"]([^'"./][^'"]*?)['"]"""],
    "go": [r'(?m)^[ \t]*import\s+"([^"]+)"'],
    "rust": [r"(?m)^[ \t]*use\s+(\w+)::"],
}
GO_BLOCK, GO_NAME = r"import\s*\([^)]*\)", r'"([^"]+)"'
SCRIPTS = ("typescript", "javascript")
#: What needs no declaration. Python's own modules are those of the interpreter, with some that newer ones don't have, and packages that others bring along.
GONE = "aifc asynchat asyncore audioop binhex cgi cgitb chunk crypt distutils imghdr imp lib2to3 mailcap nis nntplib ossaudiodev pipes smtpd sndhdr spwd sunau telnetlib test uu xdrlib typing_extensions".split()
BROUGHT = "requests typing_extensions six certifi charset_normalizer idna urllib3 packaging setuptools pip wheel attrs cattrs pydantic pydantic_core".split()
NODE = (
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks "
    "process punycode querystring readline repl stream string_decoder timers tls trace_events tty url util v8 vm wasi worker_threads zlib"
).split()
RUST = "std core alloc proc_macro test self super crate".split()
PYTHON = sorted({*sys.stdlib_module_names, *GONE})

CARGO_SECTION = r"(?ms)^\[(?:dev-|build-)?dependencies\][ \t]*\n((?:(?!\[)[^\n]*\n?)*)"
GO_MODULE = r"(?m)^(?:\s+|require\s+)([^\s(/]\S*)\s+v[0-9]"


def package_of(module: Column) -> Column:
    """The npm package that a path names: its first part, and the second of one with a scope."""
    return F.when(module.startswith("@"), F.substring_index(module, "/", 2)).otherwise(F.substring_index(module, "/", 1))


def _said(patterns: list[str], named=lambda m: m) -> Column:
    """(line, module) of the matches of any of the patterns in the code."""
    each = lambda p: F.transform(text.matches(F.col("code"), F.lit(p)), lambda m: F.struct(m["line"].alias("line"), named(F.regexp_extract(m["match"], p, 1)).alias("module")))
    return F.array_distinct(F.concat(*map(each, patterns)))


def _of_blocks() -> Column:
    """(line, module) of Go's import blocks: the first quoted name of each line in them."""
    names = lambda m: F.transform(F.split(m["match"], "\n"), lambda t, i: F.struct((m["line"] + i).alias("line"), F.regexp_extract(t, GO_NAME, 1).alias("module")))
    return F.filter(F.flatten(F.transform(text.matches(F.col("code"), F.lit(GO_BLOCK)), names)), lambda x: x["module"] != "")


def imports(files: DataFrame) -> DataFrame:
    """file_id, project, lang, line, module of every import of Python, TypeScript, JavaScript, Go and Rust files (file_id, project, lang, code), each once a line. Literals and comments
    count like code. Relative imports name no package and stay out. A narrow stage: nothing is shuffled, and only names leave a file. Other languages, null and empty code: no rows."""
    lang = F.col("lang")
    found = F.when(lang == "python", _said(IMPORTS["python"])).when(lang.isin(*SCRIPTS), _said(IMPORTS["scripts"], package_of))
    found = found.when(lang == "go", F.array_distinct(F.concat(_said(IMPORTS["go"]), _of_blocks()))).when(lang == "rust", _said(IMPORTS["rust"]))
    return files.select("file_id", "project", "lang", F.explode(found).alias("i")).select("file_id", "project", "lang", "i.line", "i.module")


def is_builtin(lang: Column, module: Column) -> Column:
    """Whether a language brings the module along. Go's own packages have no dot in their first part."""
    node = module.isin(*NODE) | module.startswith("node:")
    known = F.when(lang == "python", module.isin(*PYTHON)).when(lang.isin(*SCRIPTS), node).when(lang == "rust", module.isin(*RUST))
    return known.when(lang == "go", ~F.contains(F.substring_index(module, "/", 1), F.lit("."))).otherwise(F.lit(False))


def declared(files: DataFrame) -> DataFrame:
    """project, package of manifests (project, path, text), as imports spell them: _ in Python's and Rust's names, whole module paths in Go's."""
    found = ingest.manifests(files)
    python = ingest.dependencies(found.where("ecosystem = 'PyPI'")).select("project", F.replace("package", F.lit("-"), F.lit("_")).alias("package"))
    npm = ingest.dependencies(found.where("ecosystem = 'npm'")).select("project", "package")
    go = found.where("ecosystem = 'Go'").select("project", F.explode(F.regexp_extract_all("text", F.lit(GO_MODULE), F.lit(1))).alias("package"))
    sections = F.array_join(F.regexp_extract_all("text", F.lit(CARGO_SECTION), F.lit(1)), "\n")
    rust = found.where("ecosystem = 'crates.io'").select("project", F.explode(F.regexp_extract_all(sections, F.lit(r"(?m)^([\w-]+)(?:\.\w+)?\s*="), F.lit(1))).alias("package"))
    rust = rust.select("project", F.replace("package", F.lit("-"), F.lit("_")).alias("package"))
    return python.unionByName(npm).unionByName(go).unionByName(rust).distinct()


def local_packages(files: DataFrame) -> DataFrame:
    """project, package: folders (of files: project, path) with an __init__.py, below src/ in projects that have one, else at the top."""
    name = lambda under: F.regexp_extract("path", rf"^{under}([^/]+)/__init__\.py$", 1)
    each = files.groupBy("project").agg(
        F.bool_or(F.startswith("path", F.lit("src/"))).alias("nested"), F.collect_set(F.nullif(name("src/"), F.lit(""))).alias("below"), F.collect_set(F.nullif(name(""), F.lit(""))).alias("top")
    )
    return each.select("project", F.explode(F.when(F.col("nested"), F.col("below")).otherwise(F.col("top"))).alias("package"))


def unknown_imports(files: DataFrame, declarations: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """file_id, project, lang, line, module (AI002): imports of packages that neither the language nor the project (declarations: project, package; local: packages of its own) has.

    Projects without any declaration are left out. A Go path is known by each module path that it begins with. What a project names often meets its declarations once: the
    distinct names are joined, by project and name, and what is known is taken from the imports; both are equi joins. No row is compared with all declarations of its project."""
    said = imports(files).where(~is_builtin(F.col("lang"), F.col("module")) & ~F.col("module").isin(*BROUGHT))
    has = declarations.select("project").distinct()
    named = declarations.select("project", "package").unionByName(local.select("project", "package")) if local is not None else declarations.select("project", "package")
    parts = F.split("module", "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    asked = said.select("project", "lang", "module").distinct().withColumn("package", F.explode(F.when(F.col("lang") == "go", paths).otherwise(F.array("module"))))
    known = asked.join(named.distinct(), ["project", "package"], "left_semi").select("project", "lang", "module").distinct()
    return said.join(has, "project", "left_semi").join(known, ["project", "lang", "module"], "left_anti").select("file_id", "project", "lang", "line", "module")
