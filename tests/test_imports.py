"""Imports of each language and what declares them, worked out by hand."""

from sievemill.operators import imports
from sievemill.sources.samples import IMPORT_SAMPLES


def _files(spark, rows):
    return spark.createDataFrame([(i, "p", lang, code) for i, (lang, code) in enumerate(rows)], "file_id long, project string, lang string, code string")


def test_imports_of_each_language(spark):
    got = imports.imports(_files(spark, [(lang, code) for lang, _, code in IMPORT_SAMPLES] + [("python", ""), ("go", None), ("go", "import ("), ("rust", "use a::b;use c::d;")])).collect()
    assert {(r["file_id"], r["line"], r["module"]) for r in got} == {
        *((0, n, m) for n, m in [(1, "os"), (2, "flask"), (3, "fast_api"), (6, "__future__"), (7, "pkg_7_core"), (9, "telnetlib"), (10, "Flask"), (11, "six"), (13, "quoted")]),
        *((1, n, m) for n, m in [(1, "react"), (2, "@scope/pkg-3"), (3, "fs"), (4, "node:test"), (7, "@other/far")]),
        *((2, n, m) for n, m in [(1, "express"), (1, "next"), (3, "path"), (3, "@scope"), (4, "left-pad")]),
        *((3, n, m) for n, m in [(2, "fmt"), (3, "github.com/x/single"), (5, "net/http"), (6, "golang.org/x/net/html"), (7, "golang.org/x/network"), (9, "github.com/a/pkg5/sub"), (10, "github.com/a/pkg55"), (12, "local/own")]),
        *((4, n, m) for n, m in [(1, "std"), (2, "serde_json"), (3, "tokio"), (4, "crate")]), (9, 1, "a"),
    }
    assert len(got) == len(set(map(tuple, got)))


MANIFESTS = [
    ("p", "requirements.txt", "Fast-API>=1\nflask\n"), ("p", "package.json", '{"dependencies":{"react":"1","@scope/pkg-3":"2"}}'),
    ("p", "go.mod", "module x\nrequire github.com/one/alone v1.2.0\nrequire (\n\tgolang.org/x/net v0.1.0 // indirect\n\tgithub.com/a/pkg5 v1.0.0\n)\n"),
    ("p", "Cargo.toml", "[package]\nname = \"x\"\n\n[dependencies]\nserde-json = \"1\"\ntokio.version = \"1\"\n\n[dev-dependencies]\nleft = { path = \"l\" }\n[features]\nouter = []\n"), ("q", "README.md", "flask"),
]


def test_declared_and_unknown(spark):
    declared = imports.declared(spark.createDataFrame(MANIFESTS, "project string, path string, text string"))
    assert {tuple(r) for r in declared.collect()} == {("p", m) for m in ["fast_api", "flask", "react", "@scope/pkg-3", "github.com/one/alone", "golang.org/x/net", "github.com/a/pkg5", "serde_json", "tokio", "left"]}
    own = imports.local_packages(spark.createDataFrame([("p", "src/pkg_7_core/__init__.py"), ("p", "Flask/__init__.py"), ("q", "top/__init__.py"), ("q", "top/in/__init__.py")], "project string, path string"))
    assert {tuple(r) for r in own.collect()} == {("p", "pkg_7_core"), ("q", "top")}
    files = _files(spark, [(lang, code) for lang, _, code in IMPORT_SAMPLES])
    got = {(r["file_id"], r["module"]) for r in imports.unknown_imports(files, declared, own).collect()}
    assert got == {(0, "Flask"), (0, "quoted"), (1, "@other/far"), (2, "express"), (2, "next"), (2, "@scope"), (2, "left-pad"), (3, "github.com/x/single"), (3, "golang.org/x/network"), (3, "github.com/a/pkg55")}
    assert imports.unknown_imports(files, declared.where("project = 'q'"), own).isEmpty()
    plan = imports.unknown_imports(files, declared, own)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
