"""Findings in what diffs add, worked out by hand."""

from sievemill.operators import ingest

DIFF = """diff --git a/old.py b/old.py
--- a/old.py
+++ b/old.py
@@ -1,4 +1,4 @@
 import os
-eval(x)
+eval(y)
 eval(z)
+ok = 1
--- /dev/null
+++ b/new/one.py
@@ -0,0 +5,2 @@
+a = 1
+try:
@@ -9,2 +20,4 @@
 kept
+    exec(a)
-eval(gone)
 kept
+eval(b)
+++ b/guess
@@ -0,0 +1,3 @@
+import React from 'react';
+const a: string = b as any;
+eval(a);"""


def test_known_whole_and_unknown_by_added_lines(spark):
    files = spark.createDataFrame([(7, "old.py", "python", "import os\neval(y)\neval(z)\nok = 1"), (8, "other.py", "python", "eval(y)")], "file_id long, path string, lang string, code string")
    rows = [(1, i, t) for i, t in enumerate(DIFF.split("\n"))]
    diff = spark.createDataFrame(rows, "diff_id long, seq int, text string")
    got = ingest.scan_diff(diff, files).collect()
    assert {(r["path"], r["rule_id"], r["line"]) for r in got if r["rule_id"] in ("PY001", "PY002")} == {("old.py", "PY001", 2), ("new/one.py", "PY002", 21), ("new/one.py", "PY001", 23)}
    assert {r["line"] for r in got if r["path"] == "guess" and "any" in r["snippet"]} == {2}
    texts = {r["file_id"]["path"]: r for r in ingest.added_texts(spark.createDataFrame([(1, "b.RS", 3, "x"), (1, "b.RS", 1, "y"), (2, "b.RS", 9, None)], "diff_id long, path string, line int, added string")).collect() if r["file_id"]["diff_id"] == 1}
    assert texts["b.RS"]["code"] == "y\nx" and texts["b.RS"]["lang"] == "rust" and texts["b.RS"]["file_id"]["lines"] == [1, 3]
    assert ingest.scan_diff(diff.where("false"), files).isEmpty()


def test_all_files_unknown(spark):
    diff = spark.createDataFrame([(1, i, t) for i, t in enumerate(DIFF.split("\n"))], "diff_id long, seq int, text string")
    none = spark.createDataFrame([], "file_id long, path string, lang string, code string")
    assert {(r["path"], r["line"]) for r in ingest.scan_diff(diff, none).collect() if r["rule_id"] == "PY001"} == {("old.py", 2), ("new/one.py", 23)}
