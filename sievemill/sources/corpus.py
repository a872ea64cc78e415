"""Tables of source files: from folders, and derived from the document table for tests and registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

#: Languages by file extension.
EXTENSIONS = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "go": "go", "java": "java", "cs": "csharp"}
#: Folders that hold others' code or none.
VENDORED = "node_modules .git .venv venv __pycache__ dist build target .tox .mypy_cache .pytest_cache vendor site-packages".split()


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    out = F.lit(None).cast("string")
    for name, lang in EXTENSIONS.items():
        out = F.when(extension == name, lang).otherwise(out)
    return out


def scan_files(spark: SparkSession, folder: str, lang: str | None = None) -> DataFrame:
    """path, lang, code of the source files below a folder, without vendored folders. One row per file; no cap on their number."""
    glob = "*.{" + ",".join(e for e, name in EXTENSIONS.items() if lang in (None, name)) + "}"
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), language_of(path).alias("lang"), F.col("value").alias("code")).where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, VENDORED))))


#: Code samples: language, folder and code. With hits, misses, and hits in literals and comments.
SNIPPETS = [
    ("python", "api", "import os\nimport numpy\nfrom typing import List\n\ndef load(path, seen=[]):\n    try:\n        return eval(open(path).read())\n    except:\n        pass\n\npassword = \"hunter22\"\n"),
    ("python", "core", "from __future__ import annotations\n\n\ndef add(a: int, b: int) -> int:\n    \"\"\"Adds; never eval(x).\"\"\"\n    return a + b\n\n\ndef twice(a: int) -> int:\n    # eval(a) would be bad\n    return add(a, a)\n"),
    ("python", "db", "import requests\nimport yaml\n\ndef fetch(url, user):\n    r = requests.get(url)\n    ok = requests.get(url, timeout=3)\n    data = yaml.load(r.text)\n    safe = yaml.load(r.text, Loader=yaml.SafeLoader)\n    query = \"SELECT * FROM users WHERE name = '\" + user\n    return session.query(User), f\"DELETE FROM t WHERE id = {user}\"\n"),
    ("python", "tests", "import pytest\n\ndef test_add():\n    assert add(1, 41) == 42\n\ndef test_nothing():\n    pass\n\ndef test_copy():\n    assert add(1, 41) == 42\n\ndef test_true():\n    assert True\n"),
    ("python", "jobs", "import time\nimport subprocess\n\nasync def work(items, db):\n    for item in items:\n        row = db.execute(\"SELECT 1\")\n        time.sleep(1)\n        subprocess.run(\"ls\", shell=True)\n    while True:\n        items.append(1)\n    return items\n    print('never')\n"),
    ("python", "models", "class Base(ABC):\n    @abstractmethod\n    def run(self):\n        pass\n\n\nclass Only(Base):\n    def run(self):\n        raise NotImplementedError\n\n    def _hidden(self, a):\n        for x in a:\n            if x:\n                for y in x:\n                    if y:\n                        while y:\n                            y = y - 1\n        return a\n"),
    ("python", "util", "import pickle\nimport hashlib\n\ndef readAll(f):  # type: ignore\n    return pickle.load(f)\n\ndef checkPassword(p):\n    x: int = 1  # type: ignore[assignment]\n    return hashlib.md5(password)\n"),
    ("typescript", "web", "interface Props { name: string }\nexport const f = (a: any) => {\n  // @ts-ignore\n  const b = a as any;\n  el.innerHTML = a!.name;\n  try { eval(b) } catch (e) {}\n};\n"),
    ("typescript", "api", "export function load(req: Request): void {\n  const s = `SELECT * FROM t WHERE id = ${req.id}`;\n  // @ts-ignore: legacy types\n  fetch(req.url);\n  return;\n}\n"),
    ("typescript", "ui", "import { useState } from 'react';\nexport function Box(props: { on: boolean }) {\n  if (props.on) {\n    const [a, b] = useState(0);\n  }\n  return items.map(i => <li>{i}</li>);\n}\n"),
    ("javascript", "web", "var a = 1;\nfunction show(x) {\n  document.write(x);\n  /* var b = 2; eval(x) */\n  const s = 'var c = 3';\n  return obj.__proto__;\n}\nmodule.exports = show;\n"),
    ("javascript", "api", "const path = require('path');\nconst run = (req, res) => {\n  res.redirect(req.query.to);\n  path.join(root, req.params.file);\n  console.log(`done ${req.id}`);\n};\n"),
    ("rust", "core", "use std::mem;\npub fn get(x: Option<i32>) -> i32 {\n    let y = x.unwrap();\n    // SAFETY: checked above\n    unsafe { mem::transmute(y) }\n}\n\n\n\nfn later() {\n    unsafe { todo!() }\n}\n"),
    ("rust", "tests", "#[test]\nfn works() {\n    let a = Some(1).unwrap();\n    match a { 1 => {}, _ => panic!(\"no\") }\n}\n"),
    ("go", "api", "package main\nimport \"fmt\"\nfunc init() {}\nfunc Load(r *http.Request) {\n\t_ = save(r)\n\tq := fmt.Sprintf(\"SELECT %s\", r.URL)\n\tgo func() { panic(q) }()\n\thttp.ListenAndServe(\":80\", nil)\n}\n"),
    ("go", "core", "package core\nfunc Add(a int, b int) int {\n\t// panic(1)\n\treturn a + b\n}\n"),
    ("java", "app", "import java.util.*;\npublic class App {\n  public static void main(String[] a) {\n    if (a[0] == \"x\") System.exit(1);\n    try { run(); } catch (Exception e) { }\n    String q = String.format(\"SELECT %s\", a[0]);\n  }\n}\n"),
    ("csharp", "app", "using System;\nnamespace App {\n  public class Job : Base {\n    public async void Run(string user) {\n      var f = new BinaryFormatter();\n      Thread.Sleep(5);\n      var q = $\"SELECT {user}\";\n      new Regex(user);\n    }\n  }\n}\n"),
]


def files(spark: SparkSession, sf_dir: str, samples: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """file_id, project, path, lang, code: each document's whole text as comment lines below a code sample."""
    samples = samples or SNIPPETS
    snippets = spark.createDataFrame([(i, *row) for i, row in enumerate(samples)], "sid int, lang string, folder string, snippet string")
    docs = table(spark, sf_dir, "documents").withColumn("sid", (F.col("doc_id") % len(samples)).cast("int"))
    mark = F.when(F.col("lang") == "python", "# ").otherwise("// ")
    extension = F.expr("element_at(map('python', 'py', 'typescript', 'ts', 'javascript', 'js', 'rust', 'rs', 'go', 'go', 'java', 'java', 'csharp', 'cs'), lang)")
    return docs.select("doc_id", "source", "sid", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(snippets), "sid").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("project"), F.concat(F.lit("src/"), F.col("folder"), F.lit("/f"), F.col("doc_id"), F.lit("."), extension).alias("path"), "lang",
        F.concat("snippet", mark, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), mark))).alias("code"),
    )


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def files_sql(samples: list[tuple[str, str, str]]) -> str:
    """The same table for DuckDB."""
    values = ", ".join(f"({i}, {', '.join(map(quoted, row))})" for i, row in enumerate(samples))
    mark = "CASE s.lang WHEN 'python' THEN '# ' ELSE '// ' END"
    return f"""snippets(sid, lang, folder, snippet) AS (VALUES {values}),
    files AS (SELECT doc_id AS file_id, source AS project, 'src/' || folder || '/f' || doc_id || '.' ||
        CASE s.lang WHEN 'python' THEN 'py' WHEN 'typescript' THEN 'ts' WHEN 'javascript' THEN 'js' WHEN 'rust' THEN 'rs' WHEN 'csharp' THEN 'cs' ELSE s.lang END AS path, s.lang,
        snippet || {mark} || replace(coalesce(text, ''), chr(10), chr(10) || {mark}) AS code
        FROM documents d JOIN snippets s ON d.doc_id % {len(samples)} = s.sid)"""


FILES_SQL = files_sql(SNIPPETS)
