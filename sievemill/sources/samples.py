"""Code samples for the checks that look around a line: hits, near misses, and hits in comments."""

SAMPLES = [
    ("python", "core", "class Base(ABC):\n    @abstractmethod\n    def run(self) -> int:\n        raise NotImplementedError\n\n    def later(self) -> int:\n        raise NotImplementedError\n\n    def soon(self):\n        # TODO write it\n        pass\n\n    def fine(self):\n        pass\n\n    def dots(self):\n        ...  # fixme\n\n\nclass Only(Base):\n    x = 1\n\n\nclass Wide(Generic[A, B, C, D, G, H]):\n    y = 2\n"),
    ("python", "util", "def make_box(kind):\n    if kind:\n        return Box(1)\n    return Box(2)\n\n\ndef get_other(kind):\n    if kind:\n        return Box(1)\n    return Bag(2)\n\n\ndef _hidden(a):\n    return a\n\n\n@property\ndef size(self):\n    return 1\n"),
    ("python", "jobs", "import requests\nimport numpy as np\nimport os, sys\nfrom typing import TYPE_CHECKING, Any as Every\n\ndef work(x) -> None:\n    try:\n        requests.get(x)\n    except ValueError:\n        pass\n    except:\n        return None\n    except KeyError as e:\n        raise RuntimeError(x)\n    return sys.path\n    print('never')\n"),
    ("python", "db", "async def pull(rows, cursor):\n    for row in rows:\n        # cursor.execute('no')\n        cursor.execute('SELECT 1')\n        re.compile('x')\n    time.sleep(3)\n    while True:\n        rows.append(1)\n    while True:\n        if len(rows) > 9:\n            break\n        rows.append(2)\n"),
    ("python", "api", "from fastapi import FastAPI\n\n@app.get('/a')\ndef a(x):\n    return hash(password)\n\n@router.post('/b', response_model=B)\nasync def b(x) -> B:\n    h = hashlib.md5(secret_key)\n    return eval(f'{x}')\n\n@app.put('/c')\nasync def c(x):\n    q = f\"SELECT a FROM t WHERE x = {x}\"\n    return subprocess.run(f'ls {x}')\n"),
    ("python", "tests", "import pytest\n\ndef test_one():\n    pass\n\ndef test_two():\n    assert True\n\ndef test_three():\n    global seen\n    run()\n\n@patch('a')\n@patch('b')\n@patch('c')\n@patch('d')\ndef test_four(a, b, c, d):\n    with pytest.raises(Exception):\n        run()\n"),
    ("python", "tests", "def test_empty():\n    assert run([]) == []\n\ndef test_more():\n    self.assertEqual(run(1), 1)\n\ndef test_last():\n    ...\n"),
    ("python", "models", "class Big:\n" + "".join(f"    def m{i}(self):\n        return {i}\n" for i in range(12)) + "\n\ndef deep(a):\n    for x in a:\n        if x:\n            with x:\n                while x:\n                    try:\n                        x = 1\n                    finally:\n                        x = 2\n"),
    ("python", "db", "def rows(session):\n    a = Model.objects.all()\n    b = session.query(User).all()\n    def validate_it(x):\n        return True\n    return eval(a), 'eval(b)'\n\ndef bad(x=[], y={}):\n    exec(x)\n"),
    ("go", "dup", "package dup\nfunc One(a int) int {\n\tx := a // first\n\ty := x + 1\n\tz := y + 2\n\tif z > 3 { z = 4 }\n\tw := z\n\treturn w\n}\n\nfunc Two(a int) int {\n\tx := a\n\ty := x + 1\n\tz := y + 2\n\tif z > 3 { z = 4 }\n\tw := z\n\treturn w // same\n}\n"),
    ("typescript", "ui", "import { useState } from 'react';\nexport function Box(props: { on: boolean }) {\n  const [a, b] = useState(0);\n  // useEffect(x)\n  return items.map(i => <li onClick={f}>{i}</li>);\n}\n\nfunction small() {\n  return items.map(i => <li key={i}>{i}</li>);\n}\n"),
    ("typescript", "web", "'use client';\nimport Link from 'next/link';\nexport function Page() {\n  useEffect(() => {});\n  if (a) {\n    for (const x of y) {\n      while (z) {\n        if (q) {\n          run();\n        }\n      }\n    }\n  }\n}\nconst all = await db.findMany({});\nconst one = await repo.findMany({ take: 5 });\n"),
    ("javascript", "api", "const run = (req) => {\n  try { a(); } catch (e) {}\n  try { b(); } catch (e) { log(e); }\n  for (const r of rows) {\n    await users.findOne(r);\n  }\n};\n"),
    ("go", "core", "package core\nfunc All() {\n\tdb.Query(\"SELECT * FROM t\")\n\tdb.Query(\"SELECT * FROM t LIMIT 5\")\n\tfor i := range xs {\n\t\tdb.QueryRow(\"x\")\n\t\tos.Getenv(\"A\")\n\t}\n\tfor {\n\t\tout = append(out, 1)\n\t\tq.Add(2)\n\t}\n}\n"),
    ("csharp", "app", "class A {\n  async Task Run() {\n    var x = db.Items.ToListAsync();\n    var y = db.Items.ToList().Take(3);\n    Thread.Sleep(5);\n    return t.Result;\n  }\n}\n"),
]

#: Scripts for the checks on brackets: braces in literals and comments, in types, unclosed blocks, hooks in and out of place.
SCRIPTS = [
    ("typescript", "ui", "import { useState } from 'react';\nexport function Box(props: { on: boolean }): { a: number } {\n  const s = \"}{\";  // }\n  if (props.on) {\n    const [a, b] = useState<string>(0);\n    for (const x of y) { while (z) { run(`${\"}\"} }`); } }\n  }\n  else { useOther(1); }\n  useFine(2);\n  const inner = async (q) => {\n    useInner(3);\n  };\n  if (x) useBare(4);\n  return items.map(i => <li>{i}</li>);\n}\n"),
    ("typescript", "api", "export async function load<T>(\n  id: number,\n  done: (x: T) => void\n): Promise<T> {\n  if (id) {\n    switch (id) {\n      case 1: { return go(id); }\n    }\n  }\n}\nfunction _own(a) { return a }\nfunction plain(a) {\n  /* } */\n  return { b: { c: a } };\n}\n"),
    ("javascript", "web", "const one = x => {\n  return x;\n};\nexport const two = async (a, b) => {\n  try {\n    await one(a);\n  } catch (e) {\n    log(e);\n  }\n};\nconst three = (a) => a + 1;\nfunction open() {\n  while (a) {\n    b('(');\n"),
    ("javascript", "ui", "const React = require('react');\nfunction Page() {\n  React.useEffect(() => { useDeep(); });\n  function Part() { return useMemo(f); }\n  while (a) { if (b) { c(); } useLoop(); }\n  return useLast();\n}\n}\nfunction After() { return useTop(); }\n"),
    ("python", "core", "def f():\n    return {'a': 1}\n"),
]

#: Imports of each language: built in, declared by a manifest of reports.py, unknown, relative, several on a line, and in comments.
IMPORT_SAMPLES = [
    ("python", "core", "import os\nimport flask, numpy\nfrom fast_api.routing import Route\nfrom . import near\nfrom .deep import far\nfrom __future__ import annotations\nimport pkg_7_core\n    import indented\nimport telnetlib\nfrom Flask import upper\nimport six\n'''\nimport quoted\n'''\n"),
    ("typescript", "ui", "import React, { useState } from 'react';\nimport type { X } from \"@scope/pkg-3/deep/er\";\nimport fs from 'fs';\nimport test from 'node:test';\nimport near from './near';\nimport 'effects';\nimport far from '@other/far';\n// import gone from 'gone';\nimport {\n  a,\n} from 'lines';\nexport const y = 1;\n"),
    ("javascript", "api", "const a = require('express'), b = require( \"next/link\" );\nconst c = require('../near');\nlet d = require('path'); let e = require('@scope');\n// require('left-pad')\n"),
    ("go", "core", "package core\nimport \"fmt\"\nimport \"github.com/x/single\"\nimport (\n\t\"net/http\"\n\tnamed \"golang.org/x/net/html\"\n\t\"golang.org/x/network\"\n\n\t// \"github.com/a/pkg5/sub\"\n\t_ \"github.com/a/pkg55\"\n)\nimport (\"local/own\")\n"),
    ("rust", "core", "use std::io;\nuse serde_json::Value;\n  use tokio::{fs};\nuse crate::own;\nuse left;\npub use outer::x;\n"),
    ("java", "app", "import java.util.List;\nimport org.unknown.Thing;\n"),
]

#: Code with fixes: one and several on a line, of rules with a text alone, in comments and strings, and lines whose patch isn't met.
FIX_SAMPLES = [
    ("python", "core", "from typing import List, Dict\nfrom typing import Optional as O; x: Optional[int] = Optional[str]\ndef f(a=[]):\n    try:\n        r.get(u, verify=False); s.get(u, verify = False)\n    except:\n        pass\n    # except:\n    print('except:')\nfrom typing import Set; y: Set[int]\n"),
    ("javascript", "web", "var a = 1; var b = 2;\nif (a == b) { eval(a); }\nif (a != b && eval(b) == 3) { var c = eval(a) != eval(b); }\n// var d = 4;\nlet e = 'var f';\n"),
    ("python", "jobs", "password = 'hunter2hunter2'\nos.system('rm ' + path)\ncursor.execute('SELECT * FROM t WHERE a = ' + b)\nx = pickle.loads(data)\n"),
    ("typescript", "ui", "const a = b as any;\nvar q = x as any;\nconst s = `SELECT * FROM t WHERE a = ${b}`;\n"),
    ("rust", "core", "fn a() { b.unwrap(); panic!(\"x\"); }\nfn c() { todo!(); }\n"),
    ("go", "core", "package core\n\nfunc a() { x, _ := b() }\n"),
]
