"""Flows by variables, and taint across functions and files."""

import pytest

from weftline.operators import dataflow, taint
from weftline.sources import lexer

TABLES = (dataflow.SOURCES, dataflow.SINKS, dataflow.SANITIZERS)
FILES = {
    "chain.py": "def f1():\n    return input()\ndef f2():\n    return f1()\ndef f3():\n    return f2()\ndef f4():\n    return f3()\ndef go(cur):\n    q = f4()\n    cur.execute(q)\n",
    "use.py": "from lib.run import run as go, safe\nimport lib.run as r\nfrom lib import run\nx = request.args['q']\ngo(x)\nsafe(x)\nr.deep(1, text=x)\nrun.deep(x, 2)\n",
    "lib/__init__.py": "",
    "lib/run.py": "import os\ndef run(cmd):\n    return inner(0, cmd)\ndef inner(k, c):\n    os.system(c)\ndef safe(c):\n    os.system(shlex.quote(c))\ndef deep(n, text):\n    cur.execute(q=text)\n    cur.execute('x', params=text)\n",
    "apart.py": "def f():\n    a = input()\ndef g(b):\n    os.system(b)\ndef h():\n    a = input()\n    a = 'x'\n    os.system(a)\n",
    "loop.py": "for i in range(9):\n    z = y\n    y = w\n    w = v\n    v = input()\n    os.system(z)\n",
    "branch.py": "def f(c):\n    a = ''\n    if c:\n        a = input()\n    else:\n        a = 'x'\n    try:\n        b = str(a).strip()\n    except E:\n        b = ''\n    with open(b) as d:\n        os.system(f'{d}')\n",
    "method.py": "class A:\n    def get(self):\n        return input()\n    def run(self, x):\n        os.system(x)\n    def go(self):\n        self.run(self.get())\n",
    "twice.py": "def same(x):\n    return x\ndef f():\n    a = same(input())\n    b = same('x')\n    eval(b)\n    eval(a)\n",
    "self.py": "def down(n, x):\n    if n:\n        return down(n - 1, x)\n    return x\neval(down(3, input()))\n",
    "broken.py": "def (", "none.py": None,
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string").repartition(3)
    return {(r.file, r.line, r.variable, r.sink, r.source_file, r.source_line) for r in taint.python_flows_across(files, *TABLES).collect()}


def test_taint_across_functions_and_files(found):
    assert found == {
        ("chain.py", 11, "q", "sql", "chain.py", 2), ("lib/run.py", 5, "c", "command", "use.py", 4), ("lib/run.py", 9, "text", "sql", "use.py", 4), ("loop.py", 6, "z", "command", "loop.py", 5), ("branch.py", 12, "d", "command", "branch.py", 4),
        ("method.py", 5, "x", "command", "method.py", 3), ("twice.py", 7, "a", "code", "twice.py", 4), ("self.py", 5, "", "code", "self.py", 5),
    }


def test_facts_name_where_values_come_from():
    rows = taint.facts_of("a.py", "def f(a, *, b):\n    return g(a, k=b)\n", TABLES)
    shown = {(what, target.split(taint.SEP)[0], origin.split(taint.SEP)[0]) for _, _, what, target, origin in rows}
    assert shown == {("def", "f", ""), ("param", "0", "a"), ("param", "=a", "a"), ("param", "=b", "b"), ("call", "a.py", "g"), ("flow", "arg", "param"), ("flow", "return", "call")}


def test_flows_follow_variables_within_a_function(spark):
    text = """function one() {
  const a = req.query.id;
  const b = a + 1;
  let { c, d: e } = b;
  db.query(e);
}
function two(x) {
  db.query(x);
  const a = 1;
  const q = escape(req.body.x);
  const p = q;
  db.query(p);
  eval(req.query.y);
}
"""
    rows = [("m.js", k, t) for k, t in enumerate(text.split("\n"), 1)]
    lines = spark.createDataFrame(rows, "file string, line long, text string")
    spans = lexer.scopes(lexer.tokens(spark.createDataFrame([("m.js", text, "javascript")], "path string, content string, language string"))).select("file", "name", "line", "end_line")
    spans = spans.withColumnsRenamed({"line": "first", "name": "scope"})
    scoped = lines.join(spans, "file").where("line BETWEEN first AND end_line").select("file", "line", "text", "scope")
    got = {(r.source_line, r.sink_line, r.sink, r.sanitized) for r in dataflow.flows(scoped).collect()}
    assert got == {(2, 5, "sql", False), (10, 12, "sql", True), (13, 13, "code", False)}
