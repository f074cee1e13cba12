import pytest

from weftline.operators import finders
from weftline.sources import code

FILES = [
    ("app.py", "import flask\n\n@app.route('/items')\ndef items():\n    return open('x').read()\n    print(1)\n\n\ndef pure(a, b):\n    if a:\n        return b\n    return a\n\n\ndef unused():\n    pass\n\n\nif __name__ == '__main__':\n    pure(1, 2)\n    getattr(app, 'items')\n", "python"),
    ("tests/test_app.py", "from app import pure\n\ndef test_pure():\n    assert pure(0, 1) == 0\n", "python"),
    ("web.js", "app.get('/users/:id', f)\nconst s = createSlice({})\nfetch('/items')\n", "javascript"),
]


@pytest.fixture(scope="module")
def lines(spark):
    return code.lines(spark.createDataFrame(FILES, "path string, content string, language string")).cache()


def test_maps(lines):
    assert {(r.framework, r.method, r.path) for r in finders.routes(lines).collect()} == {("flask", "ANY", "/items"), ("express", "GET", "/users/:id")}
    assert {r.kind for r in finders.marked(lines, finders.STORES).collect()} == {"redux"}
    assert {(r.kind, r.file) for r in finders.marked(lines, finders.ENTRIES).collect()} == {("main", "app.py"), ("test_entry", "tests/test_app.py")}


def test_definitions(lines):
    defs, calls = code.definitions(lines), code.calls(lines)
    got = {r.name: (r.effects, r.pure) for r in finders.effects(lines, defs).collect()}
    assert got["items"] == ("io", False) and got["pure"] == ("", True)
    assert {r.name for r in finders.unused_definitions(defs, calls).collect()} == {"items", "unused"}
    assert {r.name: r.tests for r in finders.test_map(defs, calls).collect()} == {"items": 0, "pure": 1, "unused": 0}
    assert finders.coverage(finders.test_map(defs, calls)).first().percent == 33.3
    assert [s.name for s in finders.outline(defs).where("file = 'app.py'").first().symbols] == ["items", "pure", "unused"]


def test_lines(lines):
    assert [(r.file, r.line) for r in finders.unreachable(lines).collect()] == [("app.py", 6)]
    assert {(r.line, r.kind) for r in finders.mentions(lines.where("file = 'app.py'"), "items").collect()} == {(3, "string"), (4, "definition"), (21, "dynamic")}


def test_symbols(spark):
    body = "\n".join(f"    x{i} = {i}" for i in range(60))
    deep = "".join("    " * (i + 1) + f"if a{i}:\n" for i in range(6)) + "    " * 7 + "pass\n"
    files = spark.createDataFrame([("a.py", f"def long(a, b, c, d, e, f):\n{body}\n\ndef deep():\n{deep}", "python")], "path string, content string, language string")
    symbols = code.python_symbols(files)
    assert {(r.name, r.category) for r in finders.smells(symbols).collect()} == {("long", "long_function"), ("long", "many_parameters"), ("deep", "deep_nesting")}
    assert [r.name for r in finders.complexity(symbols).collect()] == ["deep", "long"]
    assert finders.complexity_summary(symbols).first().functions == 2


def test_decide(spark):
    nodes = spark.createDataFrame([("a", "active"), ("B", "dead"), ("c", "active"), ("C", "dead")], "name string, status string")
    assert [finders.decide(nodes, n).first().action for n in ("x", "a", "b", "c")] == ["CREATE", "EXTEND", "LIST_FIRST", "ASK"]
