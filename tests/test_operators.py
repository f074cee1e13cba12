import pandas as pd

from weftline import plugins
from weftline.functions import text as fn
from weftline.operators import dataflow, dependencies, findings, formats, graph, search, snapshots, web
from weftline.sources import code
from weftline.streaming import watch
from pyspark.sql import functions as F

import json
import random
import re
import xml.etree.ElementTree as ET

import pytest


def col(spark, rows, schema, c):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(c).collect()]


def test_text_functions(spark):
    assert col(spark, [("getUserName and the HTTP2x a",)], "t string", fn.tokens(F.col("t"))) == [["get", "user", "name", "http2x"]]
    assert col(spark, [("get_user_name",), ("getUserName",), ("_x_y",), ("plain",)], "t string", fn.alternate_case(F.col("t"))) == ["getUserName", "get_user_name", "_xY", "plain"]
    assert col(spark, [("a/b:c.py:12:f",), ("x.py:y:f",)], "t string", fn.node_line(F.col("t"))) == [12, 0]
    assert col(spark, [("a/b:c.py:12:f",)], "t string", fn.node_file(F.col("t"))) == ["a/b:c.py"]
    assert col(spark, [("1.10.0", "<1.9"), ("1.2", ">=1.2.0"), ("v2.0-rc1", "=2.0"), ("3", "!=3.0")], "v string, r string", fn.in_range(F.col("v"), F.col("r"))) == [False, True, True, False]
    assert col(spark, [(["b", "a", "c"],), ([],)], "c array<string>", fn.rotated(F.col("c"))) == [["a", "c", "b"], []]
    assert col(spark, [("tests/a.py",), ("src/a.test.ts",), ("src/contest.py",)], "p string", fn.is_test_file(F.col("p"))) == [True, True, False]


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source_id string, target_id string")


def test_traversal_and_cycles(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "a"), ("b", "a")])
    start = spark.createDataFrame([("a",)], "node_id string")
    found = graph.traverse(e, start, 5)
    assert {(r.node_id, r.depth) for r in found.collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert {(r.node_id, r.depth) for r in graph.revisits(e, found, start, 5).collect()} == {("a", 2), ("a", 3)}
    assert {r.cycle for r in graph.cycles(e, 4).collect()} == {"a -> b", "a -> b -> c", "d"}
    assert {(r.source_id, r.target_id): r.dist for r in graph.closure(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d")])).collect()} == {("a", "b"): 1, ("b", "c"): 1, ("c", "d"): 1, ("a", "c"): 2, ("b", "d"): 2, ("a", "d"): 3}
    assert graph.traverse(e, start.where("false"), 3).count() == 0


def test_paths(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "s"), ("c", "a")])
    got = {r.path for r in graph.paths(e, spark.createDataFrame([("a",)], "node_id string"), spark.createDataFrame([("s",)], "node_id string"), 5).collect()}
    assert got == {"a -> b -> c -> s", "a -> c -> s"}
    trace = {(r.node_id, r.path) for r in graph.trace(e, spark.createDataFrame([("a",)], "node_id string"), 5).collect()}
    assert trace == {("a", "a"), ("b", "a -> b"), ("c", "a -> c"), ("s", "a -> c -> s")}


FILES = [
    ("src/app.py", "import os\nfrom lib import util\n\ndef handle(request):\n    x = request.args['q']\n    if x and len(x) > 2:\n        for i in x:\n            print(i)\n    cur.execute('select ' + x)\n    return util.helper(x)\n", "python"),
    ("src/lib.py", "def util():\n    return 1\n\nclass Thing:\n    def helper(self, a, b=[]):\n        # TODO later\n        return a\n", "python"),
    ("web/a.js", "import { b } from './b'\nexport function start() {\n  console.log(1)\n  b()\n}\n", "javascript"),
    ("web/b.js", "export async function b() {\n  return fetch('/api')\n}\n", "javascript"),
    ("bad.py", "def (:\n", "python"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, content string, language string")


def test_code_graph(files):
    lines = code.lines(files)
    names = {r.name for r in code.definitions(lines).collect()}
    assert {"handle", "util", "Thing", "helper", "start", "b"} <= names
    calls = code.calls(lines)
    assert {"print", "cur.execute", "util.helper", "console.log", "b", "fetch"} <= {r.to_fn for r in calls.collect()}
    resolved = {(r.to_fn, r.target_id) for r in graph.resolve_calls(code.definitions(lines), calls).collect()}
    assert ("util.helper", "src/lib.py:5:helper") in resolved and ("b", "web/b.js:1:b") in resolved and ("fetch", None) in resolved
    assert {(r.source_id, r.target_id) for r in code.resolve_imports(code.imports(lines), files).collect()} == {("src/app.py", "src/lib.py"), ("web/a.js", "web/b.js")}


def test_python_symbols(files):
    got = {r.name: r for r in code.python_symbols(files).collect()}
    assert got["handle"].cyclomatic == 4 and got["handle"].nesting == 2 and got["helper"].parameters == 3 and got["Thing"].kind == "class"


def test_taint_and_rules(files, spark):
    assert {(r.file, r.line, r.source, r.sink) for r in dataflow.python_taint(files).collect()} == {("src/app.py", 9, "request", "sql")}
    got = dataflow.rule_matches(files, [{"id": "call", "pattern": "cur.execute($Q)"}, {"id": "todo", "regex": "TODO"}]).collect()
    assert {(r.rule_id, r.line) for r in got} == {("call", 9), ("todo", 6)} and [r.bindings for r in got if r.rule_id == "call"] == [{"$Q": "'select ' + x"}]
    flows = dataflow.flows(code.lines(files)).collect()
    assert [(r.file, r.source_line, r.sink_line, r.sink, r.sanitized) for r in flows] == [("src/app.py", 5, 9, "sql", False)]


def test_discover(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "node_modules/b.js": "1", "c.txt": "t", "src/d.rs": "fn main() {}"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {(r.path.rsplit("/", 1)[1], r.language) for r in code.discover(spark, str(tmp_path)).collect()} == {("a.py", "python"), ("d.rs", "rust")}
    paths = spark.createDataFrame([("a/build/x.py",), ("keep.log",), ("b.log",), ("src/a/b.tmp",)], "p string")
    assert [r[0] for r in paths.select(code.ignored(F.col("p"), ["# c", "build/", "*.log", "!keep.log", "/src/**/*.tmp"])).collect()] == [True, False, True, True]


@pytest.mark.parametrize(
    "name, content, want",
    [
        ("requirements.txt", "a==1.0\nb[x]>=2.1 # c\n# d==3\n", {("a", "1.0"), ("b", "2.1")}), ("package.json", '{"dependencies": {"x": "^1.2.3"}, "devDependencies": {"y": "~2.0"}}', {("x", "1.2.3"), ("y", "2.0")}),
        ("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.1"\n', {("serde", "1.0.1")}), ("go.mod", "module m\n\nrequire (\n\tgithub.com/a/b v1.2.0 // indirect\n)\n", {("github.com/a/b", "1.2.0")}),
        ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>3</version></dependency>", {("g:a", "3")}), ("Gemfile.lock", "GEM\n  specs:\n    rails (7.0.1)\n", {("rails", "7.0.1")}),
        ("pyproject.toml", '[project]\ndependencies = ["numpy>=1.2", "x"]\n', {("numpy", "1.2"), ("x", "")}), ("yarn.lock", '"a@^1.0":\n  version "1.0.4"\n', {("a", "1.0.4")}), ("build.gradle", "implementation 'g:a:1.1'", {("g:a", "1.1")}),
        ("mix.lock", '%{"plug": {:hex, :plug, "1.2.3", "x"}}', {("plug", "1.2.3")}), ("composer.lock", '{"packages": [{"name": "a/b", "version": "v2.0"}]}', {("a/b", "2.0")}), ("Package.resolved", '{"pins": [{"identity": "nio", "state": {"version": "2.1"}}]}', {("nio", "2.1")}),
        ("package.json", "{broken", set()),
    ],
)
def test_manifests(name, content, want):
    assert {(n, v) for n, v, *_ in code.dependencies_of(f"x/{name}", content)} == want


def test_findings(spark):
    lines = spark.createDataFrame([("f", 1, "# ignore-finding-next: eval -- checked by hand"), ("f", 2, "eval(x)"), ("f", 3, "exec(y)  # ignore-finding"), ("f", 4, "eval(z) # ignore-finding: other")], "file string, line long, text string")
    found = findings.suppress(findings.scan(lines), lines)
    assert {(r.line, r.suppressed) for r in found.collect()} == {(2, True), (3, True), (4, False)}
    assert {r.line: r.reason for r in found.collect()} == {2: "checked by hand", 3: None, 4: None}
    assert findings.suppress(findings.scan(lines), lines, ("no-such-mark",)).where("suppressed").count() == 0
    assert findings.gate(found.where("NOT suppressed"), "critical").first().passed is False
    doc = json.loads(formats.sarif(formats.rows_of(found)))
    assert len(doc["runs"][0]["results"]) == 3
    assert len(ET.fromstring(formats.junit(formats.rows_of(found)))[0]) == 3
    assert json.loads(formats.gitlab(formats.rows_of(found)))["vulnerabilities"][0]["severity"] == "Critical"
    for style in ("text", "emacs", "vim", "markdown", "json", "compact"):
        assert formats.text_lines(found, style).count() == 3
    assert formats.envelope([{"a": 1, "b": 2}] * 5, "x", top=2, lite=["a"]) == {"status": "ok", "command": "x", "stats": {"total": 5, "shown": 2}, "items": [{"a": 1}] * 2, "truncated": True}
    assert ET.fromstring(formats.graphml([{"node_id": "a<", "node_type": "t", "name": "n"}], [{"source_id": "a<", "target_id": "a<", "edge_type": "CALLS"}])) is not None


def test_web(spark):
    refs = spark.createDataFrame([("a", "class", "html", "1"), ("a", "class", "css", "s"), ("b", "class", "css", "s"), ("i", "id", "html", "1"), ("i", "id", "html", "2"), ("j", "id", "js", "x")], "name string, entry_type string, category string, path string")
    assert {r.name: r.status for r in web.frontend_status(refs).collect()} == {"a": "duplicate_ref", "b": "dead", "i": "collision", "j": "active"}
    assert {(r.name, r.problem) for r in web.missing_refs(refs).collect()} == {("b", "css_without_html"), ("j", "js_without_html")}
    sheets = spark.createDataFrame([("s.css", ":root{--x: 1; --y: 2} a{color: var(--x) !important; z-index: 99999} @keyframes k{} @keyframes m{} b{animation: m 1s}")], "path string, content string")
    assert {(r.category, r.name) for r in web.css_findings(sheets).collect()} == {("unused_variable", "--y"), ("orphan_keyframes", "k"), ("important", "color"), ("z_index", "99999")}
    pages = spark.createDataFrame([(1, "<img src=a><img src=b alt='x'><h1>a</h1><h3>b</h3>"), (2, None)], "page_id long, html string")
    assert web.images(pages).count() == 1 and [tuple(r) for r in web.heading_skips(pages).collect()] == [(1, 1, 3, 1)]


def test_snapshots(spark):
    old = spark.createDataFrame([("f", "a", 1), ("g", "b", 2)], "file string, name string, line int")
    parsed = spark.createDataFrame([("g", "c", 3)], "file string, name string, line int")
    changed = spark.createDataFrame([("g",)], "path string")
    assert {tuple(r) for r in snapshots.refresh(old, parsed, changed).collect()} == {("f", "a", 1), ("g", "c", 3)}
    assert {tuple(r) for r in snapshots.merge_snapshot(old, parsed, ["file"]).collect()} == {("f", "a", 1), ("g", "b", 2)}
    now = spark.createDataFrame([("p", 10.5, "h2"), ("q", 9.0, "h")], "path string, mtime double, content_hash string")
    then = spark.createDataFrame([("p", 10.0, "h1"), ("q", 8.0, "h")], "path string, mtime double, content_hash string")
    assert [tuple(r) for r in snapshots.stale(now, then).collect()] == [("p", 0.5)]
    assert snapshots.set_hash(now).first() == snapshots.set_hash(now.orderBy("path", ascending=False)).first()


def test_search(spark):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["def a():", "x", "# 1", "# 2", "# 3", "def b():", "y hit"], 1)], "file string, line long, text string")
    assert [tuple(r) for r in search.comment_runs(lines).collect()] == [("f", 3, 3)]
    assert [r.enclosing for r in search.enclosing(lines).orderBy("line").collect()] == ["a", "a", "a", "a", "a", "b", "b"]
    assert [(r.line, r.col) for r in search.regex_lines(lines, "HIT", ignore_case=True).collect()] == [(7, 3)]
    assert search.prefilter([r"eval\(", r"os\.system"]) == "eval|system" and search.prefilter([r"\d+"]) == ""


def test_dependencies(spark):
    lines = spark.createDataFrame([("f", 1, "process.env.API_KEY + os.environ['HOME_DIR']")], "file string, line long, text string")
    got = dependencies.env_audit(lines, spark.createDataFrame([("HOME_DIR",), ("OLD",)], "name string"))
    assert {tuple(r) for r in got.collect()} == {("API_KEY", "undocumented"), ("OLD", "unused")}


def test_plugins():
    r = plugins.Registry()
    r.add("rule_pack", "mine", [("a", "b", "info", "x", "m")])
    assert r.rules() == [("a", "b", "info", "x", "m")] and r.names("rule_pack") == ["mine"]
    for kind, name, value, needs in (("odd", "x", len, "0.0.0"), ("engine", "Bad name", len, "0.0.0"), ("engine", "x", 3, "0.0.0"), ("engine", "x", len, "9.0.0"), ("rule_pack", "x", [("a",)], "0.0.0")):
        with pytest.raises(plugins.PluginError):
            r.add(kind, name, value, needs)


def once(writer):
    """Run a stream over what there is, and end it."""
    q = writer.trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()


def test_staleness_stream(spark, tmp_path):
    folder, got = tmp_path / "in", []
    folder.mkdir()
    for name, text in (("a.py", "x = 1\n"), ("b.py", "y = 1\n")):
        (folder / name).write_text(text)
        keep = lambda df, _: got.extend((r.path.rsplit("/", 1)[1], r.version, r.state) for r in df.where("state != 'expired'").collect())
        once(watch.staleness(watch.watch_files(spark, str(folder)), ttl_ms=None).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / "c1")))
    assert sorted(got) == [("a.py", 1, "new"), ("b.py", 1, "new")]


def test_refresh_stream_equals_full_run(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    parse = lambda df: code.definitions(code.lines(df.withColumn("language", code.language(F.col("path")))))
    for name in "ab":
        (folder / f"{name}.py").write_text(f"def {name}():\n  pass\n")
        once(watch.refresh_each(watch.watch_files(spark, str(folder)), parse, target, str(tmp_path / "c2")))
    assert {r.name for r in spark.read.parquet(target).collect()} == {"a", "b"}


def test_event_extensions(spark):
    events = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:10", "2024-01-01 02:00"]), "user_id": [1, 1, 1], "event_type": ["a"] * 3, "value": [1.0, 2.0, 3.0]}))
    assert sorted(r.n for r in watch.sessions(events).collect()) == [1, 2]
    assert sorted(r.total for r in watch.event_windows(events).collect()) == [3.0, 3.0]


@pytest.mark.parametrize(("pattern", "literals", "fold"), [
    (r"(^|[^\w.])(eval|exec)\(", {"eval(", "exec("}, False),
    (r"(?i)Passw(or)?d\s*=", {"passwd", "password"}, True),
    (r"\bconsole\.(log|debug)\(|\bvar_dump\(", {"console.log(", "console.debug(", "var_dump("}, False),
    (r"(abc)+x?", {"abc"}, False),
    (r"(abc)*x?", None, False),
    (r"foo|\d+", None, False),
    (r"ab[cd]\d{3,}", {"abc", "abd"}, False),
    (r"(?=hello)\w+", None, False),
    (r"(?i:secret)", None, False),
    (r"it.skip", {"skip"}, False),
    ("(", None, False),
])
def test_required_literals(pattern, literals, fold):
    assert search.required_literals(pattern) == (literals, fold)


def test_required_literals_miss_no_match():
    rnd = random.Random(7)

    def part(depth):
        kind = rnd.randrange(9 if depth else 5)
        if kind < 4:
            return "".join(rnd.choice("abAB") for _ in range(rnd.randint(1, 4)))
        if kind == 4:
            return rnd.choice(["[ab]", "[^a]", ".", r"\b", "a?", "b+", "[A-B]"])
        if kind < 7:
            return "(" + "|".join(part(depth - 1) + part(depth - 1) for _ in range(rnd.randint(1, 3))) + ")"
        return "(" + part(depth - 1) + ")" + rnd.choice(["*", "+", "?", "{2}", "{0,2}", "+?", "{1,3}"])

    with_literals = hits = 0
    for _ in range(3000):
        pattern = rnd.choice(["", "(?i)"]) + "".join(part(2) for _ in range(rnd.randint(1, 3)))
        found, fold = search.required_literals(pattern)
        if found is None:
            continue
        with_literals += 1
        for _ in range(20):
            text = "".join(rnd.choice("abAB ") for _ in range(rnd.randint(3, 40)))
            if re.search(pattern, text):
                hits += 1
                assert any(x in (text.lower() if fold else text) for x in found), (pattern, text, found)
    assert with_literals > 500 and hits > 500


def test_rules_over_files_equal_rules_over_lines(spark):
    from weftline.operators import findings

    texts = ["x = EVAL(1)\n eval(y)\nprint(z)", "PassWord = 'abcdefgh01234567'", "a\nSELECT * FROM t", "", None, "for (x) { await y }", "ſecret passwd", "x\n  except :\n== null"]
    files = spark.createDataFrame(list(zip("abcdefgh", texts, strict=True)), "file string, content string")
    lines = files.select("file", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("file", (F.col("at") + 1).cast("long").alias("line"), "text")
    got, plain = (sorted(map(tuple, x.collect())) for x in (findings.scan_files(files), findings.scan(lines)))
    assert got == plain and len(got) >= 6


def test_indexed_symbols_equal_a_scan(spark):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("abAB_") for _ in range(rnd.randint(0, 9))) for _ in range(300)] + [None, "Ünï_code", "load_config", "load_confg", "LOAD_CONFIGS"]
    nodes = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "node_id string, name string")
    index = search.name_index(nodes)
    for name, fuzzy in (("ab", None), ("abA", None), ("b_a", 1), ("aabb_ab", 2), ("load_config", None), ("load_config", 1), ("ünï", None), ("", None)):
        got, plain = search.indexed_symbols(index, nodes, name, 500, fuzzy), search.symbols(nodes, name, 500, fuzzy)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in plain.collect()], (name, fuzzy)
    plan = search.indexed_symbols(index, nodes, "load_config")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: .*In\(gram, \[", plan)
