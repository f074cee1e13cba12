"""Whole files: tokens, scopes, calls, complexity, components, elements, style sheets, imports and what they lead to."""

import pytest

from weftline.sources import code, imports, lexer, markup


@pytest.fixture(scope="module")
def scan(spark):
    def of(text, language="javascript", name="src/a.js"):
        return lexer.tokens(spark.createDataFrame([(name, text, language)], "path string, content string, language string"))

    return of


def names(found):
    return {r.name for r in lexer.definitions(found).collect()}


def edges(found):
    return [(r.to_fn, r.from_id) for r in lexer.calls(found).collect()]


DEFINED = [
    ("function processData(a) { return a; }", {"processData"}),
    ("const fetchData = async () => { return 1; };", {"fetchData"}),
    ("async function load() {}", {"load"}),
    ("const handler = function (x) { return x; };", {"handler"}),
    ("if (a) { b(); } for (const x of y) { c(x); } while (z) {} switch (q) {}", set()),
    ("", set()),
    ("const s = 'function no() {}'; // function no2() {}\n/* class No3 {} */", set()),
    ("const re = /function no\\(\\) {/; const t = `class No ${function () { return 1; }} {`;", set()),
    ("const svc = { list: async () => { return 1; }, create: function () {}, remove(id) {} };", {"svc.list", "svc.create", "svc.remove"}),
    ("const config = { count: 3, name: 'x', handler: () => 1 };", {"config.handler"}),
    ("class A { constructor() {} async save() {} static of() {} get size() { return 1; } }", {"A", "constructor", "save", "of", "size"}),
    ("const f = x => y => x + y;\nconst g = (a, b) => a\nconst h = async z => { };", {"f", "g", "h"}),
    ("export default async function* gen() { yield 1; }", {"gen"}),
    ("const a = b / c; const d = e / f; function real() {}", {"real"}),
    ("x = '\\'' + \"\\\"\"; function after() {} // it's", {"after"}),
]


def test_definitions_of_javascript(spark):
    found = lexer.tokens(spark.createDataFrame([(str(k), text, "javascript") for k, (text, _) in enumerate(DEFINED)], "path string, content string, language string"))
    got = [set() for _ in DEFINED]
    for r in lexer.definitions(found).collect():
        got[int(r.file)].add(r.name)
    assert got == [want for _, want in DEFINED]


def test_calls_know_the_function_around_them(scan):
    text = """
    import { requirePermission } from './auth';
    router.post('/x', requirePermission('a'), async (req, res) => {
      if (hasPermission(req)) { save(req); }
    });
    function outer() { helper(); function inner() { helper(); } helper(); }
    const svc = { list: () => { helper(); } };
    obj?.method?.();
    """
    assert sorted(edges(scan(text))) == sorted(
        [
            ("router.post", "src/a.js:0:<module>"), ("requirePermission", "src/a.js:0:<module>"), ("hasPermission", "src/a.js:0:<module>"), ("save", "src/a.js:0:<module>"), ("helper", "src/a.js:6:outer"),
            ("helper", "src/a.js:6:inner"), ("helper", "src/a.js:6:outer"), ("helper", "src/a.js:7:svc.list"), ("obj.method", "src/a.js:0:<module>"),
        ]
    )


def test_lines_of_tokens_and_pairs_of_brackets(scan):
    rows = scan("a(\n  [1, {b: 2}]\n) }\n// c\n'd'").orderBy("line", "k").collect()
    assert [(r.text, r.line, r.kind) for r in rows if r.text in ("a", "b", "// c", "'d'")] == [("a", 1, "name"), ("b", 2, "name"), ("// c", 4, "comment"), ("'d'", 5, "string")]
    by_k = {r.k: r for r in rows if r.k is not None}
    assert all(by_k[by_k[r.pair].pair].k == r.k for r in by_k.values() if r.pair is not None)
    assert [r.text for r in by_k.values() if r.pair is None and r.text in "()[]{}"] == ["}"]


def test_templates_within_templates(spark):
    texts = ["const t = `a ${b(`c ${d()} e`)} f`; g();", "const t = `a ${ {x: {y: d()}}.x } `; b(); g();"]
    found = lexer.calls(lexer.tokens(spark.createDataFrame([(str(k), t, "javascript") for k, t in enumerate(texts)], "path string, content string, language string"))).collect()
    assert {(r.file, r.to_fn) for r in found} == {(k, c) for k in "01" for c in "bdg"}


def test_rust(scan):
    text = """/* a /* fn no() {} */ b */
pub async fn one<'a, T: Into<String>>(x: &'a T) -> Result<(), Error> where T: Clone { let s = r##"fn no() { "# }"##; let c = '{'; two::go(x)?; }
impl<T> Store for Thing<T> { fn get(&self) -> i32 { loop { if self.a && self.b { return 1; } } } }
macro_rules! m { () => {} }
trait Shape { fn area(&self) -> f64; }"""
    found = scan(text, "rust", "src/a.rs")
    assert names(found) >= {"one", "get", "Shape"} and not names(found) & {"no", "area"}
    assert ("two.go", "src/a.rs:2:one") in edges(found)
    measures = {r.name: (r.cyclomatic, r.cognitive, r.nesting) for r in lexer.symbols(found).collect()}
    assert measures["get"] == (4, 4, 2)


def test_complexity_of_chains_and_of_nested_blocks(scan):
    chain = "function f(a) { if (a == 1) { x(); } " + " ".join(f"else if (a == {k}) {{ x(); }}" for k in range(2, 7)) + " else { y(); } }"
    deep = "function g(a, b, c) { if (a) { for (const x of b) { while (c) { if (x) { y(); } } } } return a?.b ?? (a ? 1 : 2); }"
    got = {r.name: (r.parameters, r.cyclomatic, r.cognitive, r.nesting) for r in lexer.symbols(scan(chain + deep)).collect()}
    assert got == {"f": (1, 7, 6, 1), "g": (3, 7, 1 + 2 + 3 + 4 + 1, 4)}


def test_an_elif_is_no_deeper_than_its_if(spark):
    text = "def f(a):\n    if a == 0:\n        x()\n" + "".join(f"    elif a == {k}:\n        x()\n" for k in range(1, 6)) + "    else:\n        if a:\n            y()\n        z()\n"
    got = code.symbols_of("a.py", text)[0]
    assert (got["cyclomatic"], got["cognitive"], got["nesting"]) == (8, 6 + 2, 2)


def test_components_keep_their_lines(spark):
    vue = "<template>\n  <div id=\"app\"/>\n</template>\n<script lang=\"ts\">\nexport function load(): void {}\n</script>\n<style>\n.a { color: red }\n</style>\n"
    parts = markup.component_blocks(spark.createDataFrame([("c.vue", vue, "vue"), ("d.js", "x", "javascript")], "path string, content string, language string"))
    assert {r.language for r in parts.collect()} == {"html", "typescript", "css", "javascript"}
    assert [(r.name, r.line) for r in lexer.definitions(lexer.tokens(parts)).collect()] == [("load", 5)]


PAGE = """<!DOCTYPE html>
<html><head><title>a <b id="no"></title><script>var x = "<div id='no'>";</script></head>
<body class="container {{ theme }} main_wrapper">
<!-- <div id="hidden-one"></div> -->
<div id='outer' class='wrapper'><ul><li id=one>a<li id="two">b</ul><img src=x alt="a > b"><br></div>
<form><label for="mail">M</label><input id="mail"><label>N <input name="n"></label><input type="hidden"><input name="bad"><select aria-label="s"></select><textarea id="t"></textarea></form>
<p id="{{ variable }}">x<p id="outer">y
</body></html>"""


def test_elements_of_a_page(spark):
    found = markup.elements(spark.createDataFrame([("p.html", PAGE), ("e.html", ""), ("n.html", None)], "file string, content string"))
    rows = {r.pre: r for r in found.collect()}
    tags = [rows[k].tag for k in sorted(rows)]
    assert tags == ["html", "head", "title", "script", "body", "div", "ul", "li", "li", "img", "br", "form", "label", "input", "label", "input", "input", "input", "select", "textarea", "p", "p"]
    assert all(rows[r.parent].pre < r.pre <= r.post <= rows[r.parent].post for r in rows.values() if r.parent >= 0)
    assert [rows[k].depth for k in (7, 8, 20, 21)] == [4, 4, 2, 2]
    refs = {(r.entry_type, r.name): r.line for r in markup.references(found).collect()}
    assert refs == {("id", "outer"): 7, ("id", "one"): 5, ("id", "two"): 5, ("id", "mail"): 6, ("id", "t"): 6, ("class", "container"): 3, ("class", "main_wrapper"): 3, ("class", "wrapper"): 5} or refs["id", "outer"] in (5, 7)
    assert [(r.name, r.n, r.lines) for r in markup.id_collisions(found).collect()] == [("outer", 2, [5, 7])]
    assert sorted(rows[r.pre].attributes.get("name") or rows[r.pre].attributes["id"] for r in markup.unlabelled(found).collect()) == ["bad", "t"]


def test_style_sheets(spark):
    css = "/* .no { } */ .a, #one > li:hover, div.b[data-x='.c']::before { color: red } @media (min-width: 1px) { .ghost { } } @keyframes k { from { } 50% { } }"
    rules = markup.css_rules(spark.createDataFrame([("a.css", css)], "file string, content string"))
    assert {r.selector: (r.ids, r.classes, r.types) for r in rules.collect()} == {".a": (0, 1, 0), "#one > li:hover": (1, 1, 1), "div.b[data-x='.c']::before": (0, 2, 2), ".ghost": (0, 1, 0)}
    refs = spark.createDataFrame([("class", "a"), ("class", "b"), ("id", "two")], "entry_type string, name string")
    assert {r.selector for r in markup.unused_selectors(rules, refs).collect()} == {"#one > li:hover", ".ghost"}


def test_modules_become_files(spark):
    paths = ["x.js", "a/x.ts", "util.py", "pkg/__init__.py", "pkg/util.py", "pkg/sub/deep.py", "web/lib.ts", "src/comp/index.tsx", "src/net/http.rs", "src/lib.rs", "styles/_base.scss", "file:/w/b.js"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    asked = [
        ("a/b/c.js", "../../x", "x.js"), ("a/b/c.js", "../x", "a/x.ts"), ("main.py", "util", "util.py"), ("pkg/one.py", ".util", "pkg/util.py"), ("tests/t.py", "pkg.util", "pkg/util.py"), ("web/a.ts", "./lib.js", "web/lib.ts"),
        ("pkg/sub/a.py", "..util", "pkg/util.py"), ("pkg/sub/a.py", "...pkg", "pkg/__init__.py"), ("a/b.ts", "@/comp", "src/comp/index.tsx"), ("a/b.ts", "comp", "src/comp/index.tsx"), ("src/net/x.rs", "crate::net::http::Client", "src/net/http.rs"),
        ("styles/a.scss", "base", "styles/_base.scss"), ("file:/w/a/c.js", "../b", "file:/w/b.js"), ("a.js", "../../../x", None), ("a.js", "left-pad", None), ("pkg/util.py", "os", None),
    ]
    found = spark.createDataFrame([(f, m) for f, m, _ in asked], "file string, module string")
    got = {(r.file, r.module): r.target for r in imports.resolved(found, files, {"@/*": "src/*"}).collect()}
    assert got == {(f, m): t for f, m, t in asked if t}
    assert {(r.source_id, r.target_id) for r in code.resolve_imports(found, files, {"@/*": "src/*"}).collect()} == {(f, t) for f, _, t in asked if t}


def test_a_module_of_a_package_is_the_import(spark):
    files = spark.createDataFrame([("pkg/__init__.py",), ("pkg/mod.py",)], "path string")
    found = spark.createDataFrame([("a.py", "pkg", "mod"), ("a.py", "pkg", "thing"), ("pkg/b.py", ".", "mod")], "file string, module string, name string")
    assert {(r.file, r.name): r.target for r in imports.resolved(found, files).collect()} == {("a.py", "mod"): "pkg/mod.py", ("a.py", "thing"): "pkg/__init__.py", ("pkg/b.py", "mod"): "pkg/mod.py"}


def test_bindings_and_what_is_behind_them(spark):
    files = [
        ("app.js", "import main, { one as uno, two } from './lib';\nimport * as all from './lib';\nimport './side';\nconst { three: drei } = require('./lib');\n// import { no } from './lib';\n"),
        ("lib/index.js", "export { one } from './a'; export * from './b'; export { default } from './c'; export { x } from './ring';"), ("lib/a.js", "export { real as one } from './d';"), ("lib/b.js", "export * from './e';"), ("lib/e.js", "export * from './b'; export function two() {} export function three() {}"),
        ("lib/d.js", "export function real() {}"), ("lib/c.js", "export default function () {}"), ("side.js", ""), ("lib/ring.js", "export { x } from './gnir';"), ("lib/gnir.js", "export { x } from './ring';"), ("ask.js", "import { x } from './lib/ring';"),
        ("py/__init__.py", "from .m import (f as g,\n  h)\n"), ("py/m.py", "def f(): pass\ndef h(): pass\n"), ("use.py", "from py import g, h as k\nimport py.m as pm, os\n"),
    ]
    df = spark.createDataFrame(files, "path string, content string")
    bound = imports.bindings(df)
    assert {(r.what, r.name, r.local) for r in bound.where("file = 'app.js'").collect()} == {("import", "default", "main"), ("import", "one", "uno"), ("import", "two", "two"), ("import", "*", "all"), ("import", "", ""), ("import", "three", "drei")}
    assert {(r.module, r.name, r.local) for r in bound.where("file = 'use.py'").collect()} == {("py", "g", "g"), ("py", "h", "k"), ("py.m", "*", "pm"), ("os", "*", "os")}
    at = imports.resolved(bound, df.select("path"))
    defined = spark.createDataFrame([("lib/d.js", "real"), ("lib/e.js", "two"), ("lib/e.js", "three"), ("lib/c.js", "default"), ("py/m.py", "f"), ("py/m.py", "h")], "file string, name string")
    got = {(r.file, r.local): (r.target, r.origin) for r in imports.definitions_behind(at, defined).collect()}
    assert got == {
        ("app.js", "uno"): ("lib/d.js", "real"), ("app.js", "two"): ("lib/e.js", "two"), ("app.js", "drei"): ("lib/e.js", "three"), ("app.js", "main"): ("lib/c.js", "default"),
        ("use.py", "g"): ("py/m.py", "f"), ("use.py", "k"): ("py/m.py", "h"), ("py/__init__.py", "g"): ("py/m.py", "f"), ("py/__init__.py", "h"): ("py/m.py", "h"),
    }
