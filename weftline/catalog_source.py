"""Queries over whole source files and pages: tokens, scopes, calls, complexity, imports, re-exports, elements.

Every row of ``part`` is a file of several lines whose text follows one of the templates, by its key. The DuckDB counterparts say from the key
what each template holds; names within strings, templates, comments and regular expressions are traps for whoever reads line by line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import dataflow, taint
from weftline.sources import imports, lexer, markup, relations as rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Language and text by the key modulo their number; {k} is the key.
TEMPLATES = [
    ("javascript", """// function ghost{k}() {}
const text{k} = "function inString() { no(); }";
function load{k}(a, b = [1, 2], { c, d }) {
  if (a && b) { help{k}(a / b / 2); }
  else if (b) { return `x ${inner{k}(a, `${deep{k}()}`)} fn()`; }
  else { other{k}(); }
  for (const x of c) {
    while (x) { try { go{k}(); } catch (e) { stop{k}(e); } }
  }
  return a ? b : d;
}
"""),
    ("javascript", """/* const ghost{k} = () => 1;
   no(); */
const get{k} = async (url) => { const r = await api.get{k}(url); return r?.data; };
const short{k} = x => x + one{k}(x);
const svc{k} = {
  list: () => { help{k}(); },
  make: function () { return made{k}(); },
  count: 3,
};
router.post('/x', allow{k}('a'), (req, res) => { check{k}(req); });
const re{k} = /function \\/ ghost() {/g;
"""),
    ("typescript", """export const run{k}: Handler = async (req: Req, res?: Res): Promise<void> => {
  step{k}(req ? 1 : 2);
};
export interface Shape{k} { area(x: number): string; }
export class Store{k}<T> {
  constructor(private readonly db: Db) { init{k}(); }
  public find(id: string): Promise<T> { return this.db.find{k}(id); }
}
"""),
    ("rust", """/* outer /* fn ghost{k}() {} */ still */
pub fn main{k}<'a>(x: &'a str, c: char) -> bool {
    let raw = r#"fn ghost() { "quoted" }"#;
    if x == "}" { foo{k}(c == '}'); } else if c == 'a' { bar::baz{k}(); }
    match x { "a" => one{k}(), _ => two{k}() }
}
impl Thing{k} { fn new() -> Self { Thing { a: make{k}() } } }
"""),
]
_FILE = "'src/f' || p_partkey || ['.js', '.js', '.ts', '.rs'][p_partkey % 4 + 1]"


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, language."""
    k = F.col("p_partkey")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    text = F.replace(of([t for _, t in TEMPLATES]), F.lit("{k}"), k.cast("string"))
    return rel.table(spark, sf_dir, "part").select(F.concat(F.lit("src/f"), k.cast("string"), of([".js", ".js", ".ts", ".rs"])).alias("path"), text.alias("content"), of([x for x, _ in TEMPLATES]).alias("language"))


def _by_template(columns: str, rows: list[tuple], select: str) -> str:
    """SQL of rows (template, ...) joined to the files that follow the template; ``#`` in a value is the key."""
    values = ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"WITH f AS (SELECT p_partkey AS k, p_partkey % 4 AS t, {_FILE} AS file FROM part), v({columns}) AS (VALUES {values}) SELECT {select} FROM f JOIN v USING (t)"


_KINDS = [(0, "comment", 1), (0, "name", 40), (0, "number", 3), (0, "punct", 63), (0, "string", 1), (0, "template", 4), (1, "comment", 1), (1, "name", 37), (1, "number", 1), (1, "punct", 64), (1, "string", 2), (1, "regex", 1), (2, "name", 41), (2, "number", 2), (2, "punct", 52), (3, "comment", 1), (3, "name", 34), (3, "punct", 50), (3, "string", 5)]


@_query(_by_template("t, kind, n", _KINDS, "file, kind, n::BIGINT AS n"))
def code_tokens(spark, sf_dir):
    return lexer.tokens(files(spark, sf_dir)).groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"))


_SCOPES = [
    (0, "function", "load#", 3, 11, ""), (1, "function", "get#", 3, 3, ""), (1, "function", "short#", 4, 4, ""), (1, "function", "svc#.list", 6, 6, "svc#"), (1, "function", "svc#.make", 7, 7, "svc#"), (2, "function", "run#", 1, 3, ""),
    (2, "class", "Shape#", 4, 4, ""), (2, "class", "Store#", 5, 8, ""), (2, "method", "constructor", 6, 6, "Store#"), (2, "method", "find", 7, 7, "Store#"), (3, "function", "main#", 2, 6, ""), (3, "class", "Thing#", 7, 7, ""), (3, "function", "new", 7, 7, "Thing#"),
]


@_query(_by_template("t, kind, name, line, end_line, parent", _SCOPES, "file, kind, replace(name, '#', k::VARCHAR) AS name, line::BIGINT AS line, end_line::BIGINT AS end_line, nullif(replace(parent, '#', k::VARCHAR), '') AS parent"))
def code_scopes(spark, sf_dir):
    return lexer.scopes(files(spark, sf_dir)).select("file", "kind", "name", F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"), "parent")


_CALLS = [
    *[(0, line, to, "3:load#") for line, to in ((4, "help#"), (5, "inner#"), (5, "deep#"), (6, "other#"), (8, "go#"), (8, "stop#"))],
    (1, 3, "api.get#", "3:get#"), (1, 4, "one#", "4:short#"), (1, 6, "help#", "6:svc#.list"), (1, 7, "made#", "7:svc#.make"), (1, 10, "router.post", "0:<module>"), (1, 10, "allow#", "0:<module>"), (1, 10, "check#", "0:<module>"),
    (2, 2, "step#", "1:run#"), (2, 6, "init#", "6:constructor"), (2, 7, "db.find#", "7:find"), *[(3, line, to, "2:main#") for line, to in ((4, "foo#"), (4, "bar.baz#"), (5, "one#"), (5, "two#"))], (3, 7, "make#", "7:new"),
]


@_query(_by_template("t, line, to_fn, from_id", _CALLS, "file, line::BIGINT AS line, replace(to_fn, '#', k::VARCHAR) AS to_fn, file || ':' || replace(from_id, '#', k::VARCHAR) AS from_id"))
def code_scoped_calls(spark, sf_dir):
    return lexer.calls(files(spark, sf_dir)).drop("call_id")


_MEASURES = [(0, "load#", 3, 8, 10, 3), (1, "get#", 1, 1, 0, 0), (1, "short#", 1, 1, 0, 0), (1, "svc#.list", 0, 1, 0, 0), (1, "svc#.make", 0, 1, 0, 0), (2, "run#", 2, 2, 1, 0), (2, "constructor", 1, 1, 0, 0), (2, "find", 1, 1, 0, 0), (3, "main#", 2, 5, 3, 1), (3, "new", 0, 1, 0, 0)]


@_query(_by_template("t, name, parameters, cyclomatic, cognitive, nesting", _MEASURES, "file, replace(name, '#', k::VARCHAR) AS name, parameters, cyclomatic, cognitive, nesting"))
def code_complexity(spark, sf_dir):
    return lexer.symbols(files(spark, sf_dir)).select("file", "name", "parameters", "cyclomatic", "cognitive", "nesting")


# --- imports ----------------------------------------------------------------------------------------------------------------------------------

#: A group of files for each key of ``part``: path, text, and what its import is found to be (nothing: it imports nothing that is there).
GROUP = [
    ("g{k}/a/b/up.js", "import x from '../../x';", "g{k}/x.ts"), ("g{k}/a/b/side.js", "import { y } from '../y';", "g{k}/a/y/index.js"), ("g{k}/a/b/at.ts", "import { z } from '@g{k}/lib/z.js';", None), ("g{k}/x.ts", "export default 1;", None),
    ("g{k}/a/y/index.js", "const far = require('left-pad');", None), ("g{k}/main.py", "import util\n", "g{k}/util.py"), ("g{k}/util.py", "x = 1\n", None), ("g{k}/pkg/one.py", "from .two import (\n  f,\n)\n", "g{k}/pkg/two/__init__.py"),
    ("g{k}/pkg/two/__init__.py", "from ..one import g\n", "g{k}/pkg/one.py"), ("g{k}/tests/t.py", "import pkg.one as o, os\n", "g{k}/pkg/one.py"), ("g{k}/web/use.ts", "import './lib.js';", "g{k}/web/lib.ts"), ("g{k}/web/lib.ts", "import { q } from '~/q';", "shared/q.ts"),
    ("g{k}/src/lib.rs", "use crate::net::http::Client;", None), ("g{k}/web/a.css", "@import 'b';", None),
]


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of the files of every group, and of one that all may import."""
    k = F.col("p_partkey").cast("string")
    rows = F.array(*[F.struct(F.replace(F.lit(p), F.lit("{k}"), k).alias("path"), F.replace(F.lit(t), F.lit("{k}"), k).alias("content")) for p, t, _ in GROUP])
    return rel.table(spark, sf_dir, "part").select(F.inline(rows)).unionByName(spark.range(1).select(F.lit("shared/q.ts").alias("path"), F.lit("export const q = 1;").alias("content")))


@_query("SELECT replace(a, '#', p_partkey::VARCHAR) AS source_id, replace(b, '#', p_partkey::VARCHAR) AS target_id FROM part, (VALUES " + ", ".join(f"({p.replace('{k}', '#')!r}, {t.replace('{k}', '#')!r})" for p, _, t in GROUP if t) + ") AS v(a, b)")
def import_targets(spark, sf_dir):
    found = groups(spark, sf_dir)
    bound = imports.bindings(found)
    return imports.resolved(bound, found.select("path"), {"~/*": "shared/*"}).select(F.col("file").alias("source_id"), F.col("target").alias("target_id")).distinct()


@_query("""SELECT 'app/u' || p_partkey || '.js' AS file, 'n' || p_partkey AS name, CASE WHEN p_partkey % 3 = 2 THEN 'lib/c' || p_partkey || '_5.js' ELSE 'lib/c' || p_partkey || '_6.js' END AS target, CASE p_partkey % 3 WHEN 0 THEN 'n' || p_partkey WHEN 1 THEN 'real' ELSE 'n' || p_partkey END AS origin FROM part""")
def reexport_chains(spark, sf_dir):
    """Each key's name is passed on by five files to the one that defines it; by a star in one link, or under another name, or defined before."""
    k, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    part = rel.table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    name, onward = F.concat(F.lit("n"), k), F.concat(F.lit(" } from './c"), k, F.lit("_"), (F.col("i") + 1).cast("string"), F.lit("';"))
    chain = F.when(F.col("i") == 0, F.concat(F.lit("import { "), name, F.lit(" } from '../lib/c"), k, F.lit("_1';"))).when(F.col("i") == 6, "// the end")
    chain = chain.when((F.col("i") == 3) & (kind == 0), F.concat(F.lit("export * from './c"), k, F.lit("_4';"))).when((F.col("i") == 5) & (kind == 1), F.concat(F.lit("export { real as "), name, onward)).otherwise(F.concat(F.lit("export { "), name, onward))
    path = F.when(F.col("i") == 0, F.concat(F.lit("app/u"), k, F.lit(".js"))).otherwise(F.concat(F.lit("lib/c"), k, F.lit("_"), F.col("i").cast("string"), F.lit(".js")))
    found = part.select(path.alias("path"), chain.alias("content"))
    at, what = F.when(kind == 2, 5).otherwise(6), F.when(kind == 1, "real").otherwise(name)
    defined = part.where("i = 0").select(F.concat(F.lit("lib/c"), k, F.lit("_"), at.cast("string"), F.lit(".js")).alias("file"), what.alias("name"))
    bound = imports.resolved(imports.bindings(found), found.select("path"))
    return imports.definitions_behind(bound, defined).select("file", "name", "target", "origin")


# --- taint ------------------------------------------------------------------------------------------------------------------------------------

#: Files of a program for each key of ``supplier``; in a third of them the input is quoted, in a third it goes nowhere.
PROGRAM = [
    ("p{k}/ask.py", "def ask1():\n    return input()\ndef ask2():\n    return ask1()\ndef ask3():\n    return ask2()\ndef other():\n    x = input()\n"),
    ("p{k}/run.py", "import os\ndef start(mode, cmd='ls'):\n    launch(cmd)\ndef launch(c):\n    for i in range(3):\n        b = a\n        a = c\n        os.system(b)\n"),
    ("p{k}/main.py", "from .ask import ask3\nfrom .run import start\nvalue = ask3()\nstart(1, cmd={v})\n"),
]


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    value = F.element_at(F.array(F.lit("value"), F.lit("shlex.quote(value)"), F.lit("'x'")), (k % 3 + 1).cast("int"))
    rows = F.array(*[F.struct(F.replace(F.lit(p), F.lit("{k}"), k.cast("string")).alias("path"), F.replace(F.lit(t), F.lit("{v}"), value).alias("content")) for p, t in PROGRAM])
    return rel.table(spark, sf_dir, "supplier").select(F.inline(rows))


@_query("SELECT 'p' || s_suppkey || '/run.py' AS file, 8::BIGINT AS line, 'b' AS variable, 'input' AS source, 'command' AS sink, 'p' || s_suppkey || '/ask.py' AS source_file, 2::BIGINT AS source_line FROM supplier WHERE s_suppkey % 3 = 0")
def taint_summaries(spark, sf_dir):
    return taint.python_flows_across(programs(spark, sf_dir), dataflow.SOURCES, dataflow.SINKS, dataflow.SANITIZERS)


#: Lines of two functions for each key of ``orders``: what the first asks for reaches its own sink in every second, never the other's.
_LINES = ["const a{k} = req.query.id;", "const b{k} = a{k} + 1;", "const c{k} = {q}(b{k});", "db.query({v});", "db.query(a{k});"]


@_query("SELECT 'f' || (o_orderkey % 50) AS file, (o_orderkey * 10 + 1)::BIGINT AS source_line, 'request' AS source, (o_orderkey * 10 + 4)::BIGINT AS sink_line, 'sql' AS sink, o_orderkey % 3 = 0 AS sanitized FROM orders WHERE o_orderkey % 2 = 0")
def variable_flows(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = rel.table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array(*[F.lit(x) for x in _LINES])).alias("i", "text"))
    text = F.replace(F.replace(F.replace("text", F.lit("{q}"), F.when(k % 3 == 0, "escape").otherwise("twice")), F.lit("{v}"), F.when(k % 2 == 0, F.concat(F.lit("c"), k.cast("string"))).otherwise(F.lit("'x'"))), F.lit("{k}"), k.cast("string"))
    scope = F.concat(F.when(F.col("i") < 4, "one").otherwise("two"), k.cast("string"))
    return dataflow.flows(rows.select(F.concat(F.lit("f"), (k % 50).cast("string")).alias("file"), (k * 10 + F.col("i") + 1).alias("line"), text.alias("text"), scope.alias("scope")))


# --- pages ------------------------------------------------------------------------------------------------------------------------------------

_BARE = r"regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<(?:script|style|title)\b[^>]*>).*?</(?:script|style|title)>', '\1', 'gis')"


@_query(rf"SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all({_BARE}, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1, 2")
def page_elements(spark, sf_dir):
    return markup.elements(rel.table(spark, sf_dir, "pages"), "page_id", "html").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@_query(rf"SELECT DISTINCT page_id, unnest(regexp_extract_all({_BARE}, 'class=\"([^\"]+)\"', 1)) AS name FROM pages")
def page_classes(spark, sf_dir):
    return markup.references(markup.elements(rel.table(spark, sf_dir, "pages"), "page_id", "html"), "page_id").where("entry_type = 'class'").select("page_id", "name").distinct()
