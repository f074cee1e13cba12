"""Queries over the control flow of programs and over dead code.

Each row of ``part`` is a program put together from pieces that its key chooses; the DuckDB counterparts say from the pieces, not from the text,
which lines no path reaches, which stores nobody reads and which uses come too early.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import control, deadcode
from weftline.operators.graph import saved_large
from weftline.sources import imports, lexer, markup, relations as rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _files(spark: SparkSession, sf_dir: str, content: Column, ending: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return rel.table(spark, sf_dir, "part").select(F.concat(F.lit("flow/f"), k, F.lit(ending)).alias("path"), F.replace(content, F.lit("{k}"), k).alias("content"))


ENDS = ["return x", "raise E(x)", "continue", "x = 1"]
WRAPS = [
    "    if c:\n      {end}\n    else:\n      {end}", "    if c:\n      {end}", "    try:\n      {end}\n    finally:\n      done()", "    try:\n      {end}\n    except E:\n      pass", "    while True:\n      if c:\n        {end}", "    {end}",
    "    while True:\n      if c:\n        break\n      {end}", "    with lock:\n      {end}", "    match c:\n      case 1:\n        {end}\n      case _:\n        {end}", "    if False:\n      {end}",
]


@_query("""WITH p AS (SELECT 'flow/f' || p_partkey || '.py' AS file, p_partkey % 4 AS e, p_partkey // 4 % 10 AS w FROM part),
q AS (SELECT file, e, w, CASE WHEN w = 9 THEN 4 ELSE [7, 5, 7, 7, 6, 4, 7, 5, 8][w + 1] END AS line FROM p)
SELECT file, line::BIGINT AS line, CASE WHEN w = 4 THEN 'loop' WHEN w = 9 THEN 'condition' WHEN w IN (0, 8) THEN 'branch' ELSE ['return', 'raise', 'continue'][e + 1] END AS reason
FROM q WHERE w IN (4, 9) OR e < 3 AND w IN (0, 2, 5, 7, 8)""")
def flow_unreachable(spark, sf_dir):
    k = F.col("p_partkey")
    inner = F.replace(_pick(WRAPS, F.floor(k / 4)), F.lit("{end}"), _pick(ENDS, k))
    found = control.facts(_files(spark, sf_dir, F.concat(F.lit("def f(c, y):\n  for i in y:\n"), inner, F.lit("\n    after(x)\n    more()\n")), ".py"))
    return control.unreachable(found).select("file", F.col("line").cast("long").alias("line"), "reason")


FIRST = ["v = one(p)", "v: int = 1", "import v", "with p as v: pass"]
SECOND = ["v = 2", "if p: v = 2", "v += 1", "pass", "for i in p: v = i", "try: v = go()\n  except E: pass"]
LAST = ["return v", "return lambda: v", "return p"]


@_query("""WITH p AS (SELECT 'flow/f' || p_partkey || '.py' AS file, ['assign', 'assign', 'import', 'with'][p_partkey % 4 + 1] AS how, p_partkey // 4 % 6 AS b, p_partkey // 24 % 3 AS c FROM part)
SELECT file, 2::BIGINT AS line, 'v' AS name, how, 'store' AS kind FROM p WHERE c = 0 AND b = 0 UNION ALL
SELECT file, 2::BIGINT, 'v', how, 'variable' FROM p WHERE c = 2""")
def flow_unread(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit("def f(p):\n  "), _pick(FIRST, k), F.lit("\n  "), _pick(SECOND, F.floor(k / 4)), F.lit("\n  "), _pick(LAST, F.floor(k / 24)), F.lit("\n"))
    found = saved_large(control.facts(_files(spark, sf_dir, text, ".py")))
    both = control.dead_stores(found).withColumn("kind", F.lit("store")).unionByName(control.unused_variables(found).withColumn("kind", F.lit("variable")))
    return both.select("file", F.col("line").cast("long").alias("line"), "name", "how", "kind")


BEFORE = ["if p: v = 1", "v = 1", "for v in p: pass", "pass", "while p:\n    v = 1\n    break\n  else: v = 2", "try: v = go()\n  except E: raise", "try: v = go()\n  finally: done()", "if p: v = 1\n  else: return", "del p"]


@_query("""SELECT 'flow/f' || p_partkey || '.py' AS file, 'v' AS name, CASE WHEN p_partkey % 9 IN (3, 8) THEN 'never' ELSE 'maybe' END AS state FROM part WHERE p_partkey % 9 IN (0, 2, 3, 8)""")
def flow_unset_uses(spark, sf_dir):
    text = F.concat(F.lit("def f(p):\n  "), _pick(BEFORE, F.col("p_partkey")), F.lit("\n  use(v)\n  v = 3\n  use(v)\n"))
    return control.unset_uses(control.facts(_files(spark, sf_dir, text, ".py"))).select("file", "name", "state")


SCRIPT = """const used{k} = 1, spare{k} = "used{k} inner{k}"; // spare{k}
function f{k}(a) { const inner{k} = a; let w{k}; w{k} = 2; return `x ${used{k}} w{k}`; }
const { p{k}, q: r{k}, s{k} = p{k} } = o;
obj.spare{k} = { spare{k}: {late}, inner{k}: 1 };
export const out{k} = () => { var again{k} = a ? last{k} : {read}; return again{k}.again{k}; };
let last{k} = 1;
{ let last{k} = 2; }
"""


@_query("""SELECT 'flow/f' || p_partkey || '.js' AS file, v.line::BIGINT AS line, v.name || p_partkey AS name
FROM part, (VALUES (1, 'spare', 0), (2, 'inner', 0), (2, 'w', 0), (3, 'r', 1), (3, 's', 2), (7, 'last', 0)) AS v(line, name, needs)
WHERE needs = 0 OR needs = 1 AND p_partkey % 2 = 0 OR needs = 2 AND p_partkey % 3 = 0""")
def unused_bindings(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.replace(F.replace(F.lit(SCRIPT), F.lit("{late}"), F.when(k % 2 == 0, "'r{k}'").otherwise("r{k}")), F.lit("{read}"), F.when(k % 3 == 0, "x.s{k}").otherwise("s{k}"))
    files = _files(spark, sf_dir, text, ".js").withColumn("language", F.lit("javascript"))
    return deadcode.unused_bindings(files)


#: A package for each key: what it exports, and who takes it.
PACKAGE = [
    ("e{k}/lib.js", "export const taken = 1, b = 2;\nexport function own() { return helper(); }\nfunction helper() {}\nexport default class Thing {}\nexport { helper as aid, helper };\nexport async function alone() { own(); }\n"),
    ("e{k}/use.js", "import { taken as t } from './lib';\nimport Thing from './lib';\nimport { given } from './pass';\n"),
    ("e{k}/pass.js", "export { {what} } from './deep';\n"), ("e{k}/deep.js", "export const given = 1;\nexport let other = given;\n"),
    ("e{k}/all.js", "export const x = 1;\n"), ("e{k}/star.js", "import * as all from './all';\n"), ("e{k}/index.js", "export const api = 1;\n"), ("e{k}/lib.test.js", "export const t = 1;\n"),
]


@_query("""SELECT 'e' || p_partkey || v.f AS file, v.line::BIGINT AS line, v.name, v.severity FROM part, (VALUES ('/lib.js', 2, 'own', 'info', 9), ('/lib.js', 5, 'aid', 'warning', 9), ('/lib.js', 5, 'helper', 'info', 9), ('/lib.js', 6, 'alone', 'warning', 9),
('/deep.js', 1, 'given', 'info', 1), ('/deep.js', 2, 'other', 'warning', 0)) AS v(f, line, name, severity, odd) WHERE odd = 9 OR p_partkey % 2 = odd""")
def unused_exports(spark, sf_dir):
    k = F.col("p_partkey")
    what = F.when(k % 2 == 0, "given").otherwise("other")
    rows = F.array(*[F.struct(F.replace(F.lit(p), F.lit("{k}"), k.cast("string")).alias("path"), F.replace(F.lit(t), F.lit("{what}"), what).alias("content")) for p, t in PACKAGE])
    files = rel.table(spark, sf_dir, "part").select(F.inline(rows))
    bound = imports.resolved(imports.bindings(files), files.select("path"))
    return deadcode.unused_exports(deadcode.exports(files.withColumn("language", F.lit("javascript")), used=True), bound)


LISTEN = """document.getElementById('{name}').addEventListener('click', go);
const one = document.querySelector('.{name}'), two = doc.getElementsByClassName("{name}");
one.on('x', f); "two.on()"; a.two.on(g);
two?.addEventListener('y', g);
"""


@_query("""WITH c AS (SELECT DISTINCT unnest(string_split(x, ' ')) AS name FROM (SELECT unnest(regexp_extract_all(html, 'class="([^"]+)"', 1)) AS x FROM pages))
SELECT 'flow/f' || p_partkey || '.js' AS file, v.line::BIGINT AS line, v.entry_type, n AS name FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ad' ELSE 'gone' || p_partkey END AS n FROM part) AS p, (VALUES (1, 'id'), (3, 'class'), (4, 'class')) AS v(line, entry_type)
WHERE v.entry_type = 'id' OR n NOT IN (SELECT name FROM c)""")
def dead_listeners(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.replace(F.lit(LISTEN), F.lit("{name}"), F.when(k % 3 == 0, "ad").otherwise("gone{k}"))
    files = _files(spark, sf_dir, text, ".js").withColumn("language", F.lit("javascript"))
    refs = markup.references(markup.elements(rel.table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")
    return deadcode.dead_listeners(lexer.tokens(files), refs)
