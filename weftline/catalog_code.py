"""Queries of the operators over code, on source lines that are made of the tables.

Every row of ``orders`` is a line: its key says which template the line follows, in which file it stands and at what number. The DuckDB
counterparts don't read the lines' text: they follow from the key what an operator must find, so that they don't repeat its patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as fn
from weftline.operators import dataflow, dependencies, findings, finders, graph, search, web
from weftline.sources import code, relations as rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Lines by the key modulo their number; {k} is the key.
TEMPLATES = [
    "app.get('/r{k}', h{k})",
    "@app.route('/p{k}')",
    "const res{k} = fetch('/api/{k}');",
    "const s{k} = createSlice(opts{k});",
    "el.addEventListener('click', f{k});",
    "let count{k} = 5;",
    "const label{k}: Name = make{k}();",
    "// @FLOW: pay{k}",
    "function fn{k}(a, b) {",
    "  return shared;",
    "  after{k};",
    "const env{k} = process.env.KEY_{k};",
    "  console.log('v{k}'); // TODO",
    "// only words, fn8 among them",
    "",
    "import { a{k} } from './m{k}';",
    "  return Math.random();",
    "    deeper{k};",
    "<img src='a.png' alt='a cat'>",
    "<img src='a{k}.png'>",
]
FILES = 40
N = len(TEMPLATES)
WHERE = f"'src/m' || (o_orderkey % {FILES}) || '.js' AS file, (o_orderkey // {FILES} + 1)::BIGINT AS line"


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _of(*templates: int) -> str:
    return f"o_orderkey % {N} IN ({', '.join(map(str, templates))})"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, language, line, text."""
    k = F.col("o_orderkey")
    text = F.replace(F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (k % N + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    return rel.table(spark, sf_dir, "orders").select(F.concat(F.lit("src/m"), (k % FILES).cast("string"), F.lit(".js")).alias("file"), F.lit("javascript").alias("language"), (F.floor(k / FILES) + 1).cast("long").alias("line"), text.alias("text"))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.definitions(lines(spark, sf_dir))


DEFINED = f"defs AS (SELECT file || ':' || line || ':' || name AS node_id, name, file, line FROM (SELECT {WHERE}, 'fn' || o_orderkey AS name FROM orders WHERE {_of(8)}))"


@_query(f"SELECT {WHERE}, 'express' AS framework, 'GET' AS method, '/r' || o_orderkey AS path FROM orders WHERE {_of(0)} UNION ALL SELECT {WHERE}, 'flask', 'ANY', '/p' || o_orderkey FROM orders WHERE {_of(1)}")
def code_routes(spark, sf_dir):
    return finders.routes(lines(spark, sf_dir))


@_query(f"SELECT substr('/' || CASE WHEN {_of(0)} THEN 'r' ELSE 'p' END || o_orderkey, 1) AS prefix, 1::BIGINT AS n FROM orders WHERE {_of(0, 1)}")
def code_route_prefixes(spark, sf_dir):
    return finders.route_prefixes(finders.routes(lines(spark, sf_dir)))


@_query(f"SELECT {WHERE}, 'event_handler' AS kind FROM orders WHERE {_of(4)}")
def code_entry_points(spark, sf_dir):
    return finders.marked(lines(spark, sf_dir), finders.ENTRIES).select("file", "line", "kind")


@_query(f"SELECT {WHERE}, 'redux' AS kind FROM orders WHERE {_of(3)}")
def code_stores(spark, sf_dir):
    return finders.marked(lines(spark, sf_dir), finders.STORES).select("file", "line", "kind")


_OWNERS = f"""{DEFINED}, marks AS (SELECT {WHERE}, CASE o_orderkey % {N} WHEN 2 THEN 'network' WHEN 12 THEN 'io' ELSE 'random' END AS kind FROM orders WHERE {_of(2, 12, 16)}),
owned AS (SELECT m.kind, (SELECT max(d.line) FROM defs d WHERE d.file = m.file AND d.line <= m.line) AS at, m.file FROM marks m)"""


@_query(f"WITH {_OWNERS} SELECT node_id, name, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS effects, count(kind) = 0 AS pure FROM defs LEFT JOIN owned ON owned.file = defs.file AND owned.at = defs.line GROUP BY 1, 2")
def code_effects(spark, sf_dir):
    return finders.effects(lines(spark, sf_dir), definitions(spark, sf_dir))


@_query(f"WITH {DEFINED} SELECT node_id, 'function' AS node_type, name, file, line FROM defs")
def code_definitions(spark, sf_dir):
    return definitions(spark, sf_dir)


_CALLED = {0: ["'app.get'"], 1: ["'app.route'"], 2: ["'fetch'"], 3: ["'createSlice'"], 4: ["'el.addEventListener'"], 6: ["'make' || o_orderkey"], 12: ["'console.log'"], 16: ["'Math.random'"]}
_CALLS = " UNION ALL ".join(f"SELECT {WHERE}, {c} AS to_fn FROM orders WHERE {_of(k)}" for k, cs in _CALLED.items() for c in cs)


@_query(f"SELECT file || ':' || line || ':0' AS call_id, file, line, to_fn FROM ({_CALLS})")
def code_calls(spark, sf_dir):
    return code.calls(lines(spark, sf_dir))


@_query(f"SELECT {WHERE}, './m' || o_orderkey AS module FROM orders WHERE {_of(15)}")
def code_imports(spark, sf_dir):
    return code.imports(lines(spark, sf_dir))


@_query(f"SELECT DISTINCT 'src/m' || (o_orderkey % {FILES}) || '.js' AS source_id, 'src/m' || ((o_orderkey + 7) % {FILES}) || '.js' AS target_id FROM orders WHERE {_of(15)}")
def code_import_edges(spark, sf_dir):
    found = code.imports(lines(spark, sf_dir))
    k = F.regexp_extract("module", r"(\d+)$", 1).cast("long")
    return code.resolve_imports(found.withColumn("module", F.concat(F.lit("./m"), ((k + 7) % FILES).cast("string"))), lines(spark, sf_dir).select(F.col("file").alias("path")).distinct())


@_query(f"WITH {DEFINED} SELECT node_id, name, file, line, 'warning' AS severity FROM defs")
def code_unused_definitions(spark, sf_dir):
    return finders.unused_definitions(definitions(spark, sf_dir), code.calls(lines(spark, sf_dir)), code.imports(lines(spark, sf_dir)))


@_query(f"WITH {DEFINED}, t AS (SELECT 'fn' || (o_orderkey - 8) AS name, count(DISTINCT o_custkey % 10) AS tests FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT node_id, name, coalesce(tests, 0) AS tests, tests IS NOT NULL AS tested FROM defs LEFT JOIN t USING (name)")
def code_test_map(spark, sf_dir):
    calls = rel.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("tests/test_"), (F.col("o_custkey") % 10).cast("string"), F.lit(".js")).alias("file"), F.concat(F.lit("m.fn"), (F.col("o_orderkey") - 8).cast("string")).alias("to_fn"))
    return finders.test_map(definitions(spark, sf_dir), calls)


@_query(f"WITH o AS (SELECT o_orderkey, {WHERE}, o_orderkey % {N} AS t FROM orders WHERE o_orderkey % {N} NOT IN (7, 13, 14)), w AS (SELECT *, lag(t) OVER (PARTITION BY file ORDER BY line) AS before FROM o) SELECT file, line FROM w WHERE before IN (9, 16) AND t IN (9, 10, 12, 16)")
def code_unreachable(spark, sf_dir):
    return finders.unreachable(lines(spark, sf_dir)).select("file", "line")


@_query(f"SELECT {WHERE}, CASE WHEN {_of(13)} THEN 'comment' ELSE 'definition' END AS kind FROM orders WHERE {_of(13)} OR o_orderkey = 8")
def code_mentions(spark, sf_dir):
    return finders.mentions(lines(spark, sf_dir), "fn8")


@_query(f"SELECT {WHERE}, 'count' || o_orderkey AS name, 'int' AS type FROM orders WHERE {_of(5)} UNION ALL SELECT {WHERE}, 'label' || o_orderkey, 'Name' FROM orders WHERE {_of(6)}")
def code_types(spark, sf_dir):
    return finders.types(lines(spark, sf_dir))


@_query(f"SELECT {WHERE}, 'FLOW' AS tag, 'pay' || o_orderkey AS value FROM orders WHERE {_of(7)}")
def code_tags(spark, sf_dir):
    return finders.tags(lines(spark, sf_dir))


@_query(f"WITH {DEFINED}, m AS (SELECT {WHERE}, 0 AS d FROM orders WHERE {_of(7)} UNION ALL SELECT file, line, 1 FROM defs), w AS (SELECT *, lag(d) OVER (PARTITION BY file ORDER BY line, d) AS before FROM m) SELECT node_id, name, coalesce(before = 0, false) AS tagged FROM w JOIN defs USING (file, line) WHERE d = 1")
def code_tag_audit(spark, sf_dir):
    return finders.tag_audit(lines(spark, sf_dir), definitions(spark, sf_dir))


@_query(f"WITH {DEFINED} SELECT {WHERE}, (SELECT d.name FROM defs d WHERE d.file = 'src/m' || (o_orderkey % {FILES}) || '.js' AND d.line <= o_orderkey // {FILES} + 1 ORDER BY d.line DESC LIMIT 1) AS enclosing FROM orders")
def code_enclosing(spark, sf_dir):
    return search.enclosing(lines(spark, sf_dir)).select("file", "line", "enclosing")


@_query(f"WITH r AS (SELECT DISTINCT 'KEY_' || o_orderkey AS name FROM orders WHERE {_of(11)}), d AS (SELECT 'KEY_' || c_custkey AS name FROM customer) SELECT name, 'undocumented' AS state FROM r WHERE name NOT IN (SELECT name FROM d) UNION ALL SELECT name, 'unused' FROM d WHERE name NOT IN (SELECT name FROM r)")
def code_environment(spark, sf_dir):
    return dependencies.env_audit(lines(spark, sf_dir), rel.table(spark, sf_dir, "customer").select(F.concat(F.lit("KEY_"), F.col("c_custkey").cast("string")).alias("name")))


@_query(f"SELECT {WHERE}, CASE o_orderkey % {N} WHEN 12 THEN unnest(['debug-print', 'todo']) ELSE 'missing-alt' END AS rule_id FROM orders WHERE {_of(12)} UNION ALL SELECT {WHERE}, 'missing-alt' FROM orders WHERE {_of(19)}")
def code_rule_findings(spark, sf_dir):
    rules = [r for r in findings.LINE_RULES if r[0] in ("debug-print", "todo", "missing-alt", "eval", "hex-token")]
    return findings.scan(lines(spark, sf_dir), rules).select("file", "line", "rule_id")


#: Cases of rules by the key modulo their number: rule, text, what is expected, what the rule finds.
_CASES = [
    ("eval", "eval(x{k})", True, True), ("eval", "retrieval(x{k})", False, False), ("eval", "model{k}.eval()", False, False), ("eval", "re{k}.exec(s)", False, False), ("debug-print", "fingerprint(x{k})", False, False), ("debug-print", "  print(x{k})", True, True),
    ("debug-print", "console.log({k})", True, True), ("missing-alt", "<img src=a{k} alt=\"b\">", False, False), ("magic-number", "if year{k} == 2024:", False, False), ("magic-number", "if size{k} > 4096:", True, True), ("todo", "TODOS {k}", True, False),
]


@_query("SELECT rule_id, replace(text, '{k}', o_orderkey::VARCHAR) AS text, expected, found, expected = found AS passed FROM orders JOIN (VALUES " + ", ".join(f"({i}, '{r}', '{t}', {e}, {f})" for i, (r, t, e, f) in enumerate(_CASES)) + f") AS v(i, rule_id, text, expected, found) ON o_orderkey % {len(_CASES)} = i")
def rule_tests(spark, sf_dir):
    k = F.col("o_orderkey")
    of = lambda n: F.element_at(F.array(*[F.lit(c[n]) for c in _CASES]), (k % len(_CASES) + 1).cast("int"))
    cases = rel.table(spark, sf_dir, "orders").select(of(0).alias("rule_id"), F.replace(of(1), F.lit("{k}"), k.cast("string")).alias("text"), of(2).alias("expected"))
    return findings.run_rule_tests(spark, cases)


_SCORED = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'dead_code' WHEN 1 THEN 'secrets' ELSE 'other' END AS engine, CASE o_orderkey % 5 WHEN 0 THEN 'unreachable' WHEN 1 THEN 'pattern_match' WHEN 2 THEN 'zombie_css' WHEN 3 THEN 'entropy' ELSE 'x' END AS kind, o_orderkey % 4 = 0 AS in_test, CASE o_orderkey % 7 WHEN 0 THEN 'config' WHEN 1 THEN 'library_api' WHEN 2 THEN 'test' END AS source, o_orderkey % 6 = 0 AS downgraded, CASE o_orderkey % 11 WHEN 0 THEN 'return' WHEN 1 THEN 'throw' END AS after FROM orders"
_CONFIDENCE = f"""f AS ({_SCORED}), c AS (SELECT *, CASE engine
WHEN 'dead_code' THEN greatest(0, least(1, round(CASE kind WHEN 'unreachable' THEN 0.95 ELSE 0.5 END - CASE WHEN in_test OR source = 'test' THEN 0.15 ELSE 0 END - CASE source WHEN 'config' THEN 0.1 WHEN 'library_api' THEN 0.2 ELSE 0 END - CASE WHEN downgraded THEN 0.05 ELSE 0 END + CASE after WHEN 'return' THEN 0.03 WHEN 'throw' THEN -0.03 ELSE 0 END, 2)))
WHEN 'secrets' THEN greatest(0, least(1, round(CASE kind WHEN 'pattern_match' THEN 0.9 WHEN 'entropy' THEN 0.65 ELSE 0.5 END - CASE WHEN in_test OR source = 'test' THEN 0.3 ELSE 0 END - CASE WHEN downgraded THEN 0.1 ELSE 0 END, 2))) ELSE 0.5 END::DOUBLE AS confidence FROM f)"""


def _confidence(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    rows = rel.table(spark, sf_dir, "orders").select(
        k.alias("id"), pick(3, ["dead_code", "secrets", "other"]).alias("engine"), pick(5, ["unreachable", "pattern_match", "zombie_css", "entropy", "x"]).alias("kind"), (k % 4 == 0).alias("in_test"),
        pick(7, ["config", "library_api", "test", None, None, None, None]).alias("source"), (k % 6 == 0).alias("downgraded"), pick(11, ["return", "throw", *[None] * 9]).alias("after"),
    )
    return finders.confidence(rows)


@_query(f"WITH {_CONFIDENCE} SELECT id, confidence FROM c")
def finding_confidence(spark, sf_dir):
    return _confidence(spark, sf_dir).select("id", "confidence")


@_query(f"WITH {_CONFIDENCE} SELECT CASE WHEN id % 13 = 0 THEN 'unscored' WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM c GROUP BY 1")
def confidence_bands(spark, sf_dir):
    return finders.confidence_bands(_confidence(spark, sf_dir).withColumn("confidence", F.when(F.col("id") % 13 != 0, F.col("confidence"))))


_PATHS = "SELECT p_partkey AS k, ['src/', 'lib/core/', '', 'tests/', 'a/b/c/d/', 'cmd/build/', 'app/pages/'][p_partkey % 7 + 1] || ['main', 'index', 'main_page', 'widget', 'server.test', 'config', 'mainly'][p_partkey % 11 % 7 + 1] || '_' || p_partkey || ['.py', '.js', '.txt'][p_partkey % 3 + 1] AS path, p_size * 60 - 50 AS lines FROM part"


def _paths(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    path = F.concat(pick(k % 7, ["src/", "lib/core/", "", "tests/", "a/b/c/d/", "cmd/build/", "app/pages/"]), pick(k % 11 % 7, ["main", "index", "main_page", "widget", "server.test", "config", "mainly"]), F.lit("_"), k.cast("string"), pick(k % 3, [".py", ".js", ".txt"]))
    return rel.table(spark, sf_dir, "part").select(k.alias("k"), path.alias("path"), (F.col("p_size") * 60 - 50).alias("lines"))


@_query(f"""WITH p AS ({_PATHS}), s AS (SELECT path, [15, 12, 0, 0, 0, 0, 12][k % 7 + 1] + [25, 20, 25, 0, 0, 5, 0][k % 11 % 7 + 1] + [12, 8, 15, 0, 1, 0, 8][k % 7 + 1]
+ CASE WHEN lines = 0 THEN 0 WHEN lines < 50 THEN lines / 50 * 20 WHEN lines <= 500 THEN 20 ELSE greatest(5, 20 - least(lines - 500, 2000) / 2000 * 15) END AS score FROM p WHERE k % 7 NOT IN (3, 5) AND k % 11 % 7 <> 4 AND k % 3 <> 2)
SELECT path, round_even(score, 0)::BIGINT AS score FROM s ORDER BY 2 DESC, 1 LIMIT 30""")
def start_here(spark, sf_dir):
    return finders.start_here(_paths(spark, sf_dir), 30)


@_query(f"WITH p AS ({_PATHS}) SELECT string_split(path, '/')[1] AS folder, count(*) AS n FROM p WHERE contains(path, '/') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def heavy_folders(spark, sf_dir):
    return finders.heavy_folders(_paths(spark, sf_dir), 3)


@_query(f"WITH p AS ({_PATHS}) SELECT path FROM p WHERE k % 7 IN (0, 1, 4, 6) AND k % 3 = 0 AND k % 11 % 7 <> 3 AND contains(path, '1')")
def matching_paths(spark, sf_dir):
    return finders.matching_paths(_paths(spark, sf_dir), "path", contains="1", glob="*.py", regex="^(src|lib|a|app)/", exclude="**/widget_*").select("path")


@_query(f"WITH p AS ({_PATHS}) SELECT path, '/work/' || path AS whole, k % 2 = 0 AS inside FROM p")
def paths_within(spark, sf_dir):
    p = _paths(spark, sf_dir)
    tricky = F.when(F.col("k") % 2 == 0, F.concat(F.lit("x/../"), F.col("path"))).otherwise(F.concat(F.lit("x/../../"), F.col("path")))
    return p.select("path", F.concat(F.lit("/work/"), fn.relative_path(F.concat(F.lit("/work\\"), F.col("path")), "/work")).alias("whole"), fn.is_within(tricky, "/work").alias("inside"))


@_query(f"WITH p AS ({_PATHS}) SELECT path AS file, 'missing' AS state FROM p WHERE k % 4 <> 0 AND k % 3 = 0 UNION ALL SELECT path, 'unregistered' FROM p WHERE k % 3 <> 0 AND k % 4 = 0")
def registry_mismatches(spark, sf_dir):
    p = _paths(spark, sf_dir).withColumnRenamed("path", "file")
    return finders.registry_mismatches(p.where("k % 3 = 0"), p.where("k % 4 = 0"))


@_query("SELECT count(*) AS seen, count(*) FILTER (contains(text, 'Licensed') OR contains(text, 'token =')) AS passed, count(*) FILTER (NOT (contains(text, 'Licensed') OR contains(text, 'token ='))) AS skipped FROM documents")
def prefilter_counts(spark, sf_dir):
    return finders.prefilter_counts(rel.table(spark, sf_dir, "documents").select(F.col("text").alias("content")), ["Licensed", "token ="])



@_query(f"WITH l AS (SELECT {WHERE}, {_of(11)} AS src, {_of(12)} AS snk, {_of(13)} AS cln FROM orders), s AS (SELECT file, min(line) AS source_line, count(*) AS n_sources FROM l WHERE src GROUP BY 1), k AS (SELECT file, min(line) AS sink_line, count(*) AS n_sinks FROM l WHERE snk GROUP BY 1), c AS (SELECT DISTINCT file FROM l WHERE cln), e AS (SELECT DISTINCT 'src/m' || (n_nationkey % {FILES}) || '.js' AS a, 'src/m' || ((n_nationkey + 1) % {FILES}) || '.js' AS b FROM nation) SELECT s.file AS source_file, 'env' AS source, source_line, n_sources, k.file AS sink_file, 'log' AS sink, sink_line, n_sinks, s.file IN (SELECT file FROM c) OR k.file IN (SELECT file FROM c) AS sanitized FROM s JOIN e ON e.a = s.file JOIN k ON k.file = e.b WHERE e.a <> e.b")
def flows_across_imports(spark, sf_dir):
    k = F.col("n_nationkey")
    imports = rel.table(spark, sf_dir, "nation").select(F.concat(F.lit("src/m"), (k % FILES).cast("string"), F.lit(".js")).alias("source_id"), F.concat(F.lit("src/m"), ((k + 1) % FILES).cast("string"), F.lit(".js")).alias("target_id"))
    return dataflow.across_imports(lines(spark, sf_dir), imports, [("env", r"process\.env\.")], [("log", r"console\.log\(")], [("words", r"only words")])


_DEPTHS = "w(origin, node_id, hops) AS (SELECT DISTINCT source_id, source_id, 0 FROM calls WHERE source_id LIKE 'u1%/click' UNION SELECT origin, target_id, hops + 1 FROM w JOIN calls ON source_id = node_id WHERE hops < 3 AND source_id <> target_id), m AS (SELECT origin, node_id, min(hops) AS hops FROM w GROUP BY 1, 2)"


@_query(f"WITH RECURSIVE calls AS ({rel.EVENT_CALLS}), {_DEPTHS} SELECT string_split(node_id, '/')[1] AS file, 7 AS line, 'sql' AS sink, origin, hops::INT AS hops, round(power(0.9, hops), 6) AS confidence FROM m WHERE node_id LIKE '%/purchase' QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY hops, origin) = 1")
def taint_across_calls(spark, sf_dir):
    calls = rel.event_calls(spark, sf_dir)
    names = calls.select(F.col("source_id").alias("node_id")).union(calls.select("target_id")).distinct()
    starts = calls.where("source_id LIKE 'u1%/click'").select(F.col("source_id").alias("node_id")).distinct()
    sinks = names.where("node_id LIKE '%/purchase'").select("node_id", F.split("node_id", "/")[0].alias("file"), F.lit(7).alias("line"), F.lit("sql").alias("sink"))
    return dataflow.across_calls(starts, calls, sinks, 3)


@_query(f"WITH RECURSIVE calls AS ({rel.EVENT_CALLS}), w(sink, node_id, hops) AS (SELECT DISTINCT target_id, target_id, 0 FROM calls WHERE target_id LIKE '%/purchase' UNION SELECT sink, source_id, hops + 1 FROM w JOIN calls ON target_id = node_id WHERE hops < 2 AND source_id <> target_id) SELECT node_id, sink, min(hops)::INT AS hops, round(power(0.95, min(hops)), 6) AS confidence FROM w GROUP BY 1, 2")
def taint_reverse(spark, sf_dir):
    calls = rel.event_calls(spark, sf_dir)
    return graph.taint_reverse(calls, calls.where("target_id LIKE '%/purchase'").select(F.col("target_id").alias("node_id")).distinct(), 2)


_CYCLES = "SELECT CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 9 ELSE 2 END AS length, ['a/x.py:to_text', 'b/test_x.py:run', 'a/x.py:load'][o_orderkey % 3 + 1] || ' -> ' || ['c/z.py:from_text', 'tests/q.py:go', 'c/z.py:save'][o_orderkey % 7 % 3 + 1] AS cycle FROM orders"


@_query(f"WITH c AS ({_CYCLES}), n AS (SELECT *, contains(cycle, 'test_x') AS t1, contains(cycle, 'tests/') AS t2, contains(cycle, 'to_text') AND contains(cycle, 'from_text') AS v FROM c) SELECT length, cycle, CASE WHEN length IN (1, 9) OR (t1 AND t2) OR v THEN 'info' ELSE 'warning' END AS severity, CASE WHEN t1 AND t2 THEN 'test_only' WHEN t1 OR t2 THEN 'test_mixed' ELSE 'core' END AS source FROM n")
def cycle_classes(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    rows = rel.table(spark, sf_dir, "orders").select(F.when(k % 4 == 0, 1).when(k % 4 == 1, 9).otherwise(2).alias("length"), F.concat(pick(k % 3, ["a/x.py:to_text", "b/test_x.py:run", "a/x.py:load"]), F.lit(" -> "), pick(k % 7 % 3, ["c/z.py:from_text", "tests/q.py:go", "c/z.py:save"])).alias("cycle"))
    return graph.cycle_severity(rows)


@_query("SELECT o_orderkey AS found_id, o_orderkey + 1000000 AS truth_id FROM orders WHERE o_orderkey % 3 <> 0")
def truth_pairs(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = rel.table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("f"), (k % 5).cast("string")).alias("file"), (F.floor(k / 5) * 10).alias("line"), F.concat(F.lit("n"), k.cast("string")).alias("name"))
    # each truth stands a line or two from its finding; the next one is ten lines away
    truth = rows.where("id % 3 != 0").select((F.col("id") + 1_000_000).alias("id"), "file", (F.col("line") + F.col("id") % 3).alias("line"), F.when(F.col("id") % 2 == 0, F.col("name")).alias("name"))
    return findings.match_pairs(rows, truth)


@_query("SELECT count(*) FILTER (o_orderkey % 3 <> 0) AS tp, count(*) FILTER (o_orderkey % 3 = 0) AS fp, 0::BIGINT AS fn, round(count(*) FILTER (o_orderkey % 3 <> 0) / count(*), 4) AS precision, 1.0::DOUBLE AS recall, round(2 * count(*) FILTER (o_orderkey % 3 <> 0) / (count(*) + count(*) FILTER (o_orderkey % 3 <> 0)), 4) AS f1 FROM orders")
def truth_accuracy(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = rel.table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("f"), (k % 5).cast("string")).alias("file"), (F.floor(k / 5) * 10).alias("line"), F.lit(None).cast("string").alias("name"))
    return findings.match_truth(rows, rows.where("id % 3 != 0").withColumn("line", F.col("line") + 2))


@_query(f"SELECT {WHERE}, 'debug-print' AS rule_id, '  console.log(''v' || o_orderkey || '''); // TODO' AS before, NULL AS after FROM orders WHERE {_of(12)}")
def fix_plan(spark, sf_dir):
    code_lines = lines(spark, sf_dir)
    return findings.fix_plan(findings.scan(code_lines), code_lines)


# --- blame, repositories, names ---------------------------------------------------------------------------------------------------------------

_BLAME = "SELECT 'part:' || (l_partkey % 50) AS file, 's' || (l_suppkey % 17) AS author, l_shipdate::DATE AS date FROM lineitem"


def _blame(spark, sf_dir):
    return rel.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part:"), (F.col("l_partkey") % 50).cast("string")).alias("file"), F.concat(F.lit("s"), (F.col("l_suppkey") % 17).cast("string")).alias("author"), F.to_date("l_shipdate").alias("date"))


@_query(f"WITH b AS ({_BLAME}), n AS (SELECT file, author, count(*) AS n FROM b GROUP BY 1, 2) SELECT file, author AS owner, round(100.0 * n / sum(n) OVER (PARTITION BY file), 2)::DOUBLE AS share FROM n QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, author) = 1")
def primary_owner(spark, sf_dir):
    return findings.primary_owner(_blame(spark, sf_dir))


@_query(f"WITH b AS ({_BLAME}) SELECT file, author, date, date_diff('day', date, DATE '2002-01-01') AS age_days FROM b WHERE date_diff('day', date, DATE '2002-01-01') > 1200")
def stale_lines(spark, sf_dir):
    return findings.stale_lines(_blame(spark, sf_dir), "2002-01-01", 40)


@_query(f"WITH b AS ({_BLAME}), a AS (SELECT date_diff('day', date, DATE '2002-01-01') AS a FROM b) SELECT round(avg(a), 2) AS mean, min(a) AS least, max(a) AS greatest, count(*) FILTER (a <= 60) AS fresh, count(*) FILTER (a > 60 AND a <= 180) AS aging, count(*) FILTER (a > 180) AS stale, list_sort(list(a))[len(list(a)) // 2 + 1] AS median FROM a")
def line_ages(spark, sf_dir):
    return findings.ages(_blame(spark, sf_dir), "2002-01-01")


@_query("SELECT 'shop' AS repo, 'shop::' || c_custkey AS node_id, c_name AS name FROM customer UNION ALL SELECT 'stock', 'stock::' || s_suppkey, s_name FROM supplier")
def merged_repositories(spark, sf_dir):
    c = rel.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("node_id"), F.col("c_name").alias("name"))
    s = rel.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("node_id"), F.col("s_name").alias("name"))
    return graph.merged({"shop": c, "stock": s})


@_query("SELECT 'c' || o_custkey AS node_id, o_orderkey AS ordinal FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def last_definitions(spark, sf_dir):
    return graph.last_definitions(rel.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node_id"), F.col("o_orderkey").alias("ordinal")))


@_query("SELECT o_orderkey % 6 AS grp, ['snake_case', 'camelCase', 'PascalCase'][o_orderkey % 6 % 3 + 1] AS style, round(count(*) FILTER (o_orderkey % 5 <> 0) / count(*), 4) AS share FROM orders GROUP BY 1, 2")
def naming_convention(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, "x").otherwise(F.element_at(F.array(F.lit("get_one"), F.lit("getOne"), F.lit("GetOne")), (k % 6 % 3 + 1).cast("int")))
    return findings.convention(rel.table(spark, sf_dir, "orders").select((k % 6).alias("grp"), name.alias("name")), "grp")


@_query("SELECT o_orderkey AS call_id, 'm' || (o_custkey % 20) || ':' || (o_orderkey % 4) AS target_id FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 20 < 15")
def receiver_calls(spark, sf_dir):
    o = rel.table(spark, sf_dir, "orders")
    calls = o.select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("f"), (F.col("o_orderkey") % 2).cast("string")).alias("file"), F.concat(F.lit("v"), (F.col("o_custkey") % 20).cast("string"), F.lit(".run"), (F.col("o_orderkey") % 4).cast("string")).alias("to_fn"))
    types = o.sparkSession.range(20).select(F.lit("f0").alias("file"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("variable"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("type"))
    m = o.sparkSession.range(15).crossJoin(o.sparkSession.range(4).withColumnRenamed("id", "j")).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("type"), F.concat(F.lit("run"), F.col("j").cast("string")).alias("name"), F.concat(F.lit("m"), F.col("id").cast("string"), F.lit(":"), F.col("j").cast("string")).alias("node_id"), F.lit(1).alias("line"))
    return graph.receivers(calls, types, m)


@_query("SELECT DISTINCT 'order:' || o_orderkey AS source_id, 'cmd:' || (o_custkey % 9) AS target_id, 0.9::DOUBLE AS confidence FROM orders WHERE o_custkey % 9 < 7")
def message_calls(spark, sf_dir):
    o = rel.table(spark, sf_dir, "orders")
    asked = o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("source_id"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "loadItem").otherwise("load_item"), F.element_at(F.array(*[F.lit(x) for x in "ABCDEFGHI"]), (F.col("o_custkey") % 9 + 1).cast("int"))).alias("command"))
    asked = asked.withColumn("command", F.when(F.col("source_id").rlike("[02468]$"), F.col("command")).otherwise(F.concat(F.lit("load_item_"), F.lower(F.substring("command", -1, 1)))))
    commands = o.sparkSession.createDataFrame([(f"load_item_{x.lower()}" if k % 2 else f"loadItem{x}", f"cmd:{k}") for k, x in enumerate("ABCDEFG")], "name string, node_id string")
    return graph.message_calls(asked, commands)


# --- style sheets and references --------------------------------------------------------------------------------------------------------------

_REFS = """SELECT 'c' || (p_partkey % 90) AS name, CASE WHEN p_partkey % 90 % 2 = 0 THEN 'class' ELSE 'id' END AS entry_type, ['html', 'css', 'js'][(p_partkey // 90) % 3 + 1] AS category FROM part WHERE (p_partkey % 90) % 7 <> (p_partkey // 90) % 3"""


def _refs(spark, sf_dir):
    k = F.col("p_partkey")
    group, name = F.floor(k / 90) % 3, k % 90
    category = F.element_at(F.array(F.lit("html"), F.lit("css"), F.lit("js")), (group + 1).cast("int"))
    return rel.table(spark, sf_dir, "part").where(name % 7 != group).select(F.concat(F.lit("c"), name.cast("string")).alias("name"), F.when(name % 2 == 0, "class").otherwise("id").alias("entry_type"), category.alias("category"))


@_query(f"""WITH r AS (SELECT DISTINCT * FROM ({_REFS})), h AS (SELECT name, entry_type FROM r WHERE category = 'html'), c AS (SELECT name, entry_type FROM r WHERE category = 'css'), j AS (SELECT name, entry_type FROM r WHERE category = 'js')
SELECT name, entry_type, 'css_without_html' AS problem FROM (SELECT * FROM c EXCEPT SELECT * FROM h) UNION ALL SELECT name, entry_type, 'html_without_css' FROM (SELECT * FROM h EXCEPT SELECT * FROM c) WHERE entry_type = 'class' UNION ALL SELECT name, entry_type, 'js_without_html' FROM (SELECT * FROM j EXCEPT SELECT * FROM h) WHERE entry_type = 'id'""")
def missing_references(spark, sf_dir):
    return web.missing_refs(_refs(spark, sf_dir))



@_query(f"WITH r AS ({_REFS.replace('AS category FROM', "AS category, 'p' || (p_partkey % 11) AS path FROM")}), m AS (SELECT * FROM r WHERE path NOT IN ('p1', 'p5') UNION ALL SELECT 'c' || n_nationkey, 'class', 'html', 'p1' FROM nation) SELECT name, entry_type, count(*) AS ref_count, count(DISTINCT path) AS files, CASE WHEN entry_type = 'id' AND count(DISTINCT path) FILTER (category = 'html') > 1 THEN 'collision' WHEN count(*) FILTER (category <> 'css') = 0 THEN 'dead' WHEN count(DISTINCT path) > 1 THEN 'duplicate_ref' ELSE 'active' END AS status FROM m GROUP BY 1, 2")
def merged_references(spark, sf_dir):
    k = F.col("p_partkey")
    group, name = F.floor(k / 90) % 3, k % 90
    refs = rel.table(spark, sf_dir, "part").where(name % 7 != group).select(F.concat(F.lit("c"), name.cast("string")).alias("name"), F.when(name % 2 == 0, "class").otherwise("id").alias("entry_type"), F.element_at(F.array(F.lit("html"), F.lit("css"), F.lit("js")), (group + 1).cast("int")).alias("category"), F.concat(F.lit("p"), (k % 11).cast("string")).alias("path"))
    parsed = rel.table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("class").alias("entry_type"), F.lit("html").alias("category"), F.lit("p1").alias("path"))
    return web.merge_refs(refs, parsed, spark.createDataFrame([("p1",), ("p5",)], "path string"))


@_query("SELECT 'p' || (p_partkey % 9) AS path, count(DISTINCT p_partkey % 6) FILTER (p_partkey % 6 < 4) AS utilities, count(DISTINCT p_partkey % 6) FILTER (p_partkey % 6 >= 4) AS others, round(count(DISTINCT p_partkey % 6) FILTER (p_partkey % 6 < 4) / count(DISTINCT p_partkey % 6), 4) AS share FROM part GROUP BY 1")
def utility_classes(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("mt-4", "md:hover:bg-red-500", "flex", "-translate-x-1/2", "card", "mt4")]), (k % 6 + 1).cast("int"))
    return web.utility_classes(rel.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), (k % 9).cast("string")).alias("path"), name.alias("name"), F.lit("class").alias("entry_type")))


# --- symbols, functions ------------------------------------------------------------------------------------------------------------------------

_SYMBOLS = "SELECT 'm' || (p_partkey % 30) AS file, p_partkey AS line, p_partkey + p_size * 3 AS end_line, CASE WHEN p_partkey % 4 = 0 THEN 'class' ELSE 'function' END AS kind, 'f' || p_partkey AS name, p_size % 9 AS parameters, p_size AS cyclomatic, p_partkey % 40 AS cognitive, p_size % 7 AS nesting FROM part"


def _symbols(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    return rel.table(spark, sf_dir, "part").select(F.concat(F.lit("m"), (k % 30).cast("string")).alias("file"), k.alias("line"), (k + n * 3).alias("end_line"), F.when(k % 4 == 0, "class").otherwise("function").alias("kind"), F.concat(F.lit("f"), k.cast("string")).alias("name"), (n % 9).alias("parameters"), n.alias("cyclomatic"), (k % 40).alias("cognitive"), (n % 7).alias("nesting"))


@_query(f"""WITH s AS (SELECT * FROM ({_SYMBOLS}) WHERE kind = 'function') SELECT file, line, name, 'long_function' AS category, CASE WHEN end_line - line + 1 > 100 THEN 'critical' ELSE 'warning' END AS severity FROM s WHERE end_line - line + 1 > 50
UNION ALL SELECT file, line, name, 'many_parameters', 'warning' FROM s WHERE parameters > 5 UNION ALL SELECT file, line, name, 'deep_nesting', 'warning' FROM s WHERE nesting > 4 UNION ALL SELECT file, line, name, 'complex', 'critical' FROM s WHERE cyclomatic > 20""")
def symbol_smells(spark, sf_dir):
    return finders.smells(_symbols(spark, sf_dir))


@_query(f"WITH s AS (SELECT * FROM ({_SYMBOLS}) WHERE kind = 'function') SELECT name, CASE WHEN cyclomatic <= 5 THEN 'simple' WHEN cyclomatic <= 10 THEN 'moderate' WHEN cyclomatic <= 20 THEN 'complex' WHEN cyclomatic <= 50 THEN 'very_complex' ELSE 'untamable' END AS level FROM s ORDER BY cyclomatic DESC, cognitive DESC, file, line LIMIT 40")
def complexity_ranking(spark, sf_dir):
    return finders.complexity(_symbols(spark, sf_dir)).select("name", "level").limit(40)


@_query(f"WITH s AS (SELECT * FROM ({_SYMBOLS}) WHERE kind = 'function') SELECT round(avg(cyclomatic), 2) AS avg_cyclomatic, round(avg(cognitive), 2) AS avg_cognitive, count(*) FILTER (cyclomatic > 20) AS over_20, count(*) AS functions FROM s")
def complexity_summary(spark, sf_dir):
    return finders.complexity_summary(_symbols(spark, sf_dir))


@_query("SELECT p_partkey AS k, 'get_part' || p_partkey AS snake, 2 AS loc, 'f(\"\", \"\") + 1' AS bare, CASE WHEN length(p_name) <= 9 THEN p_name ELSE substr(p_name, 1, 6) || '...' END AS short FROM part")
def text_functions(spark, sf_dir):
    part = rel.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("// one\n\nx = "), key, F.lit(";\n/* two\n three */\n# four\ny = 1;\n * five"))
    return part.select(F.col("p_partkey").alias("k"), fn.alternate_case(F.concat(F.lit("getPart"), key)).alias("snake"), fn.code_lines(body).alias("loc"), fn.without_strings(F.concat(F.lit("f(\"a\\\"b"), key, F.lit("\", 'c') + 1"))).alias("bare"), fn.truncated(F.col("p_name"), 9).alias("short"))


@_query("SELECT event_id, (props->>'$.k')::VARCHAR AS k, date_diff('day', DATE '2024-01-01', ts::DATE) AS age FROM events")
def event_fields(spark, sf_dir):
    return rel.table(spark, sf_dir, "events").select("event_id", fn.json_field(F.col("props"), "k").alias("k"), fn.days_between(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("age"))
