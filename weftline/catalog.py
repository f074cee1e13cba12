"""All queries of the library's own operators over the tables, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as fn
from weftline.operators import dependencies, findings, graph, search, snapshots, web
from weftline.plans import pattern
from weftline.sources import relations as rel

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

G = f"nodes AS ({rel.NODES}), edges AS ({rel.EDGES})"
CALLS = f"calls AS ({rel.EVENT_CALLS})"
LINES = f"lines AS ({rel.SOURCE_LINES})"
REFS = f"refs AS ({rel.REFS})"


def _query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from weftline import catalog_code, catalog_flow, catalog_source

    return _QUERIES | catalog_code.QUERIES | catalog_flow.QUERIES | catalog_source.QUERIES


def oracle_sql() -> dict[str, str]:
    from weftline import catalog_code, catalog_flow, catalog_source

    return _SQL | catalog_code.SQL | catalog_flow.SQL | catalog_source.SQL


# --- the pattern language -------------------------------------------------------------------------------------------------------------


def _pattern(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pattern.run(text, rel.nodes(spark, sf_dir), rel.edges(spark, sf_dir))

    run.__name__ = name
    _query(f"WITH {G} {sql}")(run)


_pattern("pattern_label", "MATCH (n:Module) RETURN n.name, n.node_type, n.id, n.file, n.line", """SELECT name AS "n.name", node_type AS "n.node_type", node_id AS "n.id", file AS "n.file", line AS "n.line" FROM nodes WHERE node_type = 'module'""")
_pattern("pattern_contains", "MATCH (n:Class) WHERE n.name CONTAINS 'CUSTOMER#00000001' RETURN n.name", """SELECT name AS "n.name" FROM nodes WHERE node_type = 'class' AND name ILIKE '%CUSTOMER#00000001%'""")
_pattern("pattern_contains_wildcard", "MATCH (n:Class) WHERE n.name CONTAINS '#%_7' RETURN n.name", """SELECT name AS "n.name" FROM nodes WHERE node_type = 'class' AND name ILIKE '%#%_7%'""")
_pattern("pattern_null", "MATCH (n) WHERE n.file IS NULL RETURN n.name, n.line", """SELECT name AS "n.name", line AS "n.line" FROM nodes WHERE file IS NULL""")
_pattern("pattern_compare", "MATCH (n:Class) WHERE n.line >= 10 AND n.line <> 12 AND n.line < '20' RETURN n.id", """SELECT node_id AS "n.id" FROM nodes WHERE node_type = 'class' AND line >= 10 AND line <> 12 AND line < 20""")
_pattern("pattern_left_to_right", "MATCH (n:Class) WHERE n.line = 1 OR n.line = 2 AND n.name CONTAINS 'cust' RETURN n.name", """SELECT name AS "n.name" FROM nodes WHERE node_type = 'class' AND (line = 1 OR line = 2) AND name ILIKE '%cust%'""")
_pattern("pattern_hop_right", "MATCH (o:Function)-[:CALLS]->(c:Class) RETURN o.name, c.name", """SELECT o.name AS "o.name", c.name AS "c.name" FROM nodes o JOIN edges e ON o.node_id = e.source_id JOIN nodes c ON c.node_id = e.target_id WHERE o.node_type = 'function' AND c.node_type = 'class' AND e.edge_type = 'CALLS'""")
_pattern("pattern_hop_left", "MATCH (n:File)<-[:USES_TYPE]-(c:Class) WHERE n.name = 'NATION_3' OR n.line = 4 RETURN n.id, c.id", """SELECT n.node_id AS "n.id", c.node_id AS "c.id" FROM nodes n JOIN edges e ON n.node_id = e.target_id JOIN nodes c ON c.node_id = e.source_id WHERE n.node_type = 'file' AND c.node_type = 'class' AND e.edge_type = 'USES_TYPE' AND (n.name = 'NATION_3' OR n.line = 4)""")
_pattern("pattern_hop_both", "MATCH (a)-[:DEFINES]-(b) RETURN a.id, b.id", """SELECT a.node_id AS "a.id", b.node_id AS "b.id" FROM nodes a JOIN edges e ON a.node_id = e.source_id OR a.node_id = e.target_id JOIN nodes b ON (a.node_id = e.source_id AND b.node_id = e.target_id) OR (a.node_id = e.target_id AND b.node_id = e.source_id) WHERE e.edge_type = 'DEFINES'""")
_pattern("pattern_two_hops", "MATCH (c:Class)-[:USES_TYPE]->(n:File)-[:DEFINES]->(r:Module) RETURN c.name, r.name", """SELECT c.name AS "c.name", r.name AS "r.name" FROM nodes c JOIN edges e ON c.node_id = e.source_id AND e.edge_type = 'USES_TYPE' JOIN nodes n ON n.node_id = e.target_id JOIN edges f ON n.node_id = f.source_id AND f.edge_type = 'DEFINES' JOIN nodes r ON r.node_id = f.target_id WHERE c.node_type = 'class' AND n.node_type = 'file' AND r.node_type = 'module'""")
_pattern("pattern_not_exists", "MATCH (c:Class) WHERE NOT EXISTS { ()-[:CALLS]->(c) } RETURN c.name", """SELECT name AS "c.name" FROM nodes c WHERE node_type = 'class' AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes s ON s.node_id = e.source_id WHERE e.edge_type = 'CALLS' AND e.target_id = c.node_id)""")
_pattern("pattern_exists", "MATCH (c:Class) WHERE EXISTS { (c)-[:IMPORTS]->(p:Type) WHERE p.line < 5 } RETURN c.id", """SELECT node_id AS "c.id" FROM nodes c WHERE node_type = 'class' AND EXISTS (SELECT 1 FROM edges e JOIN nodes p ON p.node_id = e.target_id WHERE e.edge_type = 'IMPORTS' AND p.node_type = 'type' AND p.line < 5 AND e.source_id = c.node_id)""")
_pattern("pattern_exists_or", "MATCH (c:Class) WHERE EXISTS { (c)-[:IMPORTS]->(p:Type) WHERE p.line < 3 } OR c.line = 7 RETURN c.id", """SELECT node_id AS "c.id" FROM nodes c WHERE node_type = 'class' AND (EXISTS (SELECT 1 FROM edges e JOIN nodes p ON p.node_id = e.target_id WHERE e.edge_type = 'IMPORTS' AND p.node_type = 'type' AND p.line < 3 AND e.source_id = c.node_id) OR c.line = 7)""")
_pattern("pattern_default_edge", "MATCH (a:Function)-[]->(b) WHERE b.line = 11 RETURN a.id, b.id", """SELECT a.node_id AS "a.id", b.node_id AS "b.id" FROM nodes a JOIN edges e ON a.node_id = e.source_id AND e.edge_type = 'CALLS' JOIN nodes b ON b.node_id = e.target_id WHERE a.node_type = 'function' AND b.line = 11""")


@_query(f"""WITH {G} SELECT name AS "n.name" FROM nodes WHERE node_type = 'type' ORDER BY 1 LIMIT 25""")
def pattern_ordered_limit(spark, sf_dir):
    return pattern.run("MATCH (n:Type) RETURN n.name", rel.nodes(spark, sf_dir), rel.edges(spark, sf_dir)).orderBy("`n.name`").limit(25)


# --- graph ------------------------------------------------------------------------------------------------------------------------------


@_query(f"WITH {G} SELECT node_type, count(*) AS n FROM nodes GROUP BY 1")
def schema_nodes(spark, sf_dir):
    return graph.type_counts(rel.nodes(spark, sf_dir), "node_type")


@_query(f"WITH {G} SELECT edge_type, count(*) AS n FROM edges GROUP BY 1")
def schema_edges(spark, sf_dir):
    return graph.type_counts(rel.edges(spark, sf_dir), "edge_type")


@_query(f"WITH {G} SELECT file, count(*) AS edges FROM edges e JOIN nodes n ON n.node_id = e.target_id WHERE n.file IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5".replace("SELECT file,", "SELECT n.file AS file,").replace("GROUP BY 1 ORDER", "GROUP BY n.file ORDER"))
def hotspots(spark, sf_dir):
    return graph.hotspots(rel.nodes(spark, sf_dir), rel.edges(spark, sf_dir))


@_query(f"""WITH {G}, placed AS (SELECT node_id, file FROM nodes WHERE file IS NOT NULL),
b AS (SELECT e.source_id, e.target_id, s.file AS sf, t.file AS tf FROM edges e JOIN placed s ON s.node_id = e.source_id JOIN placed t ON t.node_id = e.target_id WHERE s.file <> t.file),
o AS (SELECT sf AS file, count(*) AS fan_out FROM (SELECT DISTINCT source_id, sf, tf FROM b) GROUP BY 1), i AS (SELECT tf AS file, count(*) AS fan_in FROM (SELECT DISTINCT target_id, tf, sf FROM b) GROUP BY 1)
SELECT f.file, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, round(CASE WHEN coalesce(fan_in, 0) + coalesce(fan_out, 0) = 0 THEN 0 ELSE coalesce(fan_out, 0) / (coalesce(fan_in, 0) + coalesce(fan_out, 0)) END, 4) AS instability,
coalesce(fan_in, 0) > 10 AND coalesce(fan_out, 0) > 15 AS god_module FROM (SELECT DISTINCT file FROM placed) f LEFT JOIN i USING (file) LEFT JOIN o USING (file)""")
def fan_metrics(spark, sf_dir):
    return graph.fan_metrics(rel.nodes(spark, sf_dir), rel.edges(spark, sf_dir, once=False))


@_query(f"WITH {G}, c AS (SELECT target_id, count(*) AS n FROM edges GROUP BY 1) SELECT node_id, name, coalesce(n, 0) AS ref_count, CASE WHEN n > 0 OR node_type = 'module' THEN 'active' ELSE 'dead' END AS status FROM nodes LEFT JOIN c ON node_id = target_id")
def reference_counts(spark, sf_dir):
    nodes = rel.nodes(spark, sf_dir)
    return graph.reference_counts(nodes, rel.edges(spark, sf_dir), nodes.where("node_type = 'module'"))


@_query(f"""WITH {G}, e AS (SELECT DISTINCT source_id, target_id FROM edges)
SELECT DISTINCT source_id AS node_id, 'root' AS role FROM e WHERE source_id NOT IN (SELECT target_id FROM e) UNION ALL SELECT DISTINCT target_id, 'leaf' FROM e WHERE target_id NOT IN (SELECT source_id FROM e)""")
def roots_and_leaves(spark, sf_dir):
    return graph.roots_and_leaves(rel.edges(spark, sf_dir))


def _lookup(text: str) -> str:
    return f"""t AS (SELECT *, CASE WHEN name = '{text}' THEN 1 WHEN lower(name) = lower('{text}') THEN 2 WHEN contains(lower(name), lower('{text}')) OR contains(node_id, '{text}') THEN 3 END AS tier FROM nodes)
SELECT node_id, node_type, name, file, line, tier FROM t WHERE tier = (SELECT min(tier) FROM t)"""


@_query(f"WITH {G}, {_lookup('customer#000000012')}")
def lookup_tiers(spark, sf_dir):
    return graph.lookup(rel.nodes(spark, sf_dir), "customer#000000012")


def _walk(start: str, depth: int, near: str, far: str) -> str:
    return f"""w(node_id, depth) AS (SELECT '{start}', 0 UNION SELECT e.{far}, depth + 1 FROM w JOIN e ON e.{near} = w.node_id WHERE depth < {depth} AND e.source_id <> e.target_id)"""


@_query(f"WITH RECURSIVE {G}, e AS (SELECT * FROM edges), {_walk('region:1', 3, 'target_id', 'source_id')} SELECT node_id, min(depth) AS depth FROM w WHERE node_id <> 'region:1' GROUP BY 1")
def bfs_callers(spark, sf_dir):
    starts = rel.nodes(spark, sf_dir).where("node_id = 'region:1'")
    return graph.traverse(rel.edges(spark, sf_dir), starts, 3, "callers").select("node_id", "depth")


@_query(f"WITH RECURSIVE {G}, e AS (SELECT * FROM edges), {_walk('order:1', 5, 'source_id', 'target_id')} SELECT node_id, min(depth) AS depth FROM w WHERE node_id <> 'order:1' GROUP BY 1")
def bfs_callees(spark, sf_dir):
    return graph.traverse(rel.edges(spark, sf_dir), rel.nodes(spark, sf_dir).where("node_id = 'order:1'"), 5, "callees").select("node_id", "depth")


_CYCLIC = f"""WITH RECURSIVE {CALLS}, s AS (SELECT min(source_id) AS s FROM calls), w(node_id, depth) AS (SELECT s, 0 FROM s UNION SELECT c.target_id, depth + 1 FROM w JOIN calls c ON c.source_id = w.node_id WHERE depth < 4 AND c.source_id <> c.target_id),
f AS (SELECT node_id, min(depth) AS first FROM w GROUP BY 1)"""


@_query(f"{_CYCLIC} SELECT node_id, first AS depth FROM f WHERE first > 0")
def bfs_cyclic_graph(spark, sf_dir):
    calls = rel.event_calls(spark, sf_dir)
    return graph.traverse(calls, calls.agg(F.min("source_id").alias("node_id")), 4).select("node_id", "depth")


@_query(f"{_CYCLIC} SELECT DISTINCT c.target_id AS node_id, a.first + 1 AS depth FROM f a JOIN calls c ON c.source_id = a.node_id AND c.source_id <> c.target_id JOIN f b ON b.node_id = c.target_id WHERE a.first < 4 AND a.first + 1 > b.first AND NOT (b.first = 0 AND a.first + 1 <= 1)")
def bfs_revisits(spark, sf_dir):
    calls = rel.event_calls(spark, sf_dir)
    starts = calls.agg(F.min("source_id").alias("node_id"))
    return graph.revisits(calls, graph.traverse(calls, starts, 4), starts, 4).select("node_id", "depth")


@_query(f"WITH {CALLS} SELECT a.source_id AS a, a.target_id AS b FROM calls a JOIN calls b ON a.source_id = b.target_id AND a.target_id = b.source_id WHERE a.source_id < a.target_id")
def mutual_pairs(spark, sf_dir):
    return graph.mutual_pairs(rel.event_calls(spark, sf_dir))


_ALL_CYCLES = """p(path, z) AS (SELECT [source_id, target_id], target_id FROM e WHERE source_id < target_id UNION ALL SELECT list_append(path, e.target_id), e.target_id FROM p JOIN e ON e.source_id = p.z WHERE e.target_id > path[1] AND NOT list_contains(path, e.target_id)),
closed AS (SELECT path FROM p JOIN e ON e.source_id = p.z AND e.target_id = path[1])"""


@_query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT * FROM calls WHERE source_id <> target_id), {_ALL_CYCLES}
SELECT 1 AS length, source_id AS cycle FROM calls WHERE source_id = target_id UNION ALL SELECT len(path), array_to_string(path, ' -> ') FROM closed""")
def simple_cycles(spark, sf_dir):
    return graph.cycles(rel.event_calls(spark, sf_dir))


@_query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT * FROM calls WHERE source_id <> target_id), w(s, t) AS (SELECT source_id, target_id FROM e UNION SELECT s, target_id FROM w JOIN e ON source_id = t)
SELECT a.s AS node_id, min(a.t) AS "group" FROM w a JOIN w b ON a.s = b.t AND a.t = b.s GROUP BY a.s HAVING bool_or(a.s <> a.t)""")
def cyclic_groups(spark, sf_dir):
    return graph.cyclic_groups(rel.event_calls(spark, sf_dir))


_MODULES = f"{G}, e AS (SELECT DISTINCT s.file AS source_id, t.file AS target_id FROM edges x JOIN nodes s ON s.node_id = x.source_id JOIN nodes t ON t.node_id = x.target_id WHERE s.file <> t.file UNION SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0)"


@_query(f"WITH RECURSIVE {_MODULES}, {_ALL_CYCLES} SELECT len(path) AS length, array_to_string(path, ' -> ') AS cycle FROM closed")
def module_cycles(spark, sf_dir):
    back = rel.table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").selectExpr("concat('region:', n_regionkey) AS source_id", "concat('nation:', n_nationkey) AS target_id")
    return graph.cycles(graph.module_edges(rel.nodes(spark, sf_dir), rel.edges(spark, sf_dir, once=False)).unionByName(back).distinct())


@_query(f"""WITH RECURSIVE {G}, e AS (SELECT source_id, CASE WHEN edge_type = 'IMPORTS' AND line % 3 = 0 THEN NULL ELSE target_id END AS target_id, 'fn' || line AS to_fn FROM edges), {_walk('supplier:3', 3, 'source_id', 'target_id').replace('e.source_id <> e.target_id', 'e.source_id <> e.target_id AND e.target_id IS NOT NULL')}
SELECT node_id, min(depth) AS depth, NULL AS to_fn FROM w WHERE node_id <> 'supplier:3' GROUP BY 1 UNION ALL SELECT DISTINCT NULL, m.depth + 1, to_fn FROM (SELECT node_id, min(depth) AS depth FROM w GROUP BY 1) m JOIN e ON e.source_id = m.node_id WHERE e.target_id IS NULL AND m.depth < 3""")
def bfs_unresolved(spark, sf_dir):
    edges = rel.edges(spark, sf_dir).withColumn("to_fn", F.concat(F.lit("fn"), F.col("line").cast("string"))).withColumn("target_id", F.when(~((F.col("edge_type") == "IMPORTS") & (F.col("line") % 3 == 0)), F.col("target_id")))
    return graph.traverse(edges, rel.nodes(spark, sf_dir).where("node_id = 'supplier:3'"), 3, "callees", unresolved=True).select("node_id", "depth", "to_fn")


@_query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT * FROM calls WHERE source_id <> target_id), p(path, z, n) AS (SELECT [source_id], source_id, 0 FROM (SELECT DISTINCT source_id FROM e WHERE source_id LIKE '%/click') UNION ALL SELECT list_append(path, target_id), target_id, n + 1 FROM p JOIN e ON source_id = z WHERE n < 4 AND NOT list_contains(path, target_id))
SELECT path[1] AS source, z AS sink, n::INT AS length, array_to_string(path, ' -> ') AS path FROM p WHERE n > 0 AND z LIKE '%/purchase'""")
def source_sink_paths(spark, sf_dir):
    calls = rel.event_calls(spark, sf_dir)
    names = calls.select(F.col("source_id").alias("node_id")).union(calls.select("target_id")).distinct()
    return graph.paths(calls, names.where("node_id LIKE '%/click'"), names.where("node_id LIKE '%/purchase'"), 4)


@_query(f"""WITH RECURSIVE {G}, e AS (SELECT DISTINCT source_id, target_id FROM edges WHERE source_id <> target_id), w(node_id, depth, path) AS (SELECT 'order:1', 0, 'order:1' UNION ALL SELECT t, d, path || ' -> ' || t FROM (SELECT w.depth + 1 AS d, e.target_id AS t, w.path, row_number() OVER (PARTITION BY e.target_id ORDER BY w.node_id) AS k FROM w JOIN e ON e.source_id = w.node_id WHERE w.depth < 3) WHERE k = 1)
SELECT 'order:1' AS start, node_id, depth, path FROM w""")
def trace_down(spark, sf_dir):
    return graph.trace(rel.edges(spark, sf_dir), rel.nodes(spark, sf_dir).where("node_id = 'order:1'"), 3, "callees", most=None)


@_query(f"WITH RECURSIVE {G}, e AS (SELECT DISTINCT source_id, target_id FROM edges WHERE edge_type <> 'CALLS'), w(s, t, d) AS (SELECT source_id, target_id, 1 FROM e UNION SELECT s, target_id, d + 1 FROM w JOIN e ON source_id = t WHERE d < 10) SELECT s AS source_id, t AS target_id, min(d) AS dist FROM w GROUP BY 1, 2")
def transitive_dependencies(spark, sf_dir):
    return graph.closure(rel.edges(spark, sf_dir, once=False).where("edge_type <> 'CALLS'"))


@_query(f"""WITH RECURSIVE {G}, e AS (SELECT * FROM edges), {_walk('nation:3', 2, 'target_id', 'source_id')}, u AS (SELECT node_id, min(depth) AS depth FROM w WHERE node_id <> 'nation:3' GROUP BY 1)
SELECT node_id, depth, 'caller' AS relation, CASE depth WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS risk FROM u
UNION ALL SELECT DISTINCT target_id, 1, 'callee', CASE WHEN target_id IN (SELECT target_id FROM edges WHERE source_id <> 'nation:3') THEN 'low' ELSE 'high' END FROM edges WHERE source_id = 'nation:3'""")
def impact_of_delete(spark, sf_dir):
    return graph.impact(rel.nodes(spark, sf_dir), rel.edges(spark, sf_dir), "nation:3", 2, "delete")


@_query(f"""WITH RECURSIVE {G}, e AS (SELECT DISTINCT s.file AS f, t.file AS g FROM edges x JOIN nodes s ON s.node_id = x.source_id JOIN nodes t ON t.node_id = x.target_id WHERE s.file <> t.file),
w(file, depth) AS (SELECT 'region:2', 0 UNION SELECT f, depth + 1 FROM w JOIN e ON g = file WHERE depth < 8) SELECT file, min(depth) AS depth FROM w GROUP BY 1""")
def affected_files(spark, sf_dir):
    changed = spark.createDataFrame([("region:2",)], "file string")
    return graph.affected_files(rel.nodes(spark, sf_dir), rel.edges(spark, sf_dir, once=False), changed)


@_query(f"""WITH {G}, raw AS (SELECT o_orderkey AS call_id, 'nation:' || (o_orderkey % 25) AS file, CASE WHEN o_orderkey % 5 = 0 THEN 'Supplier#000000' || lpad((o_orderkey % 150)::VARCHAR, 3, '0') WHEN o_orderkey % 5 = 1 THEN ['print', 'println', 'unwrap_or_else', 'forEach', 'isinstance', 'Print'][o_orderkey % 6 + 1] ELSE 'pkg.NATION_' || (o_orderkey % 30) END AS to_fn FROM orders),
w AS (SELECT call_id, file AS ff, 1 AS rank, to_fn AS name FROM raw UNION ALL SELECT call_id, file, 3, string_split(to_fn, '.')[-1] FROM raw),
c AS (SELECT call_id, n.node_id, row_number() OVER (PARTITION BY call_id ORDER BY rank, NOT coalesce(n.file = ff, false), n.file NULLS FIRST, n.line, n.node_id) AS k FROM w JOIN nodes n USING (name))
SELECT call_id, file, to_fn, node_id AS target_id, CASE WHEN node_id IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN node_id IS NOT NULL THEN 'resolved' WHEN to_fn IN ('print', 'println', 'unwrap_or_else', 'forEach', 'isinstance') THEN 'std_lib' ELSE 'unresolved' END AS status FROM raw LEFT JOIN (SELECT * FROM c WHERE k = 1) USING (call_id)""")
def resolved_calls(spark, sf_dir):
    k = F.col("o_orderkey")
    to_fn = F.when(k % 5 == 0, F.concat(F.lit("Supplier#000000"), F.lpad((k % 150).cast("string"), 3, "0"))).when(k % 5 == 1, F.element_at(F.array(*[F.lit(x) for x in ("print", "println", "unwrap_or_else", "forEach", "isinstance", "Print")]), (k % 6 + 1).cast("int"))).otherwise(F.concat(F.lit("pkg.NATION_"), (k % 30).cast("string")))
    raw = rel.table(spark, sf_dir, "orders").select(k.alias("call_id"), F.concat(F.lit("nation:"), (k % 25).cast("string")).alias("file"), to_fn.alias("to_fn"))
    return graph.resolve_calls(rel.nodes(spark, sf_dir), raw)


@_query("SELECT 'line:' || l_orderkey || '/' || l_linenumber AS node_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, 'line:' || l_orderkey || '/' || l_linenumber) AS nth FROM lineitem) WHERE nth > 1")
def duplicate_definitions(spark, sf_dir):
    lines = rel.table(spark, sf_dir, "lineitem")
    key = F.concat(F.lit("line:"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    return graph.duplicate_definitions(lines.select(key.alias("node_id"), F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("line")))


@_query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT * FROM calls WHERE source_id <> target_id AND NOT target_id LIKE '%/view'), w(s, t, d) AS (SELECT DISTINCT source_id, source_id, 0 FROM calls WHERE source_id LIKE 'u1%/click' UNION SELECT s, target_id, d + 1 FROM w JOIN e ON source_id = t WHERE d < 6)
SELECT t AS node_id, s AS origin, min(d) AS hops, round(power(0.9, min(d)), 6) AS confidence FROM w GROUP BY 1, 2""")
def taint_fixpoint(spark, sf_dir):
    calls = rel.event_calls(spark, sf_dir)
    names = calls.select(F.col("source_id").alias("node_id")).union(calls.select("target_id")).distinct()
    return graph.taint_fixpoint(calls, names.where("node_id LIKE 'u1%/click'").join(calls.select(F.col("source_id").alias("node_id")), "node_id", "left_semi"), names.where("node_id LIKE '%/view'"), 6)


# --- search -----------------------------------------------------------------------------------------------------------------------------


@_query(f"WITH {LINES} SELECT file, line, text, length(regexp_extract(text, '^(.*?)\\bLicensed\\b', 1)) + 1 AS col FROM lines WHERE regexp_matches(text, '\\bLicensed\\b')")
def regex_lines(spark, sf_dir):
    return search.regex_lines(rel.source_lines(spark, sf_dir), "Licensed", whole_word=True)


@_query(f"WITH {LINES}, d AS (SELECT *, coalesce(string_agg(text, chr(10)) OVER b, '') AS before, coalesce(string_agg(text, chr(10)) OVER a, '') AS after FROM lines WINDOW b AS (PARTITION BY file ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY file ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) SELECT file, line, text, before, after FROM d WHERE regexp_matches(text, 'Licen[sc]ed|token =')")
def regex_context(spark, sf_dir):
    return search.regex_context(rel.source_lines(spark, sf_dir), "Licen[sc]ed|token =", 2)


@_query(f"WITH {G} SELECT node_id, node_type, name, file, line FROM nodes WHERE contains(lower(name), 'customer#00000000') ORDER BY name <> 'Customer#00000000', node_id LIMIT 20")
def symbol_search(spark, sf_dir):
    return search.symbols(rel.nodes(spark, sf_dir), "Customer#00000000", 20)


@_query(f"WITH {G} SELECT node_id, node_type, name, file, line FROM nodes WHERE contains(lower(name), 'customer#000000017') OR levenshtein(lower(name), 'customer#000000017') <= 1 ORDER BY name <> 'Customer#000000017', node_id LIMIT 50")
def symbol_search_indexed(spark, sf_dir):
    nodes = rel.nodes(spark, sf_dir)
    return search.indexed_symbols(search.name_index(nodes), nodes, "Customer#000000017", 50, 1)


_STOP = ", ".join(f"'{w}'" for w in fn.STOPWORDS)
_TFIDF = f"""t0 AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: strlen(x) >= 2 AND NOT list_contains([{_STOP}], x)) AS t FROM documents),
t1 AS (SELECT doc_id, len(t) AS total, unnest(t) AS term FROM t0), tf AS (SELECT doc_id, term, count(*) / any_value(total) AS tf FROM t1 GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term), n)"""


@_query(f"""WITH {_TFIDF}, q AS (SELECT unnest(['licensed', 'license', 'version', 'public']) AS term), qw AS (SELECT term, 0.25 * (ln((n + 1) / (df + 1)) + 1) AS qw FROM q JOIN df USING (term), n),
s AS (SELECT doc_id, sum(w * qw) AS dot, sqrt(sum(w * w)) AS norm FROM w LEFT JOIN qw USING (term) GROUP BY 1)
SELECT doc_id, round(least(1.0, dot / (norm * (SELECT sqrt(sum(qw * qw)) FROM qw))), 4) AS score FROM s WHERE dot > 0 ORDER BY dot / norm DESC, doc_id LIMIT 10""")
def tfidf_search(spark, sf_dir):
    return search.tfidf(search.build_index(rel.table(spark, sf_dir, "documents")), "licensed license version public", 10)


@_query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 4) AS score FROM embeddings WHERE vec_id <> 7 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) DESC, vec_id LIMIT 10")
def cosine_top(spark, sf_dir):
    return search.cosine_top(rel.table(spark, sf_dir, "embeddings"), 7, 10)


@_query(f"WITH {LINES}, m AS (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS i FROM lines WHERE regexp_matches(text, '^[A-Z]')) SELECT file, min(line) AS first_line, count(*) AS n FROM m GROUP BY file, i HAVING count(*) >= 3")
def line_runs(spark, sf_dir):
    lines = rel.source_lines(spark, sf_dir).where(F.col("text").rlike("^[A-Z]")).withColumn("text", F.lit("# x"))
    return search.comment_runs(lines, 3)


# --- snapshots and time -------------------------------------------------------------------------------------------------------------------

_CUTS = "a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_custkey % 50 <> 0 GROUP BY 1)"


def _cuts(spark, sf_dir):
    orders = rel.table(spark, sf_dir, "orders")
    count = lambda d: d.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return count(orders.where("o_orderdate < TIMESTAMP '1997-01-01'")), count(orders.where("o_orderdate < TIMESTAMP '1998-01-01' AND o_custkey % 50 <> 0"))


@_query(f"WITH {_CUTS} SELECT k, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (k) WHERE a.n IS DISTINCT FROM b.n")
def snapshot_nodes(spark, sf_dir):
    old, new = _cuts(spark, sf_dir)
    return snapshots.node_diff(old, new, "k", ["n"])


_EDGE_CUTS = "a AS (SELECT DISTINCT l_suppkey AS source_id, l_partkey AS target_id FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT l_suppkey AS source_id, l_partkey AS target_id FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1998-01-01')"


@_query(f"WITH {_EDGE_CUTS} SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def snapshot_edges(spark, sf_dir):
    e = rel.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), "l_shipdate")
    return snapshots.edge_diff(e.where("l_shipdate < TIMESTAMP '1996-01-01'"), e.where("l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'"))


#: Rules of the library and some for the documents of the tables.
RULES = [
    *findings.LINE_RULES,
    ("token-line", "secrets", "critical", r"token = \"[0-9a-f]{20,}\"", "a token stands in the text"),
    ("private-address", "personal", "warning", r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}", "an e-mail address"),
    ("phone-number", "personal", "info", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "a telephone number"),
    ("licence-line", "licence", "low", r"(Licensed|Released|licensed) under", "a licence notice"),
    ("signs", "style", "unheard-of", r"(\*\*\*|###|%%%|\$\$\$|&&&)", "runs of signs"),
]
_FOUND = f"""{LINES}, rules(rule_id, category, severity, pattern) AS (VALUES {', '.join("('" + i + "', '" + c + "', '" + s + "', '" + p.replace("'", "''") + "')" for i, c, s, p, _ in RULES)}),
found AS (SELECT file, line, rule_id, category, severity FROM lines JOIN rules ON regexp_matches(text, pattern)),
ids AS (SELECT *, substr(sha1(rule_id || '|' || file || '|' || line || '|' || severity), 1, 16) AS finding_id FROM found)"""


def _scan(spark, sf_dir):
    return findings.scan_files(rel.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("file"), F.col("text").alias("content")), RULES)


def _found(spark, sf_dir):
    return _scan(spark, sf_dir).withColumn("finding_id", fn.finding_id(F.col("rule_id"), F.col("file"), F.col("line"), F.col("severity")))


@_query(f"WITH {_FOUND} SELECT * FROM found")
def findings_scan(spark, sf_dir):
    return _scan(spark, sf_dir)


@_query(f"WITH {_FOUND} SELECT category, severity, count(*) AS n, count(DISTINCT file) AS files FROM found GROUP BY 1, 2")
def findings_rollup(spark, sf_dir):
    return findings.rollup(_found(spark, sf_dir))


@_query(f"WITH {_FOUND}, a AS (SELECT DISTINCT finding_id FROM ids WHERE line % 3 <> 0), b AS (SELECT DISTINCT finding_id FROM ids WHERE line % 3 <> 1) SELECT finding_id, CASE WHEN b.finding_id IS NULL THEN 'new' WHEN a.finding_id IS NULL THEN 'resolved' ELSE 'unchanged' END AS state FROM a FULL JOIN b USING (finding_id)")
def baseline_states(spark, sf_dir):
    f = _found(spark, sf_dir)
    return snapshots.baseline(f.where("line % 3 <> 0"), f.where("line % 3 <> 1"))


@_query(f"WITH {_FOUND} SELECT severity, count(*) FILTER (line % 3 <> 0) AS current, count(*) FILTER (line % 3 <> 1) AS baseline, count(*) FILTER (line % 3 <> 0) - count(*) FILTER (line % 3 <> 1) AS delta FROM found GROUP BY 1")
def severity_delta(spark, sf_dir):
    f = _found(spark, sf_dir)
    return snapshots.severity_delta(f.where("line % 3 <> 0"), f.where("line % 3 <> 1"))


@_query(f"WITH {_FOUND} SELECT count(*) AS total, count(*) FILTER (severity IN ('critical', 'high', 'warning', 'low', 'info')) AS blocking, count(*) FILTER (severity IN ('critical', 'high', 'warning', 'low', 'info')) = 0 AS passed FROM found")
def severity_gate(spark, sf_dir):
    return findings.gate(_found(spark, sf_dir), "info")


@_query(f"""WITH {_FOUND}, m AS (SELECT file, line + 1 AS line, 'seen' AS reason, ['licence-line', 'signs'] AS r FROM lines WHERE regexp_matches(text, 'Licensed|GNU') AND contains(text, 'version') UNION ALL SELECT file, line, NULL, NULL FROM lines WHERE regexp_matches(text, 'Licensed|GNU') AND NOT contains(text, 'version'))
SELECT file, line, rule_id, category, severity, EXISTS (SELECT 1 FROM m WHERE m.file = f.file AND m.line = f.line AND (r IS NULL OR list_contains(r, rule_id))) AS suppressed, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.file = f.file AND m.line = f.line AND (r IS NULL OR list_contains(r, rule_id))) THEN (SELECT min(reason) FROM m WHERE m.file = f.file AND m.line = f.line) END AS reason FROM found f""")
def suppressed_findings(spark, sf_dir):
    lines = rel.source_lines(spark, sf_dir)
    mark = F.when(F.col("text").rlike("Licensed|GNU"), F.when(F.col("text").contains("version"), "ignore-finding-next: licence-line, signs -- seen").otherwise("ignore-finding")).otherwise("")
    return findings.suppress(_scan(spark, sf_dir), lines.select("file", "line", mark.alias("text")))


_HEALTH = """f AS (SELECT coalesce(sum(CASE WHEN severity = 'critical' THEN 3.0 WHEN severity IN ('high', 'warning', 'medium') THEN 1.0 ELSE 0.1 END), 0)::DOUBLE AS w, count(*) FILTER (severity = 'critical') AS critical, count(*) AS total FROM found),
d AS (SELECT *, w / files AS d, critical / files AS c, critical / greatest(total, 1) AS r FROM f, n)
SELECT files, critical, round(d, 4) AS density, greatest(0, least(100, (CASE WHEN d <= 0.5 THEN 95 WHEN d <= 2 THEN 85 WHEN d <= 5 THEN 70 WHEN d <= 10 THEN 55 WHEN d <= 20 THEN 40 WHEN d <= 50 THEN 25 WHEN d <= 100 THEN 20 ELSE 8 END)
- (CASE WHEN critical = 0 THEN 0 WHEN c <= 1 THEN 5 WHEN c <= 5 THEN 10 WHEN c <= 10 THEN 15 WHEN c <= 20 THEN 20 ELSE least(35, floor(c * 0.5)) END) + (CASE WHEN r < 0.1 THEN 5 WHEN r < 0.3 THEN 0 ELSE -5 END)))::BIGINT AS score FROM d"""


@_query(f"WITH {_FOUND}, n AS (SELECT count(*) AS files FROM documents), {_HEALTH}")
def health_score(spark, sf_dir):
    return findings.health(_scan(spark, sf_dir), rel.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("files")))


@_query(f"WITH {_FOUND.replace('found AS (', 'found0 AS (').replace('FROM found)', 'FROM found0)')}, found AS (SELECT * FROM found0 WHERE category = 'secrets'), n AS (SELECT 25 AS files), {_HEALTH}")
def health_of_critical(spark, sf_dir):
    return findings.health(_scan(spark, sf_dir).where("category = 'secrets'"), rel.table(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("files")))


@_query(f"WITH {_FOUND} SELECT category, CASE min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'warning' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' ELSE 'unknown' END AS risk FROM found GROUP BY 1")
def risk_by_category(spark, sf_dir):
    return findings.overall_risk(_scan(spark, sf_dir), "category")


@_query(f"WITH {_FOUND} SELECT category, severity, file, line, rule_id FROM found QUALIFY row_number() OVER (PARTITION BY category, severity ORDER BY file, line, rule_id) = 1")
def deduplicated_findings(spark, sf_dir):
    return findings.deduplicated(_scan(spark, sf_dir), ["category", "severity"], ["file", "line", "rule_id"])


@_query(f"WITH {_FOUND} SELECT file, line, rule_id, category, severity FROM found WHERE file IN (SELECT 'doc:' || doc_id FROM documents WHERE lang = 'de')")
def findings_in_changed_files(spark, sf_dir):
    from weftline.operators import finders

    changed = rel.table(spark, sf_dir, "documents").where("lang = 'de'").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("path"))
    return finders.in_changed_files(_scan(spark, sf_dir), changed)


@_query(f"""WITH {_FOUND}, r AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'warning' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END AS rank FROM found), c AS (SELECT count(*) AS n FROM r WHERE rank = 0), o AS (SELECT *, row_number() OVER (ORDER BY rank, file, line, rule_id) AS k FROM r WHERE rank > 0)
SELECT file, line, rule_id, category, severity FROM r WHERE rank = 0 UNION ALL SELECT file, line, rule_id, category, severity FROM o, c WHERE k <= greatest(0, 60 - n)""")
def findings_by_priority(spark, sf_dir):
    return findings.top_by_priority(_scan(spark, sf_dir), 60)


@_query("SELECT day, n, coalesce(delta, 0) AS delta, CASE WHEN delta IS NULL THEN NULL WHEN delta = 0 THEN 'stable' WHEN delta > 0 THEN 'improved' ELSE 'degraded' END AS direction, event_type FROM (SELECT *, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2))")
def metric_trend(spark, sf_dir):
    series = rel.table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return snapshots.trend(series, "event_type", "day", "n", up_is_good=True).fillna(0, ["delta"])


@_query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event(spark, sf_dir):
    return snapshots.latest(rel.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@_query("WITH a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 10 = 5 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4) SELECT path, CASE WHEN b.h IS NULL THEN 'new' WHEN a.h IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h")
def changed_files(spark, sf_dir):
    docs = rel.table(spark, sf_dir, "documents")
    now = docs.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))
    then = docs.where("doc_id % 10 <> 4").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return snapshots.changed_files(now, then)


@_query("SELECT event_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1) AS occurrence FROM events")
def occurrence_index(spark, sf_dir):
    return snapshots.occurrences(rel.table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "occurrence")


@_query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_id FROM events WHERE date_trunc('day', ts) IN (SELECT DISTINCT date_trunc('day', ts) FROM events ORDER BY 1 DESC LIMIT 5)")
def retention(spark, sf_dir):
    return snapshots.keep_last(rel.table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id"), "day", 5)


# --- pages, ownership, dependencies, accuracy -----------------------------------------------------------------------------------------------


@_query(f"WITH {REFS} SELECT name, entry_type, count(*) AS ref_count, count(DISTINCT path) AS files, CASE WHEN count(DISTINCT path) > 1 THEN 'duplicate_ref' ELSE 'active' END AS status FROM refs GROUP BY 1, 2")
def frontend_status(spark, sf_dir):
    return web.frontend_status(rel.refs(spark, sf_dir))


@_query("""WITH h AS (SELECT page_id, regexp_extract_all(replace(html, '<p>', CASE WHEN page_id % 2 = 0 THEN '<h4>' ELSE '<h2>' END), '(?i)<h([1-6])\\b', 1) AS l FROM pages), x AS (SELECT page_id, unnest(generate_series(0, len(l) - 1)) AS position, unnest(l)::INT AS level FROM h),
p AS (SELECT *, lag(level) OVER (PARTITION BY page_id ORDER BY position) AS previous FROM x) SELECT page_id, position, level, previous FROM p WHERE level - previous > 1""")
def heading_skips(spark, sf_dir):
    pages = rel.table(spark, sf_dir, "pages")
    turned = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("<p>"), F.lit("<h4>"))).otherwise(F.replace("html", F.lit("<p>"), F.lit("<h2>")))
    return web.heading_skips(pages.select("page_id", turned.alias("html")))


@_query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>)', 1)) AS a FROM pages), b AS (SELECT page_id, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS href, trim(regexp_replace(a, '<[^>]*>', '', 'g')) AS text FROM a)
SELECT * FROM b WHERE length(text) <= 2 OR lower(text) IN ('click here', 'here', 'more', 'read more', 'link', 'this')""")
def vague_links(spark, sf_dir):
    return web.vague_links(rel.table(spark, sf_dir, "pages"))


@_query("SELECT source AS author, count(*) AS lines, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS share, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1")
def ownership_shares(spark, sf_dir):
    return findings.ownership(rel.table(spark, sf_dir, "documents").select(F.col("lang").alias("file"), F.col("doc_id").alias("line"), F.col("source").alias("author"), F.col("doc_id").alias("date")))


@_query("SELECT lang AS file, floor((doc_id - 1) / 10)::BIGINT AS chunk, count(DISTINCT source) AS authors, CASE WHEN count(DISTINCT source) >= 5 THEN 'high' ELSE 'medium' END AS level FROM documents GROUP BY 1, 2 HAVING count(DISTINCT source) >= 3")
def author_chunks(spark, sf_dir):
    return findings.author_chunks(rel.table(spark, sf_dir, "documents").select(F.col("lang").alias("file"), F.col("doc_id").alias("line"), F.col("source").alias("author")))


@_query("SELECT list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS median FROM documents")
def upper_median(spark, sf_dir):
    return findings.upper_median(rel.table(spark, sf_dir, "documents"), "n_chars")


@_query("""WITH p AS (SELECT coalesce(regexp_matches(text, '(\\*\\*\\*|###|%%%|&&&|!!| \\| )'), false) AS p, quality = 0 AS t FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM p)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(fp / (fp + tn), 4) AS fpr FROM c""")
def accuracy(spark, sf_dir):
    both = rel.table(spark, sf_dir, "documents").join(rel.table(spark, sf_dir, "labels"), "doc_id")
    return findings.accuracy(both.select(F.col("text").rlike(r"(\*\*\*|###|%%%|&&&|!!| \| )").alias("predicted"), (F.col("quality") == 0).alias("truth")))


@_query("WITH d AS (SELECT p_brand AS name, max(p_size)::VARCHAR AS v FROM part WHERE p_partkey % 7 <> 0 AND p_brand <> 'Brand#11' GROUP BY 1), u AS (SELECT p_brand AS name, max(p_size)::VARCHAR AS v FROM part WHERE p_partkey % 5 <> 0 AND p_brand <> 'Brand#12' GROUP BY 1) SELECT name, d.v AS declared, u.v AS used, CASE WHEN d.v IS NULL THEN 'missing' WHEN u.v IS NULL THEN 'unused' ELSE 'mismatch' END AS state FROM d FULL JOIN u USING (name) WHERE d.v IS DISTINCT FROM u.v")
def config_drift(spark, sf_dir):
    part = rel.table(spark, sf_dir, "part")
    versions = lambda d: d.groupBy(F.col("p_brand").alias("name")).agg(F.max("p_size").cast("string").alias("version"))
    return dependencies.drift(versions(part.where("p_partkey % 7 <> 0 AND p_brand <> 'Brand#11'")), versions(part.where("p_partkey % 5 <> 0 AND p_brand <> 'Brand#12'")))


@_query("""WITH v AS (SELECT p_partkey AS id, p_size // 10 AS a, p_size % 10 AS b, p_partkey % 12 AS c FROM part) SELECT 'pypi' AS ecosystem, 'part' AS name, a || '.' || b || '.' || c AS version, id, 'ADV-1' AS advisory, '>=1.2.10,<3.0' AS range FROM v WHERE a * 10000 + b * 100 + c >= 10210 AND a * 10000 + b * 100 + c < 30000""")
def version_ranges(spark, sf_dir):
    part = rel.table(spark, sf_dir, "part")
    version = F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"), (F.col("p_partkey") % 12).cast("string"))
    packages = part.select(F.lit("pypi").alias("ecosystem"), F.lit("part").alias("name"), version.alias("version"), F.col("p_partkey").alias("id"))
    return dependencies.vulnerable(packages, spark.createDataFrame([("pypi", "part", "ADV-1", ">=1.2.10,<3.0")], "ecosystem string, name string, advisory string, range string"))


@_query("WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part), k AS (SELECT DISTINCT p_type AS meant FROM part), x AS (SELECT DISTINCT substr(p_type, 1, length(p_type) - 1) || 'x' AS name FROM part) SELECT name, meant, levenshtein(name, meant) AS edits FROM (SELECT * FROM x UNION SELECT * FROM w) JOIN k ON substr(name, 1, 2) = substr(meant, 1, 2) WHERE name <> meant AND levenshtein(name, meant) <= 2")
def typo_pairs(spark, sf_dir):
    part = rel.table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("name"))
    near = part.select(F.concat(F.expr("substr(p_type, 1, length(p_type) - 1)"), F.lit("x")).alias("name"))
    return dependencies.typos(words.union(near), part.select(F.col("p_type").alias("name")))


@_query("SELECT decisions, CASE WHEN decisions + 1 <= 5 THEN 'simple' WHEN decisions + 1 <= 10 THEN 'moderate' WHEN decisions + 1 <= 20 THEN 'complex' WHEN decisions + 1 <= 50 THEN 'very_complex' ELSE 'untamable' END AS level, count(*) AS n FROM (SELECT len(regexp_extract_all(text, ' (for|in|with|and)[ ,.]')) AS decisions FROM documents) GROUP BY 1, 2")
def complexity_levels(spark, sf_dir):
    n = F.regexp_count("text", F.lit(r" (for|in|with|and)[ ,.]")).cast("long")
    d = rel.table(spark, sf_dir, "documents").select(n.alias("decisions"))
    return d.groupBy("decisions", fn.complexity_level(F.col("decisions") + 1).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, html_hash, n FROM (SELECT min(url) AS url, md5(regexp_replace(html, '[0-9]+', '', 'g')) AS html_hash, count(*) AS n FROM pages GROUP BY 2)")
def duplicate_bodies(spark, sf_dir):
    body = F.md5(F.regexp_replace("html", "[0-9]+", "").cast("binary"))
    g = rel.table(spark, sf_dir, "pages").groupBy(body.alias("html_hash")).agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("n"))
    return g.select("url", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), "html_hash", "n")


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from weftline.streaming.watch import event_windows as windows

    return windows(rel.table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 2).alias("total"))


@_query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, k".replace(" AS end,", ' AS "end",'))
def event_sessions(spark, sf_dir):
    from weftline.streaming.watch import sessions

    return sessions(rel.table(spark, sf_dir, "events"))


# --- finders that the tables can feed --------------------------------------------------------------------------------------------------------


@_query(f"WITH {LINES}, s AS (SELECT *, trim(text) AS t FROM lines WHERE trim(text) <> ''), b AS (SELECT file, line, list(t) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS b FROM s), g AS (SELECT b, count(*) AS n, min((file, line)) AS f FROM b WHERE len(b) = 3 GROUP BY b HAVING count(*) > 1) SELECT n, f[1] AS file, f[2] AS line FROM g".replace("min((file, line)) AS f", "min(file || '|' || lpad(line::VARCHAR, 9, '0')) AS f").replace("f[1] AS file, f[2] AS line", "string_split(f, '|')[1] AS file, string_split(f, '|')[2]::BIGINT AS line"))
def duplicate_stretches(spark, sf_dir):
    from weftline.operators import finders

    return finders.duplicate_lines(rel.source_lines(spark, sf_dir), 3).select("n", "file", "line")


@_query("SELECT lang AS language, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1")
def language_histogram(spark, sf_dir):
    from weftline.operators import finders

    return finders.languages(rel.table(spark, sf_dir, "documents").select(F.col("lang").alias("language")))
