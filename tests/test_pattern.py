import pytest

from weftline.plans import pattern

NODES = [
    ("cart:3:add_item", "function", "add_item", "shop/cart.py", 3), ("cart:12:total", "function", "total", "shop/cart.py", 12), ("cart:30:round_up", "function", "round_up", "shop/cart.py", 30),
    ("base:4:Entity", "class", "Entity", "core/base.py", 4), ("base:22:Order", "class", "Order", "core/base.py", 22), ("old:3:legacy", "function", "legacy", "core/old.py", 3), ("loose:3:Settings", "class", "Settings", None, 3),
]
EDGES = [("cart:3:add_item", "cart:12:total", "CALLS"), ("cart:12:total", "cart:30:round_up", "CALLS"), ("base:22:Order", "base:4:Entity", "INHERITS"), ("cart:30:round_up", None, "CALLS"), ("old:3:legacy", "old:3:legacy", "IMPORTS")]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(NODES, "node_id string, node_type string, name string, file string, line long"), spark.createDataFrame(EDGES, "source_id string, target_id string, edge_type string")


@pytest.mark.parametrize(
    "text, want",
    [
        ("MATCH (x:Function) WHERE NOT EXISTS { ()-[:CALLS]->(x) } RETURN x.name", ["add_item", "legacy"]),
        ("match (x:Function) where exists { (x)-[:CALLS]->() } return x.name", ["add_item", "total"]),
        ("MATCH (p)-[:CALLS]->(q)-[:CALLS]->(r) RETURN r.name", ["round_up"]),
        ("MATCH (p)<-[:CALLS]-(q) RETURN p.name", ["round_up", "total"]),
        ("MATCH (p)-[:CALLS]-(q) RETURN p.name", ["add_item", "round_up", "total", "total"]),
        ("MATCH (p)-[:IMPORTS]-(q) RETURN p.name", ["legacy"]),
        ("MATCH (k:Class) WHERE k.file IS NULL RETURN k.name -- the rest is a comment", ["Settings"]),
        ("MATCH (x) WHERE x.name CONTAINS 'ORD' RETURN x.name", ["Order"]),
        ("MATCH (x) WHERE x.line = 3 OR x.line = 12 AND x.name CONTAINS 'l' RETURN x.name", ["legacy", "total"]),
        ("MATCH (x) WHERE x.name = 'round_up' OR NOT EXISTS { ()-[:CALLS]->(x) } AND x.line > 12 RETURN x.name", ["Order", "round_up"]),
        ("MATCH (p)-[:CALLS]->(p) RETURN p.name", ["add_item", "total"]),
        ("MATCH (x) WHERE x.weight IS NULL AND x.line = '30' RETURN x.name", ["round_up"]),
        ("MATCH (x) WHERE x.line = 'many' RETURN x.name", []),
        ("MATCH (x:Class)--(y)\nWHERE x.line = 22 RETURN x.name", ["Order"]),
        ("MATCH (x) WHERE EXISTS { (u:Class)-[:INHERITS]->(v) } AND x.line = 22 RETURN x.name", ["Order"]),
    ],
)
def test_rows(graph, text, want):
    assert sorted(r[0] for r in pattern.run(text, *graph).collect()) == sorted(want)


@pytest.mark.parametrize("text", ["MATCH (f:Variable) RETURN f", "MATCH (a)-[r:CALLS]->(b)", "MATCH (a)-[:REFERENCES]->(b)", "MATCH (a) WHERE a.name CONTAINS x", "MATCH (a), (b)", "MATCH (a)-[:CALLS*]->(b)", "MATCH (a) RETURN a ORDER BY a", "MATCH (a) WHERE a.line = -1", "", "MATCH (a) RETURN a AS b", "MATCH (a) WHERE a.name ~ 'x'"])
def test_rejected(graph, text):
    assert not pattern.validate(text)["valid"]
    assert pattern.execute(text, *graph)["error"] == "parse_error"


def test_envelope(graph):
    out = pattern.execute("MATCH (f:Function) RETURN f.name, f LIMIT 4", *graph)
    assert out["count"] == 4 and out["truncated"] and set(out["rows"][0]) == {"f.name", "f"}
    assert pattern.execute("MATCH (f:Function) RETURN g.name LIMIT 9", *graph, limit=2)["rows"] == [{"g.name": None}] * 2
    assert pattern.execute("MATCH (f) WHERE g.line = 1 RETURN f", *graph)["error"] == "compile_error"


def test_no_nested_loops(graph):
    df = pattern.run("MATCH (a)-[:CALLS]-(b) WHERE NOT EXISTS { (b)-[:CALLS]->(c:Class) } OR a.line = 1 RETURN a.name", *graph)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_exists_without_a_shared_variable(graph):
    names = lambda text: sorted(r[0] for r in pattern.run(text, *graph).collect())
    assert names("MATCH (x:Class) WHERE NOT EXISTS { (u:Class)-[:INHERITS]->(v) } RETURN x.name") == []
    assert names("MATCH (x:Class) WHERE NOT EXISTS { (u:Function)-[:INHERITS]->(v) } RETURN x.name") == ["Entity", "Order", "Settings"]
    assert names("MATCH (x:Class) WHERE EXISTS { (u:Function)-[:INHERITS]->(v) } OR x.line = 3 RETURN x.name") == ["Settings"]
