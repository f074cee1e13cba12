"""What decides how a query's time and memory grow with its tables: how often rows are read, how many a task holds, what is joined."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.text import term_counts, tokens
from weftline.operators import dataflow, findings, graph, search, taint
from weftline.plans import pattern
from weftline.sources.scanned import scanned


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counted(spark, df):
    """df, and how many of its rows have been made so far."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), made


def test_findings_by_priority_are_scanned_once(spark):
    rows = [("f", k, "r", "c", s) for k, s in enumerate(["low", "critical", "odd", "high", "critical", None, "info"])]
    found, made = counted(spark, spark.createDataFrame(rows, "file string, line long, rule_id string, category string, severity string"))
    assert sorted(r.line for r in findings.top_by_priority(found, 4).collect()) == [0, 1, 3, 4]
    assert made.value == 7
    assert sorted(r.line for r in findings.top_by_priority(found, 1).collect()) == [1, 4]
    assert sorted(r.line for r in findings.top_by_priority(found, 9).collect()) == list(range(7))


def test_a_task_sorts_a_bounded_number_of_postings(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(search, "SORTED_POSTINGS", 1000, raising=False)
    nodes = spark.range(2000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.concat(F.lit("Name#"), F.col("id").cast("string")).alias("name"))
    index = search.name_index(nodes, str(tmp_path / "index"))
    sizes = [r["count"] for r in index["postings"].groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) > 8000 and max(sizes) < 2000
    assert [r.name for r in search.indexed_symbols(index, nodes, "name#1999", 5, 0).collect()] == ["Name#1999"]


ODD = ["getHTTPResponse aB2C x1Y", "The the THE of  a b", "", None, "İstanbul KelvinK ſtop naïve", "a_b-c'd e9F", "IT\nis\tlicensedUnder\r\nx"]


def test_terms_are_counted_as_tokens_gives_them(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "k long, text string")
    for k, text, given in rows.select("k", "text", tokens(F.col("text"))).collect():
        assert {t: (n, total) for t, n, total in term_counts(text)} == {t: (given.count(t), len(given)) for t in given or []}, k


def test_terms_are_counted_without_a_shuffle_of_all_terms(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(search, "scanned", lambda docs, *rest: asked.append(docs.columns) or scanned(docs, *rest), raising=False)
    index = search.build_index(spark.createDataFrame([(1, "red red blue"), (2, "blue"), (3, None)], "doc_id long, text string"))
    assert asked == [["doc_id", "text"]]
    assert {(r.doc_id, r.term) for r in index["weights"].collect()} == {(1, "red"), (1, "blue"), (2, "blue")}
    assert [r.doc_id for r in search.tfidf(index, "red", 5).collect()] == [1]


def test_exists_is_semi_joins_over_ids(spark):
    nodes = spark.createDataFrame([("a", "class", "A", "f", 1), ("b", "class", "B", "f", 2), ("t", "type", "T", "g", 3), ("u", "type", "U", "g", 9), ("m", "module", "M", "h", 0)], "node_id string, node_type string, name string, file string, line long")
    edges = spark.createDataFrame([("a", "t", "IMPORTS"), ("b", "u", "IMPORTS"), ("u", "m", "DEFINES"), ("t", "t", "CALLS")], "source_id string, target_id string, edge_type string")

    def ids(where, semi=True):
        df = pattern.run(f"MATCH (c) WHERE {where} RETURN c.id", nodes, edges)
        assert ("Join Inner" not in df._jdf.queryExecution().optimizedPlan().toString()) == semi
        return sorted(r[0] for r in df.collect())

    assert ids("EXISTS { (c)-[:IMPORTS]->(p:Type) WHERE p.line < 5 }") == ["a"]
    assert ids("NOT EXISTS { (c)-[:IMPORTS]->(p:Type) WHERE p.line < 5 }") == ["b", "m", "t", "u"]
    assert ids("EXISTS { (p:Class)-[:IMPORTS]->(c) WHERE p.line = 2 AND c.line > 5 }") == ["u"]
    assert ids("EXISTS { (c)-[:IMPORTS]->(p)-[:DEFINES]->(q:Module) }") == ["b"]
    assert ids("EXISTS { (q:Module)<-[:DEFINES]-(p)<-[:IMPORTS]-(c:Class) } OR c.line = 3") == ["b", "t"]
    assert ids("EXISTS { (c)-[:IMPORTS]-(p) WHERE p.line > 5 }") == ["b"]
    assert ids("EXISTS { (p)-[:CALLS]-(c) }") == ["t"]
    assert ids("EXISTS { (a)-[:IMPORTS]->(c)-[:DEFINES]->(q) }", semi=False) == ["u"]
    assert ids("EXISTS { (c)-[:IMPORTS]->(p) WHERE p.line = 3 OR p.line = 9 }", semi=False) == ["a", "b"]


def test_python_files_are_dealt_to_all_tasks(spark):
    files = spark.range(40, numPartitions=1).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit("def f():\n  return input()\n").alias("content"))
    found = taint.facts(files, dataflow.SOURCES, dataflow.SINKS, dataflow.SANITIZERS)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert found.where("what = 'def'").count() == 40


def shuffled(spark, job):
    """What job gives, and how many rows it wrote to shuffles."""

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    return job(), written() - before


@pytest.fixture
def sorting(spark):
    """Joins as of large tables, none broadcast by its size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_closure_joins_only_edges_of_inner_nodes(spark, sorting):
    many = [(f"a{k}", f"b{k}") for k in range(3000)]
    edges = spark.createDataFrame([*many, ("a1", "m"), ("m", "n"), ("n", "z"), ("n", "m")], "source_id string, target_id string")
    found, moved = shuffled(spark, lambda: graph.closure(edges).collect())
    assert {(r.source_id, r.target_id): r.dist for r in found if r.target_id[0] != "b"} == {("a1", "m"): 1, ("a1", "n"): 2, ("a1", "z"): 3, ("m", "n"): 1, ("m", "m"): 2, ("m", "z"): 2, ("n", "m"): 1, ("n", "n"): 2, ("n", "z"): 1}
    assert len(found) == 3009 and moved < 4 * len(many)


def least_distances(edges):
    near = {}
    for a, b in edges:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
    found = {}
    for start in near:
        level, depth = near[start], 1
        while level:
            found |= {(start, n): depth for n in level}
            level, depth = {m for n in level for m in near.get(n, ()) if (start, m) not in found}, depth + 1
    return found


@pytest.mark.parametrize("most", [100_000, 0])
def test_closure_of_any_graph(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", most, raising=False)
    for seed, (nodes, n) in enumerate([(12, 10), (10, 18), (30, 25)]):
        dice = random.Random(seed)
        edges = [(f"n{dice.randrange(nodes)}", f"n{dice.randrange(nodes)}") for _ in range(n)]
        edges += [*edges[:3], ("n1", None)]
        found = graph.closure(spark.createDataFrame(edges, "source_id string, target_id string")).collect()
        assert {(r.source_id, r.target_id): r.dist for r in found} == least_distances(edges) and len(found) == len(least_distances(edges))
    assert graph.closure(spark.createDataFrame([], "source_id string, target_id string")).count() == 0


def test_fans_move_edges_to_no_file_once(spark, sorting):
    nodes = spark.createDataFrame([*[(f"s{k}", f"f{k % 3}") for k in range(30)], *[(f"t{k}", None) for k in range(30)]], "node_id string, file string")
    many = [(f"s{k % 30}", f"t{k // 30 % 30}") for k in range(900)]
    edges = spark.createDataFrame([*many, ("s0", "s1"), ("s0", "s4"), ("s3", "s1"), ("s1", "s0"), ("s0", "s1"), ("s2", "s5"), ("s2", None), ("x", "s2")], "source_id string, target_id string")
    found, moved = shuffled(spark, lambda: graph.fan_metrics(nodes, edges, 0, 1).collect())
    assert {(r.file, r.fan_in, r.fan_out, r.instability, r.god_module) for r in found} == {("f0", 1, 2, 0.6667, True), ("f1", 2, 1, 0.3333, False), ("f2", 0, 0, 0.0, False)}
    assert moved < 1.5 * len(many)


@pytest.mark.parametrize("files", [False, True])
def test_fans_of_any_graph(spark, files):
    dice = random.Random(4)
    at = {f"n{k}": dice.choice(["f", "g", "h", "i", None]) for k in range(20)}
    edges = [(f"n{dice.randrange(22)}", f"n{dice.randrange(22)}") for _ in range(150)]
    between = {(a, at[a], b, at[b]) for a, b in edges if at.get(a) and at.get(b) and at[a] != at[b]}
    out = {(None if files else a, f, g) for a, f, b, g in between}
    into = {(None if files else b, g, f) for a, f, b, g in between}
    found = graph.fan_metrics(spark.createDataFrame([*at.items()], "node_id string, file string"), spark.createDataFrame(edges, "source_id string, target_id string"), distinct_files=files).collect()
    assert {(r.file, r.fan_in, r.fan_out) for r in found} == {(f, sum(f == x[1] for x in into), sum(f == x[1] for x in out)) for f in "fghi"}


def test_edges_between_files_leave_others_early(spark, sorting):
    nodes = spark.createDataFrame([*[(f"s{k}", f"f{k % 3}") for k in range(30)], *[(f"t{k}", None) for k in range(30)]], "node_id string, file string")
    many = [(f"s{k % 30}", f"t{k // 30 % 30}") for k in range(900)]
    edges = spark.createDataFrame([*many, ("s0", "s1"), ("s0", "s4"), ("s1", "s0"), ("s2", "s5"), ("s2", None), ("x", "s2")], "source_id string, target_id string")
    found, moved = shuffled(spark, lambda: graph.module_edges(nodes, edges).collect())
    assert sorted((r.source_id, r.target_id) for r in found) == [("f0", "f1"), ("f1", "f0")] and moved < 1.5 * len(many)
