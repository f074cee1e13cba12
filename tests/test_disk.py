"""What larger tables cost in disk: what follows from one file is found in the task that scans it, nothing of it is shuffled or written."""

import pytest

from weftline import catalog
from weftline.operators import dataflow, deadcode
from weftline.sources import lexer


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned_once(df):
    """Files are dealt to tasks, and nothing else is exchanged, sorted or read from a copy of tokens."""
    p = plan(df)
    return p.count("Exchange ") == 1 and p.count("MapInArrow") == 1 and "Sort " not in p and "ExistingRDD" not in p


def test_complexity_is_found_in_the_scan(spark, sf_dir):
    assert scanned_once(catalog.queries()["code_complexity"](spark, sf_dir))


@pytest.mark.parametrize("of", [lexer.scopes, lexer.calls, lexer.symbols])
def test_files_give_what_their_tokens_give(spark, of):
    texts = ["", "go(); /* } */ function f(a, b) { if (a) { g(b); } else { h(); } }", "const o = { k: (x) => x ? y(x) : z, m() { for (;;) { n(); } } }", ") } class A { b() { c(); }", "// only words"]
    files = spark.createDataFrame([(f"{k}.js", text, "javascript") for k, text in enumerate(texts)] + [("a.py", "f()", "python"), ("n.js", None, "javascript")], "path string, content string, language string")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(of(files)) == rows(of(lexer.tokens(files))) != []


def test_calls_are_found_in_the_scan(spark, sf_dir):
    assert scanned_once(catalog.queries()["code_scoped_calls"](spark, sf_dir))


def test_a_call_that_begins_a_file_is_found_and_each_once(spark):
    files = spark.createDataFrame([("a.js", "go();", "javascript"), ("b.kt", "enum class E { x = f() }", "kotlin")], "path string, content string, language string")
    got = sorted((r.file, r.to_fn) for r in lexer.calls(files).collect())
    assert got == [("a.js", "go"), ("b.kt", "f")]


def test_scopes_are_found_in_the_scan(spark, sf_dir):
    assert scanned_once(catalog.queries()["code_scopes"](spark, sf_dir))


def test_bindings_are_found_in_the_scan(spark, sf_dir):
    assert scanned_once(catalog.queries()["unused_bindings"](spark, sf_dir))


def test_a_name_that_a_chain_sets_is_not_read(spark):
    files = spark.createDataFrame([("a.js", "let x; y = x = 3;", "javascript")], "path string, content string, language string")
    assert [r.name for r in deadcode.unused_bindings(files).collect()] == ["x"]


def test_exports_and_their_uses_come_of_one_scan(spark, sf_dir):
    text = "export const a = 1, b = a; export function c() { return c() + b; } export { d as e, b }; export { q } from './q'; export default f;"
    files = spark.createDataFrame([("m.js", text, "javascript"), ("n.ts", "export let g = 1; g = 2;", "typescript")], "path string, content string, language string")
    found = deadcode.exports(files, used=True)
    assert plan(found).count("Exchange ") == 1
    tokens = lexer.tokens(files)
    read = {tuple(r) for r in deadcode.uses(tokens).select("file", "name").collect()}
    assert {(r.file, r.name, r.line): r.used for r in found.collect()} == {(r.file, r.name, r.line): (r.file, r.name) in read for r in deadcode.exports(tokens).collect()}
    assert plan(catalog.queries()["unused_exports"](spark, sf_dir)).count("MapInArrow") == 1


def test_flows_deal_lines_once(spark, sf_dir):
    p = plan(catalog.queries()["variable_flows"](spark, sf_dir))
    # lines by scope, results by place; nothing is joined or read from a copy
    assert p.count("Exchange ") == 2 and "Join" not in p and "ExistingRDD" not in p


def test_flows_of_odd_lines(spark):
    texts = ["x = req.query", "x = req.query; db.query(x)", "y = x", "[y, z] = escape(x)", "db.query(z + y)", None, "eval(y) // no"]
    lines = [("a", line, text) for line, text in zip([1, 1, 2, 2, 3, 3, 4], texts, strict=True)] + [("b", None, "db.query(req.query)"), ("b", 2, "db.query(x)")]
    got = {tuple(r) for r in dataflow.flows(spark.createDataFrame(lines, "file string, line long, text string")).collect()}
    assert got == {("a", 1, "request", 1, "sql", False), ("a", 1, "request", 3, "sql", False), ("a", 1, "request", 4, "code", False), ("b", None, "request", None, "sql", False)}
