"""What decides whether larger tables fit: nothing whole through the driver, scans on all cores, rows in whole batches."""

from pyspark.sql import functions as F

from weftline.operators import control, dataflow, deadcode
from weftline.sources import imports, lexer

SCRIPT = "function f(a) { if (a) { g(a); } }\n"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one_split(spark, content, n=40, ending=".js"):
    return spark.range(n, numPartitions=1).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(ending)).alias("path"), F.lit(content).alias("content"), F.lit("javascript").alias("language"))


def test_scans_are_dealt_to_all_tasks(spark):
    for found in (lexer.tokens(one_split(spark, SCRIPT)), control.facts(one_split(spark, "def f():\n  return 1\n", ending=".py"))):
        tasks = found.select(F.spark_partition_id().alias("p"), "file").distinct().groupBy("p").count().collect()
        assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 40


def test_a_batch_holds_rows_of_many_files(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    # 40 files of 19 tokens: without a shuffle between, batches come as the scan made them
    seen = lexer.tokens(one_split(spark, SCRIPT)).mapInArrow(sizes, "n long")
    assert seen.count() < 40


def test_tokens_are_never_broadcast(spark):
    found = lexer.tokens(one_split(spark, SCRIPT))
    for df in (lexer.scopes(found), lexer.calls(found), lexer.symbols(found)):
        assert "BroadcastHashJoin" not in plan(df)
    assert {(r.name, r.parameters, r.cyclomatic) for r in lexer.symbols(found).collect()} == {("f", 1, 2)}


def test_dead_code_is_found_without_broadcasts(spark):
    found = lexer.tokens(one_split(spark, "export const a = 1; let b = 2;\n"))
    assert "BroadcastHashJoin" not in plan(deadcode.unused_bindings(found))
    files = one_split(spark, "import { a } from './f1';\n")
    bound = imports.resolved(imports.bindings(files), files.select("path"))
    left = deadcode.unused_exports(deadcode.exports(found), bound, uses=deadcode.uses(found))
    assert "BroadcastHashJoin" not in plan(left)
    assert "f1.js" not in {r.file for r in left.collect()} and left.count() == 39


def test_imports_are_found_by_stems_without_broadcasts(spark):
    files = one_split(spark, "import { a } from './f1.js';\nexport { a } from './f2';\n")
    bound = imports.resolved(imports.bindings(files), files.select("path"))
    assert "BroadcastHashJoin" not in plan(bound)
    assert bound.count() == 78  # all but f1's and f2's of themselves
    defined = spark.createDataFrame([("f2.js", "a")], "file string, name string")
    behind = imports.definitions_behind(bound, defined)
    assert "BroadcastHashJoin" not in plan(behind)
    assert {r.target for r in behind.collect()} == {"f2.js"}


def test_stems_choose_as_the_list_of_paths_does(spark):
    files = ["a.js", "a.ts", "a/index.ts", "src/a.js", "lib/a.js.ts", "lib/a.ts", "x/a.py", "a/__init__.py", "x/y/m.py"]
    asked = [("lib/b.js", "./a.js", "a"), ("b.js", "./a", "a"), ("b.js", "a", "a"), ("a.js", "./a", "a"), ("x/y/m.py", "a", "b"), ("x/y/m.py", "..a", "b"), ("b.css", "a.js", ""), ("lib/b.js", "..", "a")]
    paths = spark.createDataFrame([(f,) for f in files], "path string")
    found = spark.createDataFrame(asked, "file string, module string, name string")
    got = {(r.file, r.module): r.target for r in imports.resolved(found, paths).collect()}
    first = {(r.file, r.module): next((p for p in r.paths if p in files and p != r.file), None) for r in imports.candidates(found).collect()}
    assert got == {k: v for k, v in first.items() if v}
    assert got["lib/b.js", "./a.js"] == "lib/a.js.ts" and got["a.js", "./a"] == "a.ts"


def test_flows_are_found_without_broadcasts(spark):
    lines = spark.range(40, numPartitions=1).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.posexplode(F.array(F.lit("x = req.query"), F.lit("y = x"), F.lit("db.query(y)"))).alias("line", "text"))
    found = dataflow.flows(lines)
    assert "BroadcastHashJoin" not in plan(found)
    assert found.count() == 40
