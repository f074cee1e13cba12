"""Relations derived from the tables: a property graph, lines of text, references in pages, findings and snapshots.

Each function has a counterpart in SQL (the strings), which the queries' DuckDB versions are built on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Columns of the tables; with them, a plan is made without a job that reads file footers.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_nodes: node_id, node_type, name, file, line."""

    def part(name, kind, label, key, text, file):
        return table(spark, sf_dir, name).selectExpr(f"concat('{kind}:', {key}) AS node_id", f"'{label}' AS node_type", f"{text} AS name", f"{file} AS file", f"CAST({key} AS BIGINT) AS line")

    parts = [
        part("region", "region", "module", "r_regionkey", "r_name", "CAST(NULL AS STRING)"),
        part("nation", "nation", "file", "n_nationkey", "n_name", "concat('region:', n_regionkey)"),
        part("customer", "customer", "class", "c_custkey", "c_name", "concat('nation:', c_nationkey)"),
        part("supplier", "supplier", "class", "s_suppkey", "s_name", "concat('nation:', s_nationkey)"),
        part("part", "part", "type", "p_partkey", "p_name", "CAST(NULL AS STRING)"),
        part("orders", "order", "function", "o_orderkey", "concat('Order#:', o_orderkey)", "concat('month:', date_format(o_orderdate, 'yyyy-MM'))"),
    ]
    return reduce(DataFrame.unionAll, parts)


NODES = """SELECT 'region:' || r_regionkey AS node_id, 'module' AS node_type, r_name AS name, NULL::VARCHAR AS file, r_regionkey::BIGINT AS line FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'file', n_name, 'region:' || n_regionkey, n_nationkey FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'class', c_name, 'nation:' || c_nationkey, c_custkey FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'class', s_name, 'nation:' || s_nationkey, s_suppkey FROM supplier
UNION ALL SELECT 'part:' || p_partkey, 'type', p_name, NULL, p_partkey FROM part
UNION ALL SELECT 'order:' || o_orderkey, 'function', 'Order#:' || o_orderkey, 'month:' || strftime(o_orderdate, '%Y-%m'), o_orderkey FROM orders"""


def edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """graph_edges: source_id, target_id, edge_type, file, line, confidence. once False: an edge may come several times, for operators that
    make what they count distinct themselves; that spares a shuffle."""

    def part(df, source, target, kind, line):
        return df.selectExpr(f"concat({source}) AS source_id", f"concat({target}) AS target_id", f"'{kind}' AS edge_type", "CAST(NULL AS STRING) AS file", f"CAST({line} AS BIGINT) AS line", "1.0D AS confidence")

    t = {n: table(spark, sf_dir, n) for n in ("nation", "customer", "supplier", "orders", "lineitem")}
    bought = t["lineitem"].select("l_suppkey", "l_partkey")
    parts = [
        part(t["nation"], "'nation:', n_nationkey", "'region:', n_regionkey", "DEFINES", "n_nationkey"),
        part(t["customer"], "'customer:', c_custkey", "'nation:', c_nationkey", "USES_TYPE", "c_custkey"),
        part(t["supplier"], "'supplier:', s_suppkey", "'nation:', s_nationkey", "USES_TYPE", "s_suppkey"),
        part(t["orders"], "'order:', o_orderkey", "'customer:', o_custkey", "CALLS", "o_orderkey"),
        part(bought.distinct() if once else bought, "'supplier:', l_suppkey", "'part:', l_partkey", "IMPORTS", "l_partkey"),
    ]
    return reduce(DataFrame.unionAll, parts)


EDGES = """SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'DEFINES' AS edge_type, NULL::VARCHAR AS file, n_nationkey::BIGINT AS line, 1.0::DOUBLE AS confidence FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'USES_TYPE', NULL, c_custkey, 1.0 FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'USES_TYPE', NULL, s_suppkey, 1.0 FROM supplier
UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'CALLS', NULL, o_orderkey, 1.0 FROM orders
UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'IMPORTS', NULL, l_partkey, 1.0 FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"""


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense call graph with cycles: each user's next event (by ts, then event_id), by user and event type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    name = F.concat_ws("/", F.concat(F.lit("u"), F.col("user_id").cast("string")), "event_type")
    return table(spark, sf_dir, "events").select(name.alias("source_id"), F.lead(name).over(w).alias("target_id")).where("target_id IS NOT NULL").distinct()


EVENT_CALLS = """SELECT DISTINCT source_id, target_id FROM (
  SELECT 'u' || user_id || '/' || event_type AS source_id, lead('u' || user_id || '/' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target_id FROM events) WHERE target_id IS NOT NULL"""


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, line (from 1) and text of every line of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(_id("doc", "doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "text")).select("file", (F.col("at") + 1).cast("long").alias("line"), "text")


SOURCE_LINES = """SELECT 'doc:' || doc_id AS file, unnest(generate_series(1, len(l)))::BIGINT AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in pages, one for each occurrence: name, entry_type (class), category (html), path."""
    names = F.explode(F.regexp_extract_all("html", F.lit(r'class="([^"]*)"'), 1)).alias("names")
    return table(spark, sf_dir, "pages").select(_id("page", "page_id").alias("path"), names).select(F.explode(F.split(F.trim("names"), r" +")).alias("name"), F.lit("class").alias("entry_type"), F.lit("html").alias("category"), "path")


REFS = """SELECT unnest(string_split_regex(trim(names), ' +')) AS name, 'class' AS entry_type, 'html' AS category, path FROM (SELECT 'page:' || page_id AS path, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS names FROM pages)"""
