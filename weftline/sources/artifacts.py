"""Artifacts: binary files by their first bytes, coverage reports, portable snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes in hexadecimal, and what they mean (fixed values).
MAGIC = {"0061736D": "wasm", "7F454C46": "elf", "4D5A": "pe", "CAFEBABE": "java_class", "FEEDFACE": "mach_o", "FEEDFACF": "mach_o", "CFFAEDFE": "mach_o", "504B0304": "zip", "1F8B": "gzip", "89504E47": "png", "FFD8FF": "jpeg", "25504446": "pdf", "47494638": "gif", "53514C69746520": "sqlite"}


def kind_of(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return F.coalesce(*[F.when(head.startswith(k), v) for k, v in MAGIC.items()])


def binaries(spark: SparkSession, root: str) -> DataFrame:
    """path, length and kind of files whose first bytes are known."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select("path", "length", kind_of(F.col("content")).alias("kind")).where("kind IS NOT NULL")


def coverage_lines(reports: DataFrame) -> DataFrame:
    """file, line and hits from lcov reports (path, content)."""
    parts = reports.select(F.explode(F.split("content", "end_of_record")).alias("record"))
    named = parts.select(F.regexp_extract("record", r"(?m)^SF:(.*)$", 1).alias("file"), F.explode(F.regexp_extract_all("record", F.lit(r"(?m)^DA:(\d+,\d+)"), 1)).alias("da"))
    return named.select("file", F.split("da", ",")[0].cast("long").alias("line"), F.split("da", ",")[1].cast("long").alias("hits"))


def coverage_percent(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file").agg(F.round(100 * F.avg((F.col("hits") > 0).cast("int")), 1).alias("percent"))


def export_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as compressed JSON lines below path; a task writes a part of it."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")


def import_snapshot(spark: SparkSession, path: str, name: str, schema: str, existing: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """A table of a snapshot; with ``existing``, merged into it by keys: rows that are there stay."""
    from weftline.operators.snapshots import merge_snapshot

    incoming = spark.read.schema(schema).json(f"{path}/{name}")
    return incoming if existing is None else merge_snapshot(existing, incoming.select(existing.columns), keys or [])


def cobertura_lines(reports: DataFrame) -> DataFrame:
    """file, line and hits of XML coverage reports (path, content) in which classes name a file and hold its lines; the most hits of a line."""
    classes = F.regexp_extract_all("content", F.lit(r"(?s)(<class\b[^>]*>.*?</class>)"), 1)
    one = reports.select(F.explode(classes).alias("c")).select(F.regexp_extract("c", r"<class\b[^>]*\bfilename=\"([^\"]*)\"", 1).alias("file"), F.explode(F.regexp_extract_all("c", F.lit(r"(<line\b[^>]*>)"), 1)).alias("l"))
    found = one.select("file", F.regexp_extract("l", r"\bnumber=\"(\d+)\"", 1).cast("long").alias("line"), F.regexp_extract("l", r"\bhits=\"(\d+)\"", 1).cast("long").alias("hits"))
    return found.groupBy("file", "line").agg(F.max("hits").alias("hits"))
