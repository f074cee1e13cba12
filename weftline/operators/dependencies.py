"""Dependencies: version ranges, drift between what is declared and used, names that look like typing errors, environment variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import in_range


def vulnerable(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages (ecosystem, name, version) that an advisory's range (ecosystem, name, advisory, range: comparisons joined by commas) covers."""
    both = packages.join(advisories, ["ecosystem", "name"])
    return both.where(F.forall(F.split("range", ","), lambda r: in_range(F.col("version"), r)))


def drift(declared: DataFrame, used: DataFrame) -> DataFrame:
    """name and state: missing (used, not declared), unused, mismatch (versions differ). One full outer join."""
    both = declared.select("name", F.col("version").alias("declared")).join(used.select("name", F.col("version").alias("used"), F.lit(1).alias("_u")), "name", "full_outer")
    state = F.when(F.col("declared").isNull(), "missing").when(F.col("_u").isNull(), "unused").when(F.col("declared") != F.col("used"), "mismatch")
    return both.select("name", "declared", "used", state.alias("state")).where("state IS NOT NULL")


def typos(unknown: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """Pairs of an unknown and a known name that share their first two letters and differ by ``most`` edits or fewer: name, meant, edits."""
    a = unknown.select("name", F.substring("name", 1, 2).alias("_p")).distinct()
    b = known.select(F.col("name").alias("meant"), F.substring("name", 1, 2).alias("_p")).distinct()
    both = a.join(b, "_p").where((F.col("name") != F.col("meant")) & (F.abs(F.length("name") - F.length("meant")) <= most))
    return both.select("name", "meant", F.levenshtein("name", "meant").alias("edits")).where(F.col("edits") <= most)


def env_audit(code_lines: DataFrame, documented: DataFrame) -> DataFrame:
    """Variables that code reads and no example file has, and the other way: name, state."""
    read = code_lines.select(F.explode(F.regexp_extract_all("text", F.lit(r"""(?:process\.env\.|os\.environ\[["']|os\.getenv\(["']|env::var\(["'])([A-Z][A-Z0-9_]*)"""), 1)).alias("name")).distinct()
    doc = documented.select("name").distinct()
    return read.join(doc, "name", "left_anti").withColumn("state", F.lit("undocumented")).unionByName(doc.join(read, "name", "left_anti").withColumn("state", F.lit("unused")))
