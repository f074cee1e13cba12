"""Snapshots and time: diffs, baselines, trends, change detection, retention, incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def node_diff(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key and change: added, removed or changed; rows that are the same don't show. One full outer join on the key."""
    row = F.struct(*values)
    a, b = old.select(key, row.alias("_old"), F.lit(1).alias("_a")), new.select(key, row.alias("_new"), F.lit(1).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def occurrences(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with the ordinal (from 0) of each among those with the same keys."""
    return rows.withColumn("occurrence", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges added and removed, as sets: source_id, target_id, change."""
    a, b = (d.select("source_id", "target_id").distinct() for d in (old, new))
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))


def baseline(current: DataFrame, known: DataFrame, key: str = "finding_id") -> DataFrame:
    """key and state: new (not in the baseline), resolved (only there) or unchanged."""
    a, b = current.select(key, F.lit(1).alias("_a")).distinct(), known.select(key, F.lit(1).alias("_b")).distinct()
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "resolved").otherwise("unchanged").alias("state"))


def severity_delta(current: DataFrame, known: DataFrame) -> DataFrame:
    """severity, current, baseline and delta."""
    both = current.select("severity", F.lit(1).alias("c"), F.lit(0).alias("b")).unionByName(known.select("severity", F.lit(0).alias("c"), F.lit(1).alias("b")))
    return both.groupBy("severity").agg(F.sum("c").alias("current"), F.sum("b").alias("baseline"), (F.sum("c") - F.sum("b")).alias("delta"))


def trend(series: DataFrame, key: str, at: str, value: str, up_is_good: bool = False) -> DataFrame:
    """Each point with its change from the one before: delta and direction (improved, degraded, stable; null at the first point)."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(at))
    delta = F.col(value) - before
    better = delta > 0 if up_is_good else delta < 0
    return series.withColumn("delta", delta).withColumn("direction", F.when(delta.isNull(), None).when(delta == 0, "stable").when(better, "improved").otherwise("degraded"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where("_n = 1").drop("_n")


def keep_last(snapshots: DataFrame, at: str, most: int = 20) -> DataFrame:
    """Rows of the newest ``most`` snapshots: the ids are ranked, not the rows."""
    ids = snapshots.select(at).distinct().orderBy(F.desc(at)).limit(most)
    return snapshots.join(F.broadcast(ids), at, "left_semi")


def changed_files(current: DataFrame, known: DataFrame) -> DataFrame:
    """path and change (new, deleted, changed) of files by path and content_hash."""
    both = current.select("path", F.col("content_hash").alias("now")).join(known.select("path", F.col("content_hash").alias("then")), "path", "full_outer")
    return both.select("path", F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "changed").alias("change")).where("change IS NOT NULL")


def stale(current: DataFrame, indexed: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Files whose mtime is newer than the indexed one by more than ``tolerance`` seconds and whose hash differs: path, age."""
    both = current.alias("c").join(indexed.alias("i"), "path").where((F.col("c.mtime") - F.col("i.mtime") > tolerance) & (F.col("c.content_hash") != F.col("i.content_hash")))
    return both.select("path", (F.col("c.mtime") - F.col("i.mtime")).alias("age"))


def set_hash(rows: DataFrame, path: str = "path", value: str = "content_hash") -> DataFrame:
    """One hash of a set of files, whatever their order: a sum of row hashes beside their number, combined by SHA-256."""
    return rows.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(F.pmod(F.xxhash64(path, value), F.lit(1 << 40))).cast("string"), F.bit_xor(F.xxhash64(value, path)).cast("string")).cast("binary"), 256).alias("set_hash"))


def merge_snapshot(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing plus the rows of incoming whose keys it doesn't have."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys))


def refresh(existing: DataFrame, parsed: DataFrame, changed: DataFrame, file: str = "file") -> DataFrame:
    """Replace the rows of changed (and deleted) files by newly parsed ones; all others stay untouched."""
    return existing.join(changed.select(F.col("path").alias(file)).distinct(), file, "left_anti").unionByName(parsed)
