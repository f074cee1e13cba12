"""Packing into optimal length buckets (op1).

1. Histogram of all lengths, a row for each different one. The driver reads it: N units in all have at most sqrt(2 N) different lengths,
   a few million rows for 100 TB of text if no two texts were alike in length, and in practice some ten thousand.
2. Dynamic programming over the different lengths chooses the boundaries of at most ``buckets`` buckets with the least padding, every text
   padded to the longest of its bucket. The least cost over all earlier boundaries is read off the lower envelope of lines, so that a bucket
   takes one pass over the histogram. Equal costs: the lower boundary.
3. Inside a bucket texts stand in the order of doc_id (nulls first, then length) and are cut into batches of as many texts as the token
   budget holds at the bucket's length, one at least.

Positions come from a range partition by (bucket, doc_id, length): each partition numbers its own rows, and the counts of partitions and
buckets, partitions x buckets rows in all, give the offsets. No bucket is ever in one task. Only ids and lengths move, never texts.
An empty or null text has length 0 and is packed like any other; repeated rows each take a place; of rows with equal id and length it
doesn't matter which takes which place. ``pack`` takes lengths in any unit: ``word_lengths`` counts words, which SQL can check,
``token_lengths`` the ids of a vocabulary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import shared, tokens

BUCKETS, BUDGET = 8, 65_536


def boundaries(longest: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Longest length of each bucket, ascending, with the least padding over all texts; bins come in ascending order.

    With c and s as running sums of counts and lengths, ending a bucket at bin j after one that ends at bin i costs
    best[i] + m[j] * (c[j] - c[i]) - (s[j] - s[i]): for each i a line in m[j], with falling slopes -c[i], asked at rising m[j].
    """
    m = [int(x) for x in longest]
    n = len(m)
    if not n:
        return []
    c, s = ([0, *(int(x) for x in np.cumsum(x, dtype=np.int64))] for x in (counts, sums))
    best: list[int | None] = [0] + [None] * n
    back = []
    for _ in range(min(buckets, n)):
        new: list[int | None] = [None] * (n + 1)
        came = [0] * (n + 1)
        lines: list[tuple[int, int, int]] = []  # count, value at 0, bin
        at = 0
        for j in range(1, n + 1):
            if (cost := best[j - 1]) is not None:
                slope, value = c[j - 1], cost + s[j - 1]
                while len(lines) > 1 and _hidden(lines[-2], lines[-1], slope, value):
                    lines.pop()
                lines.append((slope, value, j - 1))
                at = min(at, len(lines) - 1)
            if not lines:
                continue
            x = m[j - 1]
            while at + 1 < len(lines) and lines[at + 1][1] - x * lines[at + 1][0] < lines[at][1] - x * lines[at][0]:
                at += 1
            slope, value, came[j] = lines[at]
            new[j] = value - x * slope + x * c[j] - s[j]
        back.append(came)
        best = new
    out, j = [], n
    for came in reversed(back):
        out.append(m[j - 1])
        j = came[j]
    return out[::-1]


def _hidden(one: tuple[int, int, int], two: tuple[int, int, int], slope: int, value: int) -> bool:
    """Is the second of three lines nowhere below both others?"""
    return (value - one[1]) * (two[0] - one[0]) <= (two[1] - one[1]) * (slope - one[0])


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """lengths has doc_id and length. Returns doc_id, length, bucket (from 0), bucket_length, batch (from 0, in its bucket) and slot."""
    bins = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").toArrow()
    longest, counts = (np.asarray(bins.column(c), np.int64) for c in ("length", "n"))
    tops = boundaries(longest, counts, longest * counts, buckets)
    bucket = F.lit(max(0, len(tops) - 1))
    for k in range(len(tops) - 2, -1, -1):
        bucket = F.when(F.col("length") <= tops[k], k).otherwise(bucket)
    key = ["bucket", F.col("doc_id").asc_nulls_first(), "length"]
    dealt = lengths.select("doc_id", "length", bucket.alias("bucket")).repartitionByRange(*key).sortWithinPartitions(*key)
    rows = shared.stored(dealt.select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("at")))
    counts = rows.groupBy("part", "bucket").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "bucket", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    top = F.element_at(F.array(*[F.lit(t).cast("long") for t in tops or [0]]), F.col("bucket") + 1)
    placed = rows.join(F.broadcast(offsets), ["part", "bucket"]).select("doc_id", "length", "bucket", top.alias("bucket_length"), (F.col("at") + F.col("offset")).alias("position"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_length"))))
    return placed.select("doc_id", "length", "bucket", "bucket_length", F.floor(F.col("position") / fit).alias("batch"), (F.col("position") % fit).alias("slot"))


def word_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(shared.WORD)), F.lit(0)).cast("long").alias("length"))


def token_lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and length of every row: the number of ids that the tokenizers library gives for the text by the vocabulary at this path."""

    def work(batch):
        code = tokens.encoder(vocabulary)
        for first in range(0, batch.num_rows, 1000):
            part = batch.slice(first, 1000)
            ids = code.encode([t or "" for t in part.column(1).to_pylist()])
            yield {"doc_id": part.column(0), "length": np.array([len(x) // code.dtype.itemsize for x in ids], np.int64)}

    return shared.by_batch(docs.select("doc_id", "text"), work, f"doc_id {dict(docs.dtypes)['doc_id']}, length long")


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(word_lengths(shared.table(spark, sf_dir, "documents")))


def _sql(buckets: int, budget: int) -> str:
    huge = 10**15
    steps = [f"d0 AS (SELECT 0 AS j, 0::HUGEINT AS cost, [0] AS came)"]
    for k in range(1, buckets + 1):
        steps.append(
            f"d{k} AS (SELECT b.j, min(a.cost + b.m * (b.c - coalesce(p.c, 0)) - (b.s - coalesce(p.s, 0))) AS cost, "
            f"list_append(arg_min(a.came, (a.cost + b.m * (b.c - coalesce(p.c, 0)) - (b.s - coalesce(p.s, 0))) * {huge} + a.j), b.j) AS came "
            f"FROM bins b JOIN d{k - 1} a ON a.j < b.j LEFT JOIN bins p ON p.j = a.j GROUP BY b.j)"
        )
    last = " UNION ALL ".join(f"SELECT {k} AS k, came FROM d{k} WHERE j = (SELECT max(j) FROM bins)" for k in range(1, buckets + 1))
    return f"""
WITH lengths AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '{shared.WORD}')), 0)::BIGINT AS length FROM documents),
hist AS (SELECT length AS m, count(*) AS n, sum(length) AS total FROM lengths GROUP BY length),
bins AS (SELECT row_number() OVER (ORDER BY m) AS j, m::HUGEINT AS m, sum(n) OVER (ORDER BY m) AS c, sum(total) OVER (ORDER BY m) AS s FROM hist),
{', '.join(steps)},
best AS (SELECT came FROM ({last}) ORDER BY k DESC LIMIT 1),
cuts AS (SELECT row_number() OVER (ORDER BY m) - 1 AS bucket, m::BIGINT AS bucket_length, coalesce(lag(m) OVER (ORDER BY m), -1)::BIGINT AS below FROM bins WHERE list_contains((SELECT came FROM best), j)),
placed AS (
  SELECT doc_id, length, bucket, bucket_length, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, length) - 1 AS position,
    greatest(1, {budget} // greatest(1, bucket_length)) AS fit
  FROM lengths JOIN cuts ON length > below AND length <= bucket_length)
SELECT doc_id, length, bucket::INT AS bucket, bucket_length, (position // fit)::BIGINT AS batch, (position % fit)::BIGINT AS slot FROM placed
"""


OP1_SQL = _sql(BUCKETS, BUDGET)
