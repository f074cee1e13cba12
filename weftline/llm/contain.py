"""Benchmark decontamination (op5): size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of five-word shingles into classes of one doubling each. For a class whose items have from b to
2b - 1 shingles, a document is cut into blocks of b successive shingles, however long it is, so that the sets compared are of like size.
Under each of HASHES hash functions the least value of a block is compared with the least value of each item; a document and an item
that agree anywhere are a candidate. A candidate is verified exactly: the share of the item's distinct shingles that stand in the whole
document must be THRESHOLD or more. An item region of which 0.8 is there agrees under one function with a chance of a quarter or more,
so that one in a million is missed at most.

The benchmark goes to the executors in blocks of at most BLOCK_BYTES of text, its size measured first; the documents are read once for
each block, whole, where they stand: nothing is shuffled. Items without words match nothing; an item of fewer than five words has one
shingle of all its words, which only a text of just these words has. Null texts have no words. Repeated rows each give their rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import shared, textscan
from weftline.llm.textscan import U

WORDS, THRESHOLD, HASHES, BLOCK_BYTES = 5, 0.8, 48, 16 << 20
_MULTIPLIERS = textscan.mix(np.arange(1, HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(texts: pa.Array):
    """(first row, buffer of shingle hashes, number for each text) for chunks of texts."""
    for first, _, buf, offs in textscan.chunks(texts):
        starts, ends, n = textscan.word_bounds(buf, offs)
        words = textscan.span_hashes(textscan.prefix_hashes(buf), starts, ends) if len(starts) else np.zeros(0, U)
        h, m = textscan.shingles(words, n, WORDS)
        yield first, h, m


class Index:
    """The items of one block of the benchmark: ids, distinct shingles, and least values by class and hash function."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.sets, self.classes = [], [], {}
        for first, h, m in shingle_sets(pa.array(texts, pa.string())):
            ends = np.cumsum(m)
            for k, (end, size) in enumerate(zip(ends, m, strict=True)):
                if size:
                    self.ids.append(ids[first + k])
                    self.sets.append(np.unique(h[end - size : end]))
        by_class: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            by_class.setdefault(1 << (len(s).bit_length() - 1), []).append(k)
        for size, items in sorted(by_class.items()):
            least = np.array([[(self.sets[k] * a).min() for k in items] for a in _MULTIPLIERS], U)
            order = np.argsort(least, 1)
            self.classes[size] = np.take_along_axis(least, order, 1), np.array(items)[order]

    def hits(self, h: np.ndarray, m: np.ndarray, threshold: float):
        """(document, item, shared shingles, item's shingles) over a chunk of documents' shingles."""
        if not len(h) or not self.sets:
            return
        pairs: set[tuple[int, int]] = set()
        begins = np.cumsum(m) - m
        sizes = list(self.classes)
        cuts, counts, unit, starts = {}, m, 1, begins
        for size in sizes:  # first block of each level in blocks of the level below
            ratio, blocks = size // unit, -(-counts // (size // unit))
            doc = np.repeat(np.arange(len(m)), blocks)
            own = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            cuts[size] = starts[doc] + own * ratio, doc
            counts, unit, starts = blocks, size, np.cumsum(blocks) - blocks
        for f, a in enumerate(_MULTIPLIERS):
            least = h * a
            for size in sizes:
                at, doc = cuts[size]
                least = np.minimum.reduceat(least, at)
                values, items = self.classes[size][0][f], self.classes[size][1][f]
                k = np.searchsorted(values, least)
                found = np.flatnonzero(values[np.minimum(k, len(values) - 1)] == least)
                for b in found:
                    j = k[b]
                    while j < len(values) and values[j] == least[b]:
                        pairs.add((int(doc[b]), int(items[j])))
                        j += 1
        have, last = np.zeros(0, U), -1
        for d, k in sorted(pairs):
            if d != last:
                have, last = np.unique(h[begins[d] : begins[d] + m[d]]), d
            item = self.sets[k]
            shared_n = int((have[np.minimum(np.searchsorted(have, item), len(have) - 1)] == item).sum())
            if shared_n / len(item) >= threshold:
                yield d, k, shared_n, len(item)


def _indexes(spark: SparkSession, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """A broadcast index for each block of the benchmark, one after another."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes) if total > block_bytes else 1)
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted(part.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield shared.sent(spark, Index([r[0] for r in rows], [r[1] for r in rows]))


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of each document and item that reach the threshold."""
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    out = None
    for index in _indexes(docs.sparkSession, benchmark, block_bytes):

        def work(batch, index=index):
            for first, h, m in shingle_sets(batch.column(1)):
                if found := list(index().hits(h, m, threshold)):
                    d, k, n, size = (np.array(x, np.int64) for x in zip(*found, strict=True))
                    yield {"doc_id": batch.column(0).take(pa.array(d + first)), "item_id": [index().ids[i] for i in k], "n_shared": n, "n_item": size, "containment": n / size}

        part = shared.by_batch(docs.select("doc_id", "text"), work, f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shared long, n_item long, containment double")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with all their columns."""
    for index in _indexes(docs.sparkSession, benchmark, block_bytes):

        def run(batches, index=index):
            for batch in batches:
                if batch.num_rows:
                    keep = np.ones(batch.num_rows, bool)
                    for first, h, m in shingle_sets(batch.column(batch.schema.names.index("text"))):
                        for d, *_ in index().hits(h, m, threshold):
                            keep[first + d] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


def _sql_shingles(table: str, key: str) -> str:
    w = f"regexp_extract_all(coalesce(text, ''), '{shared.WORD}')"
    return f"SELECT r, {key}, unnest(list_distinct(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM (SELECT row_number() OVER () AS r, {key}, {w} AS w FROM {table})"


OP5_SQL = f"""
WITH d AS ({_sql_shingles('documents', 'doc_id')}),
i AS ({_sql_shingles('(SELECT DISTINCT item_id, text FROM benchmark)', 'item_id')}),
size AS (SELECT r, count(*) AS n_item FROM i GROUP BY r)
SELECT d.doc_id, i.item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM d JOIN i USING (s) JOIN size ON size.r = i.r GROUP BY d.r, i.r, d.doc_id, i.item_id HAVING count(*) / any_value(n_item) >= {THRESHOLD}
"""
