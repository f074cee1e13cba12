"""N-gram Jaccard join (op3): texts whose sets of five-word shingles have a Jaccard similarity of THRESHOLD or more.

1. Identical texts form one node; all later steps name nodes by numbers. Every node has HASHES MinHash values; BANDS bands of ROWS values
   each make it a member of buckets. A pair at 0.8 shares no bucket once in 300,000 times.
2. Each bucket has a pivot, its least node, and every other member is compared with it: as many pairs as members, never all pairs.
   Pivots that are alike in several buckets count once.
3. Bayesian pruning: MinHash values are compared STEP at a time; with a uniform prior, a pair is dropped as soon as the posterior
   probability of THRESHOLD or more falls below the tolerance. The rest are verified exactly on their whole texts.
4. Verified links make classes, by connected components. A bucket whose members are in one class has nothing left to find.
5. In other buckets the members of different classes are compared with each other, each pair in the first bucket that it shares. A first
   pass prunes by signatures and gives the members with a candidate; a second one verifies their pairs on whole texts, likeliest first,
   leaves out pairs whose classes have met by then, and gives no more links than members. Large buckets are dealt out in pairs of blocks.
   So of links between classes that share a bucket only pruning loses any, and no class that is already one is compared with itself.
6. A link never leaves its class. Within each class every text is compared exactly with every other one, by the shingles that they share;
   classes are dealt out in pairs of blocks. Only counts come out, no pairs.

Result: a row for each row of documents: doc_id, class_id (least doc_id of the class) and n_links: the other copies of its text, plus the
different texts of its class that are linked with its text. Pivots decide where a link is found, not whether.
Texts without words are linked to nothing; texts of one to four words have one shingle of all their words. A null id is an id like
others (class_id is null only where all ids of a class are). Repeated rows are copies of each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import contain, shared, textscan
from weftline.llm.textscan import U

THRESHOLD, STEP = 0.8, 32
#: For pairs with a pivot and for those within a bucket alike.
TOLERANCE = 1e-4
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Blocks in which a bucket's members are compared.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Blocks in which a class's links are counted.
BLOCK_TEXTS = 1024
_MULTIPLIERS = textscan.mix(np.arange(1, HASHES + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F)) | U(1)


def text_hash() -> list:
    """128 bits that name a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("x1"), F.xxhash64(F.lit(1), text).alias("x2")]


def has_words():
    return F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def signatures(batch: pa.RecordBatch, text: int) -> list[bytes]:
    """HASHES values of 4 bytes for each text of a column; all texts have words."""
    out = []
    for _, h, m in contain.shingle_sets(batch.column(text)):
        begin = np.cumsum(m) - m
        sig = np.empty((len(m), HASHES), np.uint32)
        for f, a in enumerate(_MULTIPLIERS):
            sig[:, f] = np.minimum.reduceat(h * a, begin) >> U(32)
        out += [r.tobytes() for r in sig]
    return out


def nodes_of(docs: DataFrame) -> DataFrame:
    """A stored row for each different text with words: id (a number of its own), x1, x2, k (its least doc_id), copies, size, text, sig."""
    rows = docs.where(has_words()).select(F.col("doc_id").cast("long").alias("k"), "text", *text_hash())
    one = rows.groupBy("x1", "x2").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))

    def work(batch):
        for first in range(0, batch.num_rows, 1000):
            part = batch.slice(first, 1000)
            yield {n: part.column(i) for i, n in enumerate(part.schema.names)} | {"sig": signatures(part, 4)}

    signed = shared.by_batch(one, work, "x1 long, x2 long, k long, copies long, text string, sig binary")
    return shared.stored(signed.select(F.monotonically_increasing_id().alias("id"), "x1", "x2", "k", "copies", F.octet_length("text").cast("long").alias("size"), "text", "sig"))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, least number of matches with which a pair stays): where the posterior P(similarity >= threshold) >= tolerance.

    The prior is uniform, so that the posterior after m of n matches is Beta(m + 1, n - m + 1); its upper tail at t is the probability
    of m or fewer successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out.append((n, m))
                break
    return out


def survivors(a: np.ndarray, b: np.ndarray, stages: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b (signatures side by side) that stay after each comparison, and their matches."""
    left, seen, matches = np.arange(len(a)), 0, np.zeros(len(a), np.int32)
    for n, least in stages:
        matches[left] += (a[left, seen:n] == b[left, seen:n]).sum(1, dtype=np.int32)
        left = left[matches[left] >= least]
        seen = n
    return left, matches[left]


def _signature(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, HASHES)


def prune(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that may reach the threshold."""
    stages = least_matches()

    def work(batch):
        for first in range(0, batch.num_rows, 4096):
            part = batch.slice(first, 4096)
            left, _ = survivors(_signature(part.column(2).to_pylist()), _signature(part.column(3).to_pylist()), stages)
            yield {"a": part.column(0).take(pa.array(left)), "b": part.column(1).take(pa.array(left))}

    both = pairs.join(nodes.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").join(nodes.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
    return shared.by_batch(both.select("a", "b", "sa", "sb"), work, "a long, b long")


def shingle_lists(texts: pa.Array) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    sets: list[np.ndarray] = []
    for _, h, m in contain.shingle_sets(texts):
        sets += [np.unique(x) for x in np.split(h, np.cumsum(m)[:-1])]
    return sets


def alike(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Do two sorted sets reach the threshold?"""
    if not len(x) or not len(y) or min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return both / (len(x) + len(y) - both) >= threshold


def verify(pairs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) whose similarity is ``threshold`` or more, by their whole texts."""

    def work(batch):
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            keep = pa.array([alike(x, y, threshold) for x, y in zip(shingle_lists(part.column(2)), shingle_lists(part.column(3)), strict=True)])
            yield {"a": part.column(0).filter(keep), "b": part.column(1).filter(keep)}

    both = pairs.join(nodes.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(nodes.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return shared.by_batch(both.select("a", "b", "ta", "tb"), work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and root (the least number of its class) of each node that a link (a, b) names, roots left out: large-star and small-star rounds
    until nothing changes. What is joined on a hub is written out before, so that Spark can split the hub's rows."""

    def round_of(df):
        return shared.stored(df.where("u != w").select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w")).distinct())

    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "w"))).first())

    edges = round_of(links.select(F.col("a").alias("u"), F.col("b").alias("w")))
    mark = state(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = shared.stored(both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = round_of(both.where("w > u").join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")))
        own = shared.stored(large.groupBy("u").agg(F.min("w").alias("m")))
        small = large.join(own, "u").where("w != m").select(F.col("w").alias("u"), F.col("m").alias("w"))
        edges = round_of(small.unionByName(own.select("u", F.col("m").alias("w"))))
        if (now := state(edges)) == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("w").alias("root"))


def grouped(df: DataFrame, by: list[str], solve, schema: str) -> DataFrame:
    """``solve(rows)`` over the rows (tuples of df's columns, the first being ``by``) of each group; gives tuples as in schema. Callers
    bound a group's size by blocks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields, n = to_arrow_schema(StructType.fromDDL(schema)), len(by)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], schema=fields)

    def run(batches):
        group, rows, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != group and rows:
                    out += solve(rows)
                    rows = []
                    if len(out) > 5000:
                        yield batch_of(out)
                        out = []
                group = row[:n]
                rows.append(row)
        if rows:
            out += solve(rows)
        if out:
            yield batch_of(out)

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def dealt(members: DataFrame, blocks, group: str) -> DataFrame:
    """A member of block i meets all blocks j, in the task (min, max) of the two: columns lo, hi and i are added."""
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    rows = members.select("*", own.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
    return rows.select(group, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", *[c for c in members.columns if c not in (group, "n", "bytes", "blocks")])


def _candidates(sig: np.ndarray, cls: np.ndarray, block: np.ndarray, inside: bool, at: int, x: int, stages) -> tuple[np.ndarray, np.ndarray]:
    """Members y > x of other classes that may reach the threshold with x and share no bucket before this one, and their matches."""
    other = np.flatnonzero(cls[x + 1 :] != cls[x]) + x + 1
    other = other[(block[other] != block[x]) | inside]
    left, matches = survivors(np.broadcast_to(sig[x], (len(other), HASHES)), sig[other], stages)
    found = other[left]
    first = (sig[found].reshape(-1, BANDS, ROWS) == sig[x].reshape(BANDS, ROWS)).all(2).argmax(1) == at  # else another bucket sees to the pair
    return found[first], matches[first]


def _rest(buckets: DataFrame, roots: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between roots of classes that share a bucket; none is with a pivot, whose pairs have been compared."""
    stages = least_matches()
    named = buckets.where("n > 2").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_bands = shared.stored(named.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("band"))
    members = named.where("id != pivot").join(open_bands, "band", "left_semi").select("band", "at", "n", "bytes", "id", "root")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    by = ["band", "lo", "hi"]

    def active(rows):
        """Members with a candidate."""
        sig, block, cls = _signature([r[7] for r in rows]), np.array([r[3] for r in rows]), np.unique([r[6] for r in rows], return_inverse=True)[1]
        has = np.zeros(len(rows), bool)
        for x in range(len(rows)):
            found, _ = _candidates(sig, cls, block, rows[0][1] == rows[0][2], rows[0][4], x, stages)
            has[found] = True
            has[x] |= len(found) > 0
        return [rows[x][:7] for x in np.flatnonzero(has)]

    def links(rows):
        """Verified links that join classes."""
        sig, block, cls = _signature([r[7] for r in rows]), np.array([r[3] for r in rows]), np.unique([r[6] for r in rows], return_inverse=True)[1]
        sets = shingle_lists(pa.array([r[8] for r in rows], pa.string()))
        out = []
        for x in range(len(rows)):
            found, matches = _candidates(sig, cls, block, rows[0][1] == rows[0][2], rows[0][4], x, stages)
            for y in found[np.argsort(-matches, kind="stable")]:
                if cls[x] != cls[y] and alike(sets[x], sets[y], threshold):
                    out.append((rows[x][6], rows[y][6]))
                    cls[cls == cls[y]] = cls[x]
        return out

    schema = "band long, lo int, hi int, i int, at int, id long, root long"
    several = dealt(members, blocks, "band").join(nodes.select("id", "sig"), "id")
    some = shared.stored(grouped(several.select(*by, "i", "at", "id", "root", "sig"), by, active, schema))
    whole = some.join(nodes.select("id", "sig", "text"), "id").select(*by, "i", "at", "id", "root", "sig", "text")
    return grouped(whole, by, links, "a long, b long")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Nodes as nodes_of gives them; id and root of each node that is linked with others and isn't its class's root."""
    nodes = nodes_of(docs)
    band = F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)])).alias("at", "band")
    banded = nodes.select("id", "size", band)
    # counts are written out before they are joined, so that Spark can split the hot keys of the join
    sizes = shared.stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("id").alias("pivot")).where("n > 1"))
    buckets = shared.stored(banded.drop("size").join(sizes, "band"))
    pairs = buckets.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    may = shared.stored(prune(pairs, nodes))
    roots = shared.stored(components(shared.stored(verify(may, nodes, threshold))))
    met = shared.stored(_rest(buckets, roots, nodes, threshold))
    if met.isEmpty():
        return nodes, roots
    above = components(met).select(F.col("id").alias("root"), F.col("root").alias("top"))
    over = shared.stored(above)
    lifted = roots.join(over, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return nodes, shared.stored(lifted.unionByName(over.select(F.col("root").alias("id"), F.col("top").alias("root"))))


def shared_shingles(sets: list[np.ndarray]):
    """For each set in turn, how many of its members each of the sets has. sets: sorted, without repeats."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, number, found = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = found[number] > 1  # others are shared with no set
    by = np.argsort(number[several], kind="stable")
    holders, first = owner[several][by], np.cumsum(np.where(found > 1, found, 0)) - found
    ends = np.cumsum(size)
    for x, (end, n) in enumerate(zip(ends, size, strict=True)):
        own = number[end - n : end][several[end - n : end]]
        m = found[own]
        if len(own):
            yield x, np.bincount(holders[np.repeat(first[own] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))], minlength=len(sets))
        else:
            yield x, np.zeros(len(sets), np.int64)


def members_of(roots: DataFrame) -> DataFrame:
    """id and root of every node of a class of two or more, its root among them."""
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def link_counts(nodes: DataFrame, roots: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id and links: how many other nodes of its class each node is linked with."""
    members = shared.stored(members_of(roots).join(nodes.select("id", "size"), "id"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int")
    sizes = shared.stored(members.groupBy("root").agg(blocks.alias("blocks")))
    by = ["root", "lo", "hi"]
    whole = dealt(members.drop("size").join(sizes, "root"), F.col("blocks"), "root").join(nodes.select("id", "text"), "id")

    def count(rows):
        sets = shingle_lists(pa.array([r[5] for r in rows], pa.string()))
        size, block = np.array([len(x) for x in sets]), np.array([r[3] for r in rows])
        inside = rows[0][1] == rows[0][2]
        for x, both in shared_shingles(sets):
            linked = both / np.maximum(size + size[x] - both, 1) >= threshold
            linked &= (block != block[x]) | inside
            linked[x] = False
            yield rows[x][4], int(linked.sum())

    counted = grouped(whole.select(*by, "i", "id", "text"), by, count, "id long, links long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of every row of docs."""
    nodes, roots = join(docs)
    linked = members_of(roots).join(nodes.select("id", "k"), "id")
    tops = shared.stored(linked.groupBy("root").agg(F.min("k").alias("least")))
    counts = shared.stored(link_counts(nodes, roots))
    named = nodes.select("id", "x1", "x2", "k", "copies").join(roots, "id", "left").join(counts, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = shared.stored(named.join(tops, "root", "left").select("x1", "x2", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("k")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    rows = docs.select("doc_id", has_words().alias("words"), *text_hash()).join(named, ["x1", "x2"], "left")
    return rows.select("doc_id", F.when(F.col("words"), F.col("class_id")).otherwise(F.col("doc_id").cast("long")).alias("class_id"), F.when(F.col("words"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns: one of those with the class's least doc_id (nulls last). Texts without words all stay."""
    nodes, roots = join(docs)
    best = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "x1", "x2")).alias("best")
    linked = members_of(roots).join(nodes.select("id", "k", "x1", "x2"), "id").groupBy("root").agg(best).select("best.x1", "best.x2")
    alone = nodes.select("id", "x1", "x2").join(members_of(roots), "id", "left_anti").select("x1", "x2")
    x1, x2, row = (shared.fresh(docs, n) for n in ("hash_one", "hash_two", "whole_row"))
    heads = shared.stored(linked.unionByName(alone).select(F.col("x1").alias(x1), F.col("x2").alias(x2)))
    # copies of a text become one row before they move
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col("doc_id").isNull(), "doc_id")).alias(row)
    worded = docs.where(has_words()).withColumns(dict(zip((x1, x2), text_hash(), strict=True))).groupBy(x1, x2).agg(first)
    return worded.join(heads, [x1, x2], "left_semi").select(f"{row}.*").unionByName(docs.where(~has_words()))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(shared.table(spark, sf_dir, "documents"))
