"""Near-duplicate vectors: pairs of a cosine of 0.9 or more, by a subspace pigeonhole join.

Unit vectors of a cosine c lie at a squared distance of 2 - 2 c. A rotation spreads what they have evenly over blocks of few dimensions; two
vectors within the distance are, in one block at least, within that block's share of it, which goes by its number of dimensions. So each block
is joined by itself: its first coordinate is cut into slabs as wide as the block's radius, a vector stands in its own slab and is a guest in the
next one, and a slab's vectors are compared with its guests and each other over the block. What is within the block's
budget is verified by the whole vectors in double precision.

A pair may be within budget in several blocks; it counts in the one where it takes the smallest part of the budget. Slabs of more than
``TILE`` vectors are dealt into tiles, and a task compares two tiles; it gives numbers of links and a spanning forest, never pairs. Equal vectors
are one with a multiplicity. The work, not the rows, is quadratic in a slab: where vectors point anywhere, slabs hold a fixed part of them.

Null, zero and non-finite vectors, those with a null component, and vectors of different lengths link with nothing. Each row of repeated rows
is a vector; a null vec_id is never the smallest of a component, and a component of null ids only has a null component_id, and is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import neardup, shared

THRESHOLD = 0.9
#: Dimensions of a block, at most; vectors of a tile; rows of one comparison on either side.
BLOCK_DIMS, TILE, LEFT, RIGHT = 16, 32768, 256, 2048
#: What single precision may be wrong by, in a squared distance within a block; how much wider slabs are than the radius.
SLACK, WIDER = 1e-4, 1 + 1e-6


def usable(vector):
    """A vector with numbers only, of which one isn't zero."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dims: int) -> np.ndarray:
    """An orthogonal matrix that depends on the dimensions only."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[slice]:
    n = -(-dims // BLOCK_DIMS)
    ends = [dims * k // n for k in range(n + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares of large or small numbers hold
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_dims(column: pa.Array):
    """(dimensions, rows, matrix) for each length among the rows."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(n):
        rows = np.flatnonzero(n == dims)
        yield int(dims), rows, _matrix(column.take(pa.array(rows)))


def _slabs(x: np.ndarray, turn: np.ndarray, radius: float):
    """(block, slab of each row) for each block; a row is a guest in the next slab."""
    turned = units(x) @ turn
    for k, part in enumerate(blocks_of(x.shape[1])):
        yield k, np.floor(turned[:, part.start] / (radius * np.sqrt((part.stop - part.start) / x.shape[1]) * WIDER)).astype(np.int64)


class Forest:
    """Classes of numbers 0 to n - 1, joined by links."""

    def __init__(self, n: int):
        self.up, self.edges = np.arange(n), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for s in range(0, len(a), 4096):
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]
            x, y = a[s : s + 4096], b[s : s + 4096]
            apart = self.up[x] != self.up[y]  # links within a class cost one look
            for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                r, t = self.root(i), self.root(j)
                if r != t:
                    self.up[max(r, t)] = min(r, t)
                    self.edges.append((i, j))


def linked(unit: np.ndarray, turned: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, threshold: float, may=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of left, of right: numbers of rows) that reach the threshold and use least of the budget in the block. may(x, y): are they to be
    compared."""
    parts = blocks_of(unit.shape[1])
    part, dims = parts[block], np.array([p.stop - p.start for p in parts])
    budget = np.float32((2 - 2 * threshold) * dims[block] / dims.sum() + SLACK)
    near = turned[:, part].astype(np.float32)
    size = (near * near).sum(1, keepdims=True)
    one = np.ones_like(size)
    # squared distances are products of rows of these two
    a, b = np.hstack([-2 * near, size, one])[left], np.hstack([near, one, size])[right].T.copy()
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for s in range(0, len(left), LEFT):
        for t in range(0, len(right), RIGHT):
            within = a[s : s + LEFT] @ b[:, t : t + RIGHT] <= budget
            if not within.any():
                continue
            i, j = np.nonzero(within)
            for k in range(0, len(i), 1 << 16):
                x, y = left[s + i[k : k + (1 << 16)]], right[t + j[k : k + (1 << 16)]]
                if may is not None:
                    keep = may(x, y)
                    x, y = x[keep], y[keep]
                keep = (unit[x] * unit[y]).sum(1) >= threshold
                x, y = x[keep], y[keep]
                d = (turned[x] - turned[y]) ** 2
                used = np.stack([d[:, p].sum(1) / n for p, n in zip(parts, dims, strict=True)])
                keep = used.argmin(0) == block
                out.append((x[keep], y[keep]))
    x, y = zip(*out, strict=True)
    return np.concatenate(x), np.concatenate(y)


def joined(nodes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Of nodes (node, vector, copies): rows (a, b, n). b null: node a is linked with n vectors more; else a and b are linked, and such links
    span each component."""
    spark, radius = nodes.sparkSession, float(np.sqrt(2 - 2 * threshold))
    lengths = [r.n for r in nodes.select(F.size("vector").alias("n")).distinct().collect()]  # one row for each length of vectors
    turns = shared.sent(spark, {n: rotation(n) for n in lengths})

    def count(batches):
        for batch in batches:
            for dims, _, x in _by_dims(batch.column(0)):
                for k, slab in _slabs(x, turns()[dims], radius):
                    u, n = np.unique(np.concatenate([slab, slab + 1]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), dims, np.int32)), pa.array(np.full(len(u), k, np.int32)), pa.array(u), pa.array(n)], ["dims", "block", "slab", "n"])

    # slabs lie between -1 and 1 and are as wide as the radius: no more of them than the radius allows, whatever the table
    sizes = nodes.select("vector").mapInArrow(count, "dims int, block int, slab long, n long").groupBy("dims", "block", "slab").agg(F.sum("n").alias("n")).collect()
    tiles = shared.sent(spark, {(r.dims, r.block, r.slab): -(-r.n // tile) for r in sizes})
    names = ["dims", "block", "slab", "i", "j", "side", "node", "copies", "vector"]
    inner = nodes.schema["vector"].dataType.elementType.simpleString()
    ddl = f"dims int, block int, slab long, i int, j int, side int, node long, copies long, vector array<{inner}>"

    def deal(batches):
        """side: 1 compared as left, 2 as right, 4 a guest."""
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            own = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for dims, rows, x in _by_dims(batch.column(1)):
                for k, slab in _slabs(x, turns()[dims], radius):
                    for is_guest, cell in ((False, slab), (True, slab + 1)):
                        n = np.array([tiles()[dims, k, c] for c in cell.tolist()], np.int64)
                        mine = own[rows] % np.maximum(n, 1)
                        for other in range(int(n.max(initial=0))):
                            meets = n > other
                            same = mine == other
                            that = np.full(len(n), other)
                            # a guest meets the own vectors of every tile; own vectors of two tiles meet where the first is left
                            ways = [(5, mine, that, meets)] if is_guest else [(3, mine, mine, meets & same), (1, mine, that, meets & (mine < that)), (2, that, mine, meets & ~same)]
                            for side, i, j, take in ways:
                                t = np.flatnonzero(take)
                                for s in range(0, len(t), 4096):
                                    u = t[s : s + 4096]
                                    full = rows[u]
                                    yield pa.RecordBatch.from_arrays([
                                        pa.array(np.full(len(u), dims, np.int32)), pa.array(np.full(len(u), k, np.int32)), pa.array(cell[u]), pa.array(i[u].astype(np.int32)), pa.array(j[u].astype(np.int32)), pa.array(np.full(len(u), side, np.int32)),
                                        batch.column(0).take(pa.array(full)), batch.column(2).take(pa.array(full)), batch.column(1).take(pa.array(full)),
                                    ], names)

    def compare(key, table):
        dims, block, i, j = (key[k].as_py() for k in (0, 1, 3, 4))
        node, copies, side = table["node"].to_numpy(), table["copies"].to_numpy(), table["side"].to_numpy()
        unit = units(_matrix(table["vector"]))
        turned = unit @ turns()[dims]
        own, guests, right = np.flatnonzero((side & 5) == 1), np.flatnonzero((side & 5) == 5), np.flatnonzero((side & 2) > 0)
        x, y = linked(unit, turned, guests, right, block, threshold)
        if i <= j:  # two tiles' own vectors meet once
            u, v = linked(unit, turned, own, right, block, threshold, (lambda a, b: node[a] < node[b]) if i == j else None)
            x, y = np.append(x, u), np.append(y, v)
        n = np.bincount(x, copies[y], len(node)) + np.bincount(y, copies[x], len(node))
        forest = Forest(len(node))
        forest.link(x, y)
        some = np.flatnonzero(n)
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        return pa.table({
            "a": pa.array(np.concatenate([node[some], node[edges[:, 0]]])), "b": pa.array(np.concatenate([np.zeros(len(some), np.int64), node[edges[:, 1]]]), mask=np.arange(len(some) + len(edges)) < len(some)),
            "n": pa.array(np.concatenate([n[some].astype(np.int64), np.ones(len(edges), np.int64)])),
        })

    rows = nodes.select("node", "vector", "copies").mapInArrow(deal, ddl)
    return rows.groupBy("dims", "block", "slab", "i", "j").applyInArrow(compare, "a long, b long, n long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding)."""
    h = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    rows = rows.select("vec_id", "embedding", usable("embedding").alias("whole"))
    same = rows.where("whole").groupBy(*h).agg(F.first("embedding").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    nodes = shared.stored(same.withColumn("node", F.monotonically_increasing_id()))
    found = shared.stored(joined(nodes.select("node", "vector", "copies"), threshold, tile))
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "node")
    roots = shared.stored(neardup.components(found.where("b IS NOT NULL").select("a", "b"))).withColumnRenamed("id", "node")
    ids = nodes.select("node", "h1", "h2", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = shared.stored(ids.groupBy("root").agg(F.min("least").alias("component_id")))
    ids = ids.join(least, "root").join(links, "node", "left")
    named = shared.stored(ids.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("named")))
    out = rows.select("vec_id", F.when(F.col("whole"), h[0]).alias("h1"), F.when(F.col("whole"), h[1]).alias("h2")).join(named, ["h1", "h2"], "left")
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op13_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "embeddings"))


OP13_SQL = f"""WITH RECURSIVE e AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.k AS a, b.k AS b FROM u AS a JOIN u AS b ON a.k <> b.k AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
r(k, to_k) AS (SELECT k, k FROM e UNION SELECT r.k, l.b FROM r JOIN l ON l.a = r.to_k),
c AS (SELECT r.k, min(e.vec_id) AS component_id FROM r JOIN e ON e.k = r.to_k GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = e.k) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM e JOIN c USING (k)"""
