"""Graph operators: lookup, degrees, traversals, closure, cycles, impact.

Traversals are frontier loops: each level is one join of the frontier with the edges and one anti join with what has been seen. Every
level's new rows are checkpointed, so that plans stay small and a lost executor costs one level. Sets, not orders: the nodes of a level
come in no particular order, and where several parents lead to a node the least one is named.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most rows of what ``saved_sized`` broadcasts.
BROADCAST_ROWS = 100_000

#: Names of standard libraries that call resolution doesn't count as unresolved (fixed values), by language.
RUST_NAMES = frozenset(
    "to_owned to_string into from clone copy default as_ref as_mut borrow borrow_mut deref deref_mut into_iter iter iter_mut next size_hint map filter filter_map flat_map flatten collect fold for_each inspect enumerate "
    "zip unzip chain take skip take_while skip_while find find_map position any all count sum product min max min_by max_by rev peekable partition fuse expect unwrap unwrap_or unwrap_or_else unwrap_or_default ok err "
    "is_ok is_err ok_or ok_or_else is_some is_none some none push pop len is_empty clear extend append insert remove contains get get_mut entry capacity reserve shrink_to_fit truncate resize sort sort_by sort_unstable "
    "sort_unstable_by reverse swap split_at join concat repeat trim trim_start trim_end split split_whitespace lines chars bytes parse format format! print println eprint eprintln debug_assert assert panic todo "
    "unimplemented unreachable hash eq ne cmp partial_cmp clone_from drop new with_capacity spawn block_on read write close seek flush open create to_vec to_slice as_slice as_str box rc arc cell refcell".split()
)
PYTHON_NAMES = frozenset(
    "len range print type str int float list dict set tuple bool isinstance issubclass hasattr getattr setattr delattr callable enumerate zip map filter sorted reversed any all sum min max abs round pow open input format "
    "repr id hash dir super property staticmethod classmethod".split()
)
SCRIPT_NAMES = frozenset(
    "toString valueOf hasOwnProperty isPrototypeOf toLocaleString constructor prototype push pop shift unshift splice slice forEach map filter reduce find findIndex some every includes indexOf lastIndexOf join concat "
    "reverse sort flat flatMap keys values entries length charAt substring toUpperCase toLowerCase trim split replace match search test exec parse stringify assign freeze then catch finally resolve reject all race JSON "
    "Math Date RegExp Error Promise add delete has get set clear setTimeout setInterval clearTimeout clearInterval execSync execFileSync spawn fork addEventListener removeEventListener dispatchEvent allSettled any isArray "
    "from of create defineProperty getOwnPropertyNames fetch Request Response Headers require define pipe subscribe observe".split()
)
STANDARD_NAMES = tuple(sorted(RUST_NAMES | PYTHON_NAMES | SCRIPT_NAMES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; only a local session, all of it in one process, may
    leave that unset."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/weftline-shared"


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def saved_large(df: DataFrame) -> DataFrame:
    """``saved`` for what a scan or an explode gives: Spark takes its size for that of the input, so it is joined by sorting, never broadcast."""
    return saved(df).hint("merge")


def saved_sized(df: DataFrame) -> DataFrame:
    """``saved``; in joins it is broadcast if it has at most BROADCAST_ROWS rows, else sorted."""
    df = saved(df)
    return df.hint("broadcast" if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else "merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """Rows written by columns in the shared folder: a fraction of a checkpoint's size where values repeat."""
    path = f"{shared_folder(df.sparkSession)}/weftline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes by name in tiers: 1 exact, 2 the same but for case, 3 part of the name (any case) or of the id (this case). The first
    tier that has any answers. ``tier`` is added."""
    tier = F.when(F.col("name") == name, 1).when(F.lower("name") == name.lower(), 2).when(F.lower("name").contains(name.lower()) | F.col("node_id").contains(name), 3)
    found = nodes.withColumn("tier", tier).where("tier IS NOT NULL")
    first = found.agg(F.min("tier").alias("first"))
    return found.join(F.broadcast(first), F.col("tier") == F.col("first")).drop("first")


def _hops(edges: DataFrame, direction: str, max_depth: int) -> DataFrame:
    """near and far ends of edges. A walk of a few levels reads the edges where they are; a longer one writes them out once."""
    near, far = ("source_id", "target_id") if direction == "callees" else ("target_id", "source_id")
    hops = edges.where("source_id != target_id").select(F.col(near).alias("near"), F.col(far).alias("far"))
    return saved(hops.distinct()) if max_depth > 3 else hops


def traverse(edges: DataFrame, starts: DataFrame, max_depth: int = 5, direction: str = "callees", unresolved: bool = False) -> DataFrame:
    """Nodes within max_depth of any start, once each: start, node_id, depth, parent. starts: node_id. Self edges are skipped; the start
    isn't listed. callees follows edges, callers goes against them. unresolved: edges without a target give rows with a null node_id and
    the called name (to_fn, if edges have it) of each node that is reached before max_depth."""
    hops = _hops(edges, direction, max_depth)
    frontier = starts.select(F.col("node_id").alias("start"), "node_id").distinct()
    seen = saved(frontier.select("start", "node_id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.select("start", F.col("node_id").alias("near")).join(hops, "near").groupBy("start", F.col("far").alias("node_id")).agg(F.min("near").alias("parent"))
        frontier = saved(step.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti").select("start", "node_id", F.lit(depth).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        seen = saved(seen.unionByName(frontier)) if depth % 4 == 0 else seen.unionByName(frontier)
    found = seen.where("depth > 0")
    if not unresolved:
        return found
    name = F.col("to_fn") if "to_fn" in edges.columns else F.lit(None).cast("string")
    loose = edges.where("target_id IS NULL").select(F.col("source_id").alias("node_id"), name.alias("to_fn")).distinct()
    open_calls = seen.where(F.col("depth") < max_depth).join(loose, "node_id").select("start", F.lit(None).cast("string").alias("node_id"), (F.col("depth") + 1).alias("depth"), F.col("node_id").alias("parent"), "to_fn")
    return found.withColumn("to_fn", F.lit(None).cast("string")).unionByName(open_calls)


def nearest(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, direction: str = "callees") -> DataFrame:
    """node_id and depth, the least number of edges from any start; starts at 0. One row for each node, however many starts there are."""
    hops = _hops(edges, direction, max_depth or 1 << 30)
    seen = frontier = saved(starts.select("node_id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select(F.col("node_id").alias("near")).join(hops, "near").select(F.col("far").alias("node_id")).distinct()
        frontier = saved(step.join(seen.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = saved(seen.unionByName(frontier)) if depth % 4 == 0 else seen.unionByName(frontier)
    return seen


def trace(edges: DataFrame, starts: DataFrame, max_depth: int = 5, direction: str = "callees", most: int | None = 500) -> DataFrame:
    """start, node_id, depth and path (names joined by ' -> ', of the least parents), the start at depth 0; at most ``most`` rows by depth."""
    found = traverse(edges, starts, max_depth, direction)
    out = starts.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("depth"), F.col("node_id").alias("path")).distinct()
    level = out
    for depth in range(1, max_depth + 1):
        step = found.where(F.col("depth") == depth)
        level = step.join(level.select("start", F.col("node_id").alias("parent"), F.col("path").alias("before")), ["start", "parent"]).select("start", "node_id", "depth", F.concat_ws(" -> ", "before", "node_id").alias("path"))
        out = out.unionByName(level)
    return out if most is None else out.orderBy("depth", "start", "node_id").limit(most)


def paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, longest: int = 8) -> DataFrame:
    """Simple paths of up to ``longest`` edges from any source to any sink: source, sink, length, path. Only nodes between them take part."""
    forward, back = traverse(edges, sources, longest, "callees"), traverse(edges, sinks, longest, "callers")
    inner = forward.select("node_id").unionByName(sources.select("node_id")).distinct().join(back.select("node_id").unionByName(sinks.select("node_id")).distinct(), "node_id", "left_semi")
    hops = edges.where("source_id != target_id").select("source_id", "target_id").distinct()
    hops = saved(hops.join(inner.select(F.col("node_id").alias("source_id")), "source_id", "left_semi").join(inner.select(F.col("node_id").alias("target_id")), "target_id", "left_semi"))
    grown, out = sources.select(F.array("node_id").alias("nodes"), F.col("node_id").alias("end")).distinct(), None
    for length in range(1, longest + 1):
        grown = grown.join(hops, F.col("end") == F.col("source_id")).where(~F.array_contains("nodes", F.col("target_id"))).select(F.concat("nodes", F.array("target_id")).alias("nodes"), F.col("target_id").alias("end"))
        done = grown.join(sinks.select(F.col("node_id").alias("end")).distinct(), "end", "left_semi").select(F.col("nodes")[0].alias("source"), F.col("end").alias("sink"), F.lit(length).alias("length"), F.array_join("nodes", " -> ").alias("path"))
        out = done if out is None else out.unionByName(done)
    return out


def revisits(edges: DataFrame, found: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start, node_id, depth): nodes that a level reaches again after an earlier level had them (cyclic rows); the start counts from
    depth 2 on."""
    reached = found.select("start", "node_id", "depth").unionByName(starts.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("depth")))
    hops = edges.where("source_id != target_id").select(F.col("source_id").alias("node_id"), F.col("target_id").alias("far")).distinct()
    again = reached.where(F.col("depth") < max_depth).join(hops, "node_id").select("start", F.col("far").alias("node_id"), (F.col("depth") + 1).alias("depth")).distinct()
    first = reached.select("start", "node_id", F.col("depth").alias("first"))
    return again.join(first, ["start", "node_id"]).where("depth > first AND NOT (first = 0 AND depth <= 1)").select("start", "node_id", "depth")


def _doubled(paths: DataFrame, max_rounds: int) -> DataFrame:
    """Least dist of all pairs that paths (source_id, target_id, dist) lead to, joined with themselves until nothing changes."""
    size = None
    for _ in range(max_rounds):
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.target_id") == F.col("b.source_id")).select(F.col("a.source_id"), F.col("b.target_id"), (F.col("a.dist") + F.col("b.dist")).alias("dist"))
        paths = saved(paths.unionByName(longer).groupBy("source_id", "target_id").agg(F.min("dist").alias("dist")))
        now = tuple(paths.agg(F.count(F.lit(1)), F.sum("dist")).first())
        if now == size:
            break
        size = now
    return paths


def closure(edges: DataFrame, max_rounds: int = 32) -> DataFrame:
    """All (source_id, target_id) pairs with a path between them, with the least number of edges (dist). Edges may come several times.

    A path is longer than one edge only through inner nodes, which edges both enter and leave. Paths among these are found by doubling:
    each round joins paths with paths, so that rounds grow with the logarithm of the longest path. Edges out of them and into them are
    then added once; all others are only made distinct.
    """
    hops = written(edges.where("source_id != target_id").select("source_id", "target_id"), "edges")
    ends = hops.select(F.col("source_id").alias("node_id"), F.lit(1).alias("end")).unionByName(hops.select(F.col("target_id").alias("node_id"), F.lit(2).alias("end")))
    inner = saved_sized(ends.groupBy("node_id").agg(F.bit_or("end").alias("ends")).where("ends = 3").select("node_id"))
    first, last = inner.withColumnRenamed("node_id", "source_id"), inner.withColumnRenamed("node_id", "target_id")
    leaving = saved(hops.join(first, "source_id", "left_semi").select("source_id", "target_id", F.lit(1).alias("dist")).distinct())
    entering = hops.join(last, "target_id", "left_semi").join(first, "source_id", "left_anti").select("source_id", F.col("target_id").alias("via")).distinct()
    core, exits = leaving.join(last, "target_id", "left_semi").select("source_id", "target_id", "dist"), leaving.join(last, "target_id", "left_anti").select("source_id", "target_id", "dist")
    onward = leaving
    if not core.isEmpty():
        core = _doubled(core, max_rounds)
        out = core.select("source_id", F.col("target_id").alias("via"), "dist").join(exits.select(F.col("source_id").alias("via"), "target_id"), "via").select("source_id", "target_id", (F.col("dist") + 1).alias("dist"))
        onward = core.unionByName(exits).unionByName(out).groupBy("source_id", "target_id").agg(F.min("dist").alias("dist"))
    onward = saved_sized(onward)
    longer = entering.join(onward.withColumnRenamed("source_id", "via"), "via").select("source_id", "target_id", (F.col("dist") + 1).alias("dist"))
    return hops.withColumn("dist", F.lit(1)).unionByName(onward).unionByName(longer).groupBy("source_id", "target_id").agg(F.min("dist").alias("dist"))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges (source_id, target_id), self edges aside, whose ends have both a way in and a way out among them: all that cycles can use."""
    hops = saved(edges.where("target_id IS NOT NULL AND source_id != target_id").select("source_id", "target_id").distinct())
    size = -1
    while (now := hops.count()) != size:
        size = now
        ins, outs = hops.select(F.col("target_id").alias("source_id")).distinct(), hops.select(F.col("source_id").alias("target_id")).distinct()
        hops = saved(hops.join(ins, "source_id", "left_semi").join(outs, "target_id", "left_semi").select("source_id", "target_id"))
    return hops


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """Simple cycles, each once: length and cycle, the nodes from the least one on, joined by ' -> '. longest: a bound in nodes, if wanted;
    there may be exponentially many cycles, for which ``cyclic_groups`` gives one row a node.

    A path starts at its least node and grows only through greater ones, so that a cycle is found at one place; self edges are cycles
    of length 1. Nodes that no cycle can hold are trimmed first.
    """
    hops = cyclic_core(edges)
    out = edges.where("source_id = target_id").select(F.lit(1).alias("length"), F.col("source_id").alias("cycle")).distinct()
    paths = hops.where("source_id < target_id").select(F.array("source_id", "target_id").alias("path"), F.col("target_id").alias("end"))
    length = 2
    while longest is None or length <= longest:
        closing = paths.join(hops, (F.col("end") == F.col("source_id")) & (F.col("target_id") == F.col("path")[0]))
        out = out.unionByName(closing.select(F.lit(length).alias("length"), F.array_join("path", " -> ").alias("cycle")))
        grown = paths.join(hops, F.col("end") == F.col("source_id")).where((F.col("target_id") > F.col("path")[0]) & ~F.array_contains("path", F.col("target_id")))
        paths = saved(grown.select(F.concat("path", F.array("target_id")).alias("path"), F.col("target_id").alias("end")))
        length += 1
        if paths.isEmpty():
            break
    return out


def cyclic_groups(edges: DataFrame) -> DataFrame:
    """node_id and group (its least node) of each node on a cycle of two or more: strongly connected components. Rounds colour every node
    with the least one that reaches it, then gather what reaches a colour's own node within the colour."""
    hops, out = cyclic_core(edges), None
    while not hops.isEmpty():
        names = hops.select(F.col("source_id").alias("node_id")).unionByName(hops.select(F.col("target_id").alias("node_id"))).distinct()
        colour = saved(names.withColumn("colour", F.col("node_id")))
        while True:
            came = hops.join(colour.withColumnRenamed("node_id", "source_id"), "source_id").groupBy(F.col("target_id").alias("node_id")).agg(F.min("colour").alias("came"))
            step = saved(colour.join(came, "node_id", "left").select("node_id", F.least("colour", "came").alias("colour"), (F.col("came") < F.col("colour")).alias("moved")))
            colour = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        named = hops.join(colour.select(F.col("node_id").alias("source_id"), F.col("colour").alias("c")), "source_id").join(colour.select(F.col("node_id").alias("target_id"), F.col("colour").alias("d")), "target_id")
        inner = saved(named.where("c = d").select("source_id", "target_id"))
        roots = colour.where("node_id = colour").select("node_id")
        back = traverse(inner, roots, 1 << 30, "callers").select("node_id", F.col("start").alias("group"))
        found = saved(back.unionByName(back.select(F.col("group").alias("node_id"), "group").distinct()))
        out = found if out is None else saved(out.unionByName(found))
        done = found.select("node_id").unionByName(roots).distinct()
        rest = inner.join(done.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti").join(done.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")
        hops = cyclic_core(rest)
    return edges.sparkSession.createDataFrame([], "node_id string, group string") if out is None else out


def between_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between nodes of different files: source_id, source_file, target_id, target_file. Those to a target without a file are dropped
    before sources are looked up."""
    at = nodes.where("file IS NOT NULL").select("node_id", "file")
    placed = edges.select("source_id", "target_id").join(at.select(F.col("node_id").alias("target_id"), F.col("file").alias("target_file")), "target_id")
    return placed.join(at.select(F.col("node_id").alias("source_id"), F.col("file").alias("source_file")), "source_id").where("source_file != target_file")


def module_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between files, each once: source_id and target_id are files."""
    return between_files(nodes, edges).select(F.col("source_file").alias("source_id"), F.col("target_file").alias("target_id")).distinct()


def without_cycles_of(found: DataFrame, others: DataFrame) -> DataFrame:
    """Cycles that are not also among ``others``, by their nodes from the least one on."""
    return found.join(others.select("cycle").distinct(), "cycle", "left_anti")


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """Pairs of nodes with edges both ways: a < b."""
    e = edges.select("source_id", "target_id").distinct()
    back = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return e.where("source_id < target_id").join(back, ["source_id", "target_id"], "left_semi").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))


def reference_counts(nodes: DataFrame, edges: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """node_id, name, ref_count (incoming edges, each counted) and status: active if it has any or is exported, else dead."""
    counts = edges.where("target_id IS NOT NULL").groupBy(F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("ref_count"))
    out = nodes.join(counts, "node_id", "left").select("node_id", "name", F.coalesce("ref_count", F.lit(0)).alias("ref_count"))
    if exported is not None:
        out = out.join(exported.select("node_id", F.lit(True).alias("_exported")).distinct(), "node_id", "left")
        return out.select("node_id", "name", "ref_count", F.when((F.col("ref_count") > 0) | F.col("_exported"), "active").otherwise("dead").alias("status"))
    return out.select("node_id", "name", "ref_count", F.when(F.col("ref_count") > 0, "active").otherwise("dead").alias("status"))


def fan_metrics(nodes: DataFrame, edges: DataFrame, fan_in_over: int = 10, fan_out_over: int = 15, distinct_files: bool = False) -> DataFrame:
    """file, fan_in, fan_out, instability and god_module. Fans count (node, other file) pairs, or files with distinct_files. Edges may come
    several times."""
    both = between_files(nodes, edges)
    if distinct_files:
        pairs = both.select("source_file", "target_file").distinct().withColumn("outs", F.lit(1))
    else:  # the first of a source's edges into a file counts for its fan_out, so that one grouping by targets gives both fans
        first = F.row_number().over(Window.partitionBy("source_id", "source_file", "target_file").orderBy("target_id")) == 1
        pairs = both.withColumn("outs", first.cast("int")).groupBy("target_id", "target_file", "source_file").agg(F.sum("outs").alias("outs"))
    counts = F.array(F.struct(F.col("source_file").alias("file"), F.lit(0).alias("fan_in"), F.col("outs").alias("fan_out")), F.struct(F.col("target_file").alias("file"), F.lit(1).alias("fan_in"), F.lit(0).alias("fan_out")))
    fans = pairs.select(F.explode(counts).alias("c")).groupBy("c.file").agg(F.sum("c.fan_in").alias("fan_in"), F.sum("c.fan_out").alias("fan_out"))
    total = nodes.where("file IS NOT NULL").select("file").distinct().join(fans, "file", "left").select("file", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    ratio = F.when(F.col("fan_in") + F.col("fan_out") == 0, 0.0).otherwise(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")))
    return total.select("file", "fan_in", "fan_out", F.round(ratio, 4).alias("instability"), ((F.col("fan_in") > fan_in_over) & (F.col("fan_out") > fan_out_over)).alias("god_module"))


def hotspots(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """Files with the most edges into their nodes; ties by name."""
    into = edges.groupBy(F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.where("file IS NOT NULL").join(into, "node_id").groupBy("file").agg(F.sum("n").alias("edges")).orderBy(F.desc("edges"), "file").limit(top)


def type_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def roots_and_leaves(edges: DataFrame) -> DataFrame:
    """node_id and role: root if nothing points to it, leaf if it points to nothing."""
    ends = edges.where("source_id != target_id").select("source_id", "target_id").distinct()
    roots = ends.select(F.col("source_id").alias("node_id")).distinct().join(ends.select(F.col("target_id").alias("node_id")), "node_id", "left_anti").withColumn("role", F.lit("root"))
    leaves = ends.select(F.col("target_id").alias("node_id")).distinct().join(ends.select(F.col("source_id").alias("node_id")), "node_id", "left_anti").withColumn("role", F.lit("leaf"))
    return roots.unionByName(leaves)


def impact(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 3, action: str = "modify") -> DataFrame:
    """Who is touched when ``start`` changes: node_id, depth, relation (caller, callee) and risk. Direct callers are high, others fall
    off with depth; when it is deleted, callees that nothing else calls become dead (high)."""
    begin = nodes.where(F.col("node_id") == start).select("node_id")
    up = traverse(edges, begin, depth, "callers").select("node_id", "depth", F.lit("caller").alias("relation"))
    risk = F.when(F.col("depth") == 1, "high").when(F.col("depth") == 2, "medium").otherwise("low")
    up = up.withColumn("risk", risk)
    down = edges.where((F.col("source_id") == start) & (F.col("target_id") != start)).select(F.col("target_id").alias("node_id")).distinct()
    if action == "delete":
        others = edges.where(F.col("source_id") != start).select(F.col("target_id").alias("node_id")).distinct().withColumn("_called", F.lit(True))
        down = down.join(others, "node_id", "left").select("node_id", F.lit(1).alias("depth"), F.lit("callee").alias("relation"), F.when(F.col("_called").isNull(), "high").otherwise("low").alias("risk"))
    else:
        down = down.select("node_id", F.lit(1).alias("depth"), F.lit("callee").alias("relation"), F.lit("low").alias("risk"))
    return up.unionByName(down)


def affected_files(nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Files that depend on changed files through edges between files, with the least depth; the changed ones at 0. max_depth None: no bound."""
    return nearest(module_edges(nodes, edges), changed.select(F.col("file").alias("node_id")), max_depth, "callers").select(F.col("node_id").alias("file"), "depth")


def tree(rows: list) -> list[dict]:
    """Nested {node_id, depth, children} of the rows of a trace (as ``trace`` bounds and orders them), by their paths."""
    made: dict[str, dict] = {}
    tops = []
    for r in sorted(rows, key=lambda r: (r["depth"], r["path"])):
        made[r["path"]] = node = {"node_id": r["node_id"], "depth": r["depth"], "children": []}
        above = made.get(r["path"].rpartition(" -> ")[0])
        (tops if above is None else above["children"]).append(node)
    return tops


def resolve_calls(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Match raw calls (call_id, file, to_fn) with nodes by name. Candidates: the name itself, its other case (snake or camel), the part
    after the last dot; a better kind wins, then the caller's own file, then least file and line. status is resolved, std_lib (no candidate, and
    the name of a standard library) or unresolved; the latter two have a null target and confidence 0.5."""
    from weftline.functions.text import alternate_case

    raw = calls
    wanted = raw.select("call_id", F.col("file").alias("from_file"), "to_fn", F.explode(F.array_distinct(F.array(F.struct(F.lit(1).alias("rank"), F.col("to_fn").alias("name")), F.struct(F.lit(2).alias("rank"), alternate_case(F.col("to_fn")).alias("name")), F.struct(F.lit(3).alias("rank"), F.element_at(F.split("to_fn", r"\."), -1).alias("name"))))).alias("c"))
    wanted = wanted.select("call_id", "from_file", "to_fn", "c.rank", "c.name")
    found = wanted.join(nodes.select("name", "node_id", "file", "line"), "name")
    best = found.groupBy("call_id").agg(F.min(F.struct("rank", (~F.coalesce(F.col("file") == F.col("from_file"), F.lit(False))).alias("elsewhere"), "file", "line", "node_id")).alias("b"))
    return raw.join(best, "call_id", "left").select("call_id", "file", "to_fn", F.col("b.node_id").alias("target_id"), F.when(F.col("b").isNull(), 0.5).otherwise(1.0).alias("confidence"), F.when(F.col("b").isNotNull(), "resolved").when(F.col("to_fn").isin(*STANDARD_NAMES), "std_lib").otherwise("unresolved").alias("status"))


#: Names that frameworks ask for, which may stand several times in a file (fixed values).
CONVENTION_NAMES = ("Page", "Layout", "Loading", "Error", "NotFound", "Template", "Default", "handler", "GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "middleware")


def duplicate_definitions(nodes: DataFrame) -> DataFrame:
    """Nodes beyond the first of their name in a file, by line then id: node_id, nth. CONVENTION_NAMES don't count."""
    nth = F.row_number().over(Window.partitionBy("file", "name").orderBy("line", "node_id"))
    return nodes.where(~F.col("name").isin(*CONVENTION_NAMES)).withColumn("nth", nth).where("nth > 1").select("node_id", "nth")


def last_definitions(nodes: DataFrame, order: str = "ordinal") -> DataFrame:
    """One row for each node_id, the last by ``order``."""
    return nodes.withColumn("_n", F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def merged(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of several repositories' nodes with a ``repo`` column, ids prefixed by it."""
    tagged = [df.select(F.lit(repo).alias("repo"), F.concat(F.lit(f"{repo}::"), F.col("node_id")).alias("node_id"), *[c for c in df.columns if c != "node_id"]) for repo, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged)


def taint_fixpoint(flows: DataFrame, sources: DataFrame, sanitized: DataFrame | None = None, max_rounds: int = 20, decay: float = 0.9) -> DataFrame:
    """Taint that spreads along flows (source_id, target_id) from sources (node_id): node_id, origin, hops, confidence = decay to the
    power of hops, by the shortest way. Sanitized nodes take no taint."""
    hops = flows.where("source_id != target_id").select("source_id", "target_id").distinct()
    if sanitized is not None:
        hops = hops.join(sanitized.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    found = traverse(hops, sources, max_rounds, "callees")
    own = sources.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("depth")).distinct()
    every = own.unionByName(found.select("start", "node_id", "depth"))
    return every.select("node_id", F.col("start").alias("origin"), F.col("depth").alias("hops"), F.round(F.pow(F.lit(decay), F.col("depth")), 6).alias("confidence"))


def taint_reverse(flows: DataFrame, sinks: DataFrame, max_rounds: int = 20, decay: float = 0.95) -> DataFrame:
    """What may reach the sinks (node_id), against the flows: node_id, sink, hops, confidence = decay to the power of hops."""
    back = taint_fixpoint(flows.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), sinks, None, max_rounds, decay)
    return back.withColumnRenamed("origin", "sink")


def error_trace(edges: DataFrame, start: DataFrame, handlers: DataFrame, max_depth: int = 10) -> DataFrame:
    """How far an error in ``start`` goes up: callers until one that handles it. node_id, depth and handled."""
    caught = handlers.select(F.col("node_id").alias("target_id")).distinct()
    open_edges = edges.join(caught, "target_id", "left_anti")  # nothing goes up beyond a handler
    found = traverse(open_edges, start, max_depth, "callers")
    return found.join(handlers.select("node_id", F.lit(True).alias("handled")).distinct(), "node_id", "left").select("start", "node_id", "depth", F.coalesce("handled", F.lit(False)).alias("handled"))


#: Parts of names that convert between types, whose mutual calls are no design fault (fixed values).
CONVERSIONS = ("to_", "from_", "into_", "as_", "parse", "format", "convert", "serialize", "deserialize", "encode", "decode")


def cycle_severity(found: DataFrame, test_pattern: str = r"(?i)(^|/)tests?/|test_|\.test\.") -> DataFrame:
    """cycles with severity and source. info: self edges, cycles of more than eight nodes, of tests only, or of conversions only; else
    warning. source: test_only, test_mixed (some nodes are tests) or core."""
    names = F.split("cycle", " -> ")
    tests, some = F.forall(names, lambda n: n.rlike(test_pattern)), F.exists(names, lambda n: n.rlike(test_pattern))
    conversion = F.forall(names, lambda n: F.element_at(F.split(F.lower(n), "[:/.]"), -1).rlike("^(" + "|".join(CONVERSIONS) + ")"))
    info = (F.col("length") == 1) | (F.col("length") > 8) | tests | conversion
    return found.withColumn("severity", F.when(info, "info").otherwise("warning")).withColumn("source", F.when(tests, "test_only").when(some, "test_mixed").otherwise("core"))


def within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members (node_id)."""
    m = members.select("node_id").distinct()
    return edges.join(m.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(m.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


def receivers(calls: DataFrame, types: DataFrame, methods: DataFrame) -> DataFrame:
    """Resolve ``variable.method`` calls (call_id, file, to_fn) through what is known of variables (file, variable, type) and methods of
    types (type, name, node_id, line): call_id and target_id, the first by line."""
    parts = F.split("to_fn", r"\.")
    c = calls.where(F.size(parts) == 2).select("call_id", "file", parts[0].alias("variable"), parts[1].alias("name"))
    best = c.join(types, ["file", "variable"]).join(methods, ["type", "name"]).groupBy("call_id").agg(F.min(F.struct("line", "node_id")).alias("b"))
    return best.select("call_id", F.col("b.node_id").alias("target_id"))


def message_calls(invokes: DataFrame, commands: DataFrame) -> DataFrame:
    """Edges from calls by message name (source_id, command) to the functions that answer (node_id, name), in either case of the name;
    confidence 0.9."""
    from weftline.functions.text import alternate_case

    asked = invokes.select("source_id", F.explode(F.array_distinct(F.array("command", alternate_case(F.col("command"))))).alias("name"))
    return asked.join(commands.select("name", F.col("node_id").alias("target_id")), "name").select("source_id", "target_id", F.lit(0.9).alias("confidence")).distinct()
