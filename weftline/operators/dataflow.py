"""Dataflow: sources and sinks in lines, taint within Python files, rules with metavariables."""

from __future__ import annotations

import ast
from collections.abc import Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.scanned import batched, dealt, large

#: Taint rules: kind, name, pattern (fixed values).
SOURCES = [("request", r"request\.(args|form|json|query|body|params|GET|POST)|req\.(query|body|params)"), ("input", r"\binput\(|sys\.argv|process\.argv|os\.environ")]
SINKS = [("sql", r"\.execute\(|\.query\("), ("command", r"os\.system\(|subprocess\.\w+\(|child_process|\bexec\("), ("code", r"\beval\("), ("html", r"innerHTML\s*=|document\.write\(|render_template_string\(")]
SANITIZERS = [("escape", r"\bescape\(|sanitize\w*\(|encodeURIComponent\(|shlex\.quote\(|parameterize\(|DOMPurify")]


def marks(lines: DataFrame, table: list[tuple[str, str]]) -> DataFrame:
    """file, line and kind of lines that fit a pattern of the table."""
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in table]))
    return lines.select("file", "line", kinds.alias("kinds")).where(F.size("kinds") > 0).select("file", "line", F.explode("kinds").alias("kind"))


#: What a line gives a value: one name, or several in brackets.
ASSIGNED = r"^\s*(?:(?:export|const|let|var|final|auto|my)\s+)*([A-Za-z_$][\w$]*)\s*(?::\s*[\w.<>\[\], |]+?\s*)?(?:[-+*/%|&]|\|\||\?\?)?=(?![=>])"
TAKEN_APART = r"^\s*(?:const|let|var)?\s*[{\[(]([^}\])]*)[}\])]\s*=(?![=>])"


def flows(lines: DataFrame, sources=SOURCES, sinks=SINKS, sanitizers=SANITIZERS) -> DataFrame:
    """Sources and the sinks that they reach by variables: file, source_line, source, sink_line, sink, sanitized (a sanitizer stands on every way).
    A source reaches a sink on its own line, or on a later one that names a variable which got its value from it, by any number of assignments
    between. lines: file, line, text and maybe scope, the function around each; variables of two scopes are different ones. A variable keeps what
    it was given; branches and loops aren't looked at. A value only goes to later lines, so that one pass over a scope's lines in their order finds all:
    lines are dealt by scope once, and a task holds the variables that were reached in one scope and the sources they got their values from."""
    lines = lines if "scope" in lines.columns else lines.withColumn("scope", F.lit(""))
    lines = lines.select("file", F.coalesce("scope", F.lit("")).alias("scope"), F.col("line").cast("long").alias("line"), "text")
    clean = F.array_join(F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit("x")) for _, p in sanitizers])), "") != ""
    one, several = F.regexp_extract("text", ASSIGNED, 1), F.regexp_extract("text", TAKEN_APART, 1)
    given = F.filter(F.concat(F.array(one), F.transform(F.split(several, ","), lambda x: F.regexp_extract(x, r"([A-Za-z_$][\w$]*)\s*(?:=.*)?$", 1))), lambda x: x != "")
    kinds = lambda table: F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in table]))
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$]*)"), 1))
    # only lines that give a value or are a sink matter; what their texts say is found where they are dealt to, on all cores
    told = F.col("text").contains("=")
    for _, pattern in sinks:
        told = told | F.col("text").rlike(pattern)
    lines = dealt(lines.where(told), "file", "scope").sortWithinPartitions("file", "scope", "line")
    lines = lines.select("file", "scope", "line", clean.alias("clean"), given.alias("given"), kinds(sources).alias("sources"), kinds(sinks).alias("sinks"), names.alias("names"))
    found = lines.mapInArrow(batched(_flows, FLOW), FLOW)
    return large(found).groupBy("file", "source_line", "source", "sink_line", "sink").agg(F.min("sanitized").alias("sanitized"))


#: What ``_flows`` gives.
FLOW = "file string, source_line long, source string, sink_line long, sink string, sanitized boolean"


def _flows(batches) -> Iterable[tuple]:
    """Rows as FLOW has them. batches: lines in the order of file, scope and line."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for (file, _), scope in groupby(rows, lambda r: r[:2]):
        reached: dict[str, set[tuple]] = {}  # for each variable (source line, source, sanitized)
        for line, same in groupby(scope, lambda r: r[2]):
            new, found = [], {}  # lines of one number don't see each other
            for _, _, _, clean, given, sources, sinks, names in same:
                here = {(line, source, clean) for source in sources}
                if line is not None:
                    here.update((at, source, was or clean) for name in names for at, source, was in reached.get(name, ()))
                    new += [(variable, value) for variable in given for value in here]
                for at, source, sanitized in here:
                    for sink in sinks:
                        found[at, source, sink] = found.get((at, source, sink), True) and sanitized
            for variable, value in new:
                reached.setdefault(variable, set()).add(value)
            yield from ((file, at, source, line, sink, sanitized) for (at, source, sink), sanitized in found.items())


def across_imports(lines: DataFrame, imports: DataFrame, sources=SOURCES, sinks=SINKS, sanitizers=SANITIZERS) -> DataFrame:
    """Flows from a file's sources to the sinks of files that it imports (imports: source_id, target_id): source_file, source, source_line and
    sink_file, sink, sink_line, the first line of each kind, how many lines of each there are, and sanitized (either file has a sanitizer).
    Kinds are counted before files are joined, so that no source is paired with every sink."""
    first = lambda table, name: marks(lines, table).groupBy("file", F.col("kind").alias(name)).agg(F.min("line").alias(f"{name}_line"), F.count(F.lit(1)).alias(f"n_{name}s"))
    clean = marks(lines, sanitizers).select("file").distinct()
    s, k = first(sources, "source").withColumnRenamed("file", "source_file"), first(sinks, "sink").withColumnRenamed("file", "sink_file")
    edges = imports.where("source_id != target_id").select(F.col("source_id").alias("source_file"), F.col("target_id").alias("sink_file")).distinct()
    both = s.join(edges, "source_file").join(k, "sink_file")
    for side in ("source", "sink"):
        both = both.join(clean.select(F.col("file").alias(f"{side}_file"), F.lit(True).alias(f"_{side}")), f"{side}_file", "left")
    return both.select("source_file", "source", "source_line", "n_sources", "sink_file", "sink", "sink_line", "n_sinks", (F.coalesce("_source", F.lit(False)) | F.coalesce("_sink", F.lit(False))).alias("sanitized"))


def across_calls(tainted: DataFrame, calls: DataFrame, sinks: DataFrame, max_rounds: int = 20, decay: float = 0.9) -> DataFrame:
    """Taint that leaves a function by its calls: tainted functions (node_id), call edges (source_id, target_id), sinks in functions (node_id,
    file, line, sink). file, line, sink, the origin with the highest confidence and that confidence; one row for each place and sink."""
    from weftline.operators import findings, graph

    reached = graph.taint_fixpoint(calls, tainted, None, max_rounds, decay)
    found = reached.join(sinks, "node_id").select("file", "line", "sink", "origin", "hops", "confidence")
    return findings.deduplicated(found, ["file", "line", "sink"], ["hops", "origin"])


def python_taint(files: DataFrame) -> DataFrame:
    """Taint within and between the functions of each Python file: file, line, variable, source, sink; see ``taint`` for flows across files."""
    from weftline.operators import taint

    return taint.python_flows(files, SOURCES, SINKS, SANITIZERS).select("file", "line", "variable", "source", "sink").distinct()


def rule_matches(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Matches of syntax rules in Python files: file, line, rule_id, bindings. A rule has id and pattern, with $X for any expression and
    $...ARGS for any arguments; pattern_not takes matches out; either is a list of patterns; regex searches lines."""

    def run(batches):
        for batch in batches:
            rows = [{"file": path, "line": line, "rule_id": r["id"], "bindings": list(b.items())} for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rules for line, b in matches_of(content, r)]
            yield pa.RecordBatch.from_pylist(rows, MATCH)

    return files.select("path", "content").mapInArrow(run, "file string, line long, rule_id string, bindings map<string,string>")


MATCH = pa.schema([("file", pa.string()), ("line", pa.int64()), ("rule_id", pa.string()), ("bindings", pa.map_(pa.string(), pa.string()))])


def _pattern(text: str) -> ast.AST:
    body = ast.parse(text.replace("$...", "_MANY_").replace("$", "_ANY_")).body[0]
    return body.value if isinstance(body, ast.Expr) else body


def _fits(p, n, bound: dict) -> bool:
    if isinstance(p, ast.Name) and p.id.startswith("_ANY_"):
        text = ast.unparse(n) if isinstance(n, ast.AST) else str(n)
        return bound.setdefault("$" + p.id[5:], text) == text
    if isinstance(p, list):
        many = next((i for i, x in enumerate(p) if isinstance(x, ast.Name) and x.id.startswith("_MANY_")), None)
        if many is None:
            return len(p) == len(n) and all(_fits(x, y, bound) for x, y in zip(p, n, strict=True))
        tail = len(p) - many - 1
        if len(n) < many + tail or not all(_fits(x, y, bound) for x, y in zip(p[:many], n, strict=False)) or tail and not all(_fits(x, y, bound) for x, y in zip(p[-tail:], n[-tail:], strict=True)):
            return False
        bound["$..." + p[many].id[6:]] = ", ".join(ast.unparse(x) for x in n[many : len(n) - tail])
        return True
    if isinstance(p, ast.AST):
        return type(p) is type(n) and all(_fits(getattr(p, f, None), getattr(n, f, None), bound) for f in p._fields if f not in ("ctx", "type_comment", "kind") and not (f == "keywords" and not getattr(p, f)))
    return p == n


def matches_of(content: str | None, rule: dict) -> list[tuple[int, dict]]:
    import re

    if "regex" in rule:
        return [(i, {}) for i, line in enumerate((content or "").split("\n"), 1) if re.search(rule["regex"], line)]
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    wanted = [_pattern(p) for p in rule.get("either") or [rule["pattern"]]]
    unwanted = [_pattern(p) for p in rule.get("pattern_not", [])]
    out = []
    for n in ast.walk(tree):
        for p in wanted:
            bound: dict = {}
            if hasattr(n, "lineno") and _fits(p, n, bound) and not any(_fits(u, n, {}) for u in unwanted):
                out.append((n.lineno, bound))
                break
    return sorted(out, key=lambda x: x[0])
