"""A small declarative graph-pattern language, compiled to DataFrame joins.

    MATCH (f:Function)-[:CALLS]->(c:Class) WHERE c.name CONTAINS 'x' AND NOT EXISTS { ()-[:CALLS]->(f) } RETURN f.name, c LIMIT 10

Semantics: an untyped edge means CALLS; CONTAINS ignores case and keeps ``%`` and ``_`` as wildcards; AND and OR bind alike, from left to
right, without parentheses; a variable that is named twice in one MATCH is not unified, the first one answers to the name; ``--``
starts a comment; negative numbers can't be written. Results have a column ``var.prop`` for each returned property and a struct for a
returned variable. LIMIT without an order takes any rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels and edge types that a query may name (fixed values).
LABELS = ("function", "class", "file", "module", "route", "type", "interface")
EDGE_TYPES = ("CALLS", "IMPORTS", "DEFINES", "INHERITS", "IMPLEMENTS", "USES_TYPE")
KEYWORDS = ("MATCH", "WHERE", "RETURN", "LIMIT", "AND", "OR", "NOT", "EXISTS", "IS", "NULL", "CONTAINS", "TRUE", "FALSE")
#: Properties by the names a query may use.
PROPERTIES = {"name": "name", "file": "file", "line": "line", "node_type": "node_type", "node_id": "node_id", "id": "node_id"}
COLUMNS = ("node_id", "node_type", "name", "file", "line")


class PatternError(ValueError):
    """code: parse_error or compile_error."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Node:
    var: str | None
    label: str | None


@dataclass
class Edge:
    kind: str
    direction: str  # right, left, both


@dataclass
class Path:
    nodes: list[Node]
    edges: list[Edge]


@dataclass
class Compare:
    var: str
    prop: str
    op: str
    value: object


@dataclass
class Exists:
    path: Path
    where: list = field(default_factory=list)
    negated: bool = False


@dataclass
class Query:
    path: Path
    where: list  # [(None | 'AND' | 'OR', predicate)]
    items: list[tuple[str, str | None]] | None  # None: everything
    limit: int | None


_LEX = re.compile(r"(?P<skip>\s+|--[^\n]*)|(?P<string>'[^']*'|\"[^\"]*\")|(?P<number>\d+(?:\.\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<sign><=|>=|!=|<>|[()\[\]{}:,.*=<>-])")


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise PatternError("parse_error", f"unexpected character {text[at]!r} at {at}")
        at = m.end()
        kind = m.lastgroup
        if kind == "word" and m[0].upper() in KEYWORDS:
            out.append(("key", m[0].upper()))
        elif kind != "skip":
            out.append((kind, m[0]))
    return out + [("end", "")]


class _Reader:
    def __init__(self, text: str):
        self.list, self.at = tokens(text), 0

    def peek(self, *values: str) -> bool:
        return self.list[self.at][1] in values and self.list[self.at][0] != "string"

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, v = self.list[self.at]
        if value is not None and (v != value or k == "string") or kind is not None and k != kind:
            raise PatternError("parse_error", f"expected {value or kind}, found {v or 'the end'!r}")
        self.at += 1
        return v

    def query(self) -> Query:
        self.take("MATCH")
        path, where, items, limit = self.path(), [], None, None
        if self.peek("WHERE"):
            self.take()
            where = self.predicates()
        if self.peek("RETURN"):
            self.take()
            items = self.items()
        if self.peek("LIMIT"):
            self.take()
            limit = int(float(self.take(kind="number")))
        self.take(kind="end")
        return Query(path, where, items, limit)

    def items(self):
        if self.peek("*"):
            self.take()
            return None
        out = []
        while True:
            var = self.take(kind="word")
            prop = None
            if self.peek("."):
                self.take()
                prop = self.take(kind="word")
            out.append((var, prop))
            if not self.peek(","):
                return out
            self.take()

    def path(self) -> Path:
        nodes, edges = [self.node()], []
        while self.peek("-", "<"):
            edges.append(self.edge())
            nodes.append(self.node())
        return Path(nodes, edges)

    def node(self) -> Node:
        self.take("(")
        var = self.take() if self.list[self.at][0] == "word" else None
        label = None
        if self.peek(":"):
            self.take()
            label = self.take(kind="word").lower()
            if label not in LABELS:
                raise PatternError("parse_error", f"unknown label {label!r}")
        self.take(")")
        return Node(var, label)

    def edge(self) -> Edge:
        left = self.peek("<")
        if left:
            self.take()
        self.take("-")
        kind = "CALLS"
        bracket = self.peek("[")
        if bracket:
            self.take()
        if self.peek(":"):
            self.take()
            kind = self.take(kind="word").upper()
            if kind not in EDGE_TYPES:
                raise PatternError("parse_error", f"unknown edge type {kind!r}")
        if bracket:
            self.take("]")
        self.take("-")
        right = self.peek(">")
        if right:
            self.take()
        if left and right:
            raise PatternError("parse_error", "an edge can't point both ways")
        return Edge(kind, "left" if left else "right" if right else "both")

    def predicates(self) -> list:
        out = [(None, self.predicate())]
        while self.peek("AND", "OR"):
            out.append((self.take(), self.predicate()))
        return out

    def predicate(self):
        negated = self.peek("NOT")
        if negated:
            self.take()
        if negated or self.peek("EXISTS"):
            self.take("EXISTS")
            self.take("{")
            if self.peek("MATCH"):
                self.take()
            path, where = self.path(), []
            if self.peek("WHERE"):
                self.take()
                where = self.predicates()
            self.take("}")
            return Exists(path, where, negated)
        var = self.take(kind="word")
        self.take(".")
        prop = self.take(kind="word")
        if self.peek("IS"):
            self.take()
            no = self.peek("NOT")
            if no:
                self.take()
            self.take("NULL")
            return Compare(var, prop, "not null" if no else "null", None)
        if self.peek("CONTAINS"):
            self.take()
            return Compare(var, prop, "contains", self.take(kind="string")[1:-1])
        op = self.take(kind="sign")
        if op not in ("=", "!=", "<>", "<", ">", "<=", ">="):
            raise PatternError("parse_error", f"expected a comparison, found {op!r}")
        return Compare(var, prop, "!=" if op == "<>" else op, self.value())

    def value(self):
        kind, text = self.list[self.at]
        if kind == "string":
            self.take()
            return text[1:-1]
        if kind == "number":
            self.take()
            return float(text) if "." in text else int(text)
        if self.peek("TRUE", "FALSE"):
            return int(self.take() == "TRUE")
        raise PatternError("parse_error", f"expected a value, found {text or 'the end'!r}")


def parse(text: str) -> Query:
    return _Reader(text).query()


def validate(text: str) -> dict:
    """{valid, error} without running anything."""
    try:
        parse(text)
    except PatternError as e:
        return {"valid": False, "error": str(e)}
    return {"valid": True, "error": None}


def _hops(nodes: DataFrame, edges: DataFrame, path: Path, prefix: str) -> DataFrame:
    """Rows of a path: columns {prefix}{i}_{column} of each node. Two equi-joins a hop, none with OR."""

    def node(i: int) -> DataFrame:
        n = nodes if path.nodes[i].label is None else nodes.where(F.col("node_type") == path.nodes[i].label)
        return n.select(*[F.col(c).alias(f"{prefix}{i}_{c}") for c in COLUMNS])

    out = node(0)
    for i, e in enumerate(path.edges):
        hop = _hop(edges, e)
        out = out.join(hop, F.col(f"{prefix}{i}_node_id") == F.col("_from")).drop("_from")
        out = out.join(node(i + 1), F.col("_to") == F.col(f"{prefix}{i + 1}_node_id")).drop("_to")
    return out


def _hop(edges: DataFrame, e: Edge) -> DataFrame:
    """_from and _to of edges of a kind, as a path goes along them."""
    hop = edges.where((F.col("edge_type") == e.kind) & F.col("target_id").isNotNull()).select("source_id", "target_id")
    turned = hop.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    if e.direction == "left":
        hop = turned
    elif e.direction == "both":
        hop = hop.unionAll(turned.where("source_id != target_id"))  # a self loop is one edge
    return hop.select(F.col("source_id").alias("_from"), F.col("target_id").alias("_to"))


def _ends(nodes: DataFrame, edges: DataFrame, p: Exists, prefix: str, var: str) -> DataFrame | None:
    """Ids ({prefix}{i}_node_id) that ``var`` may have in a path that starts or ends with it: semi joins from the far end on, each over ids alone,
    so that Spark can drop edges before it makes them distinct or sorts them. None where conditions aren't joined by AND, or the path is of
    another form."""
    path, names = p.path, [n.var for n in p.path.nodes if n.var]
    at = _first(path)[var]
    if not path.edges or at not in (0, len(path.edges)) or len(set(names)) < len(names) or any(op == "OR" or not isinstance(c, Compare) or c.var not in names for op, c in p.where):
        return None

    def node(i: int) -> DataFrame:
        n = nodes if path.nodes[i].label is None else nodes.where(F.col("node_type") == path.nodes[i].label)
        for _, c in p.where:
            if c.var == path.nodes[i].var:
                column = PROPERTIES.get(c.prop)
                n = n.where(_compare(c, F.col(column) if column else None))
        return n.select(F.col("node_id").alias("_id"))

    order = range(len(path.edges)) if at else range(len(path.edges) - 1, -1, -1)
    far = node(0 if at else len(path.edges))
    for i in order:
        hop, (near, beyond) = _hop(edges, path.edges[i]), ("_to", "_from") if at else ("_from", "_to")
        near_ids = hop.join(far, hop[beyond] == far["_id"], "left_semi").select(F.col(near).alias("_near"))
        own = i + 1 if at else i
        # the node itself is one that rows are joined with, unless more is asked of it
        bare = own == at and path.nodes[own].label is None and not any(c.var == var for _, c in p.where)
        if bare:
            return near_ids.select(F.col("_near").alias(f"{prefix}{at}_node_id"))
        own_ids = node(own)
        far = own_ids.join(near_ids, own_ids["_id"] == near_ids["_near"], "left_semi")
    return far.select(F.col("_id").alias(f"{prefix}{at}_node_id"))


def _first(path: Path) -> dict[str, int]:
    places: dict[str, int] = {}
    for i, n in enumerate(path.nodes):
        if n.var:
            places.setdefault(n.var, i)
    return places


def _compare(p: Compare, column: Column | None) -> Column:
    if column is None:
        return F.lit(p.op == "null") if p.op in ("null", "not null") else F.lit(None).cast("boolean")
    if p.op == "null":
        return column.isNull()
    if p.op == "not null":
        return column.isNotNull()
    if p.op == "contains":
        return column.cast("string").ilike(f"%{p.value}%")
    value = p.value
    if p.prop == "line":
        if isinstance(value, str):
            if not re.fullmatch(r"\s*[+-]?\d+(\.\d+)?\s*", value):  # numbers sort before texts
                return F.when(column.isNotNull(), F.lit(p.op in ("!=", "<", "<=")))
            value = float(value)
    else:
        value = str(value)
    ops = {"=": column == value, "!=": column != value, "<": column < value, ">": column > value, "<=": column <= value, ">=": column >= value}
    return ops[p.op]


def compile_query(query: Query, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows, places = _hops(nodes, edges, query.path, "n"), _first(query.path)
    rows = _filtered(rows, query.where, places, "n", nodes, edges, 0)
    columns = []
    for var, prop in query.items if query.items is not None else [(v, None) for v in places]:
        i = places.get(var)
        if prop is None:
            columns.append((F.struct(*[F.col(f"n{i}_{c}").alias(c) for c in COLUMNS]) if i is not None else F.lit(None).cast("string")).alias(var))
        else:
            c = PROPERTIES.get(prop)
            columns.append((F.col(f"n{i}_{c}") if i is not None and c else F.lit(None).cast("string")).alias(f"{var}.{prop}"))
    out = rows.select(*columns)
    return out if query.limit is None else out.limit(query.limit)


def _filtered(rows: DataFrame, where: list, places: dict[str, int], prefix: str, nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Rows that satisfy a left-associative chain. All AND: EXISTS is a semi or anti join; with OR it is a flag from an outer join."""

    def column(p: Compare) -> Column | None:
        if p.var not in places:
            raise PatternError("compile_error", f"unknown variable {p.var!r}")
        c = PROPERTIES.get(p.prop)
        return F.col(f"{prefix}{places[p.var]}_{c}") if c else None

    only_and = all(op != "OR" for op, _ in where)
    total, flags = None, []
    for k, (op, p) in enumerate(where):
        if isinstance(p, Compare):
            term = _compare(p, column(p))
        else:
            own, inner_places = f"x{depth}_{k}_", _first(p.path)
            common = [v for v in inner_places if v in places]
            inner = _ends(nodes, edges, p, own, common[0]) if len(common) == 1 else None
            if inner is None:
                inner = _filtered(_hops(nodes, edges, p.path, own), p.where, inner_places, own, nodes, edges, depth + 1)
            keys = [F.col(f"{own}{inner_places[v]}_node_id").alias(f"{own}key{j}") for j, v in enumerate(common)]
            if not common:
                there = inner.limit(1).agg((F.count(F.lit(1)) > 0).alias(f"{own}there"))  # one row, so that compiling runs no job
                rows = rows.join(F.broadcast(there))
                flags.append(f"{own}there")
                term = ~F.col(f"{own}there") if p.negated else F.col(f"{own}there")
            else:
                found = inner.select(*keys).distinct()
                on = [F.col(f"{prefix}{places[v]}_node_id") == F.col(f"{own}key{j}") for j, v in enumerate(common)]
                if only_and:
                    rows = rows.join(found, on, "left_anti" if p.negated else "left_semi")
                    continue
                rows = rows.join(found.withColumn(f"{own}flag", F.lit(True)), on, "left")
                flags += [f"{own}flag", *[f"{own}key{j}" for j in range(len(common))]]
                term = F.col(f"{own}flag").isNull() if p.negated else F.col(f"{own}flag").isNotNull()
        total = term if total is None else (total | term if op == "OR" else total & term)
    return (rows if total is None else rows.where(total)).drop(*flags)


def run(text: str, nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Parse, compile and return the rows; ``limit`` takes the place of the query's own."""
    query = parse(text)
    if limit is not None:
        query.limit = limit
    return compile_query(query, nodes, edges)


#: Rows that an envelope holds at most where neither the query nor the caller sets a limit: they are collected to the driver.
MOST_ROWS = 100_000


def execute(text: str, nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> dict:
    """Rows in an envelope: status, rows, count, truncated; or status error with the error's code. ``run`` gives the rows without a bound."""
    try:
        query = parse(text)
        query.limit = next(n for n in (limit, query.limit, MOST_ROWS) if n is not None)
        rows = [r.asDict(recursive=True) for r in compile_query(query, nodes, edges).collect()]
    except PatternError as e:
        return {"status": "error", "error": e.code, "message": str(e)}
    return {"status": "ok", "rows": rows, "count": len(rows), "truncated": len(rows) >= query.limit}
