"""Taint across functions and files by summaries.

Within a function a walk over its statements says, for what it returns, hands to a call or lets into a sink, where that comes from: a source, a
parameter, or the result of a call. These facts are a relation; closing it is joins alone, over what is new in each round, until nothing is:

* what a call gives back is what its function returns: its sources, and for its parameters what the caller handed in;
* what a function lets from a parameter into a sink, its callers let into that sink from what they hand in.

There is no bound on the length of a chain or on rounds; rows are (function, target, origin), of which there are finitely many. A call of an
unknown function gives back whatever it is handed. Values in containers and attributes are those of the variable that holds them.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import saved
from weftline.sources.scanned import scanned

FACT = "file string, fn string, what string, target string, origin string"
#: Keywords whose values a query takes apart from its text.
BOUND = ("params", "parameters", "args", "vars")
SEP = "\x1f"


def _kind(text: str, table: list[tuple[str, str]]) -> str | None:
    return next((k for k, p in table if re.search(p, text)), None)


class _Walk:
    """Facts of one file. State: variable -> origins; branches are merged by union, loops are walked until their state stays the same."""

    def __init__(self, path: str, tables: tuple):
        self.path, (self.sources, self.sinks, self.sanitizers) = path, tables
        self.rows: set[tuple] = set()
        self.fn, self.unit = f"{path}:0:<module>", {}

    def say(self, what: str, target: str, origins) -> None:
        self.rows |= {(self.path, self.fn, what, target, o) for o in origins}

    def call(self, n: ast.Call, state: dict) -> set:
        name = ast.unparse(n.func)
        if _kind(name + "(", self.sanitizers):
            for a in [*n.args, *[k.value for k in n.keywords]]:
                self.origins(a, state)
            return set()
        at = SEP.join((self.path, f"{n.lineno}:{n.col_offset}:{n.end_col_offset}"))
        slots = [(str(k), a.value if isinstance(a, ast.Starred) else a) for k, a in enumerate(n.args)] + [(f"={k.arg or '**'}", k.value) for k in n.keywords]
        given = {slot: self.origins(a, state) for slot, a in slots}
        if isinstance(n.func, ast.Attribute):
            given["self"] = self.origins(n.func.value, state)
        elif not isinstance(n.func, ast.Name):
            given["self"] = self.origins(n.func, state)
        self.say("call", at, [name])
        for slot, own in given.items():
            self.say("flow", SEP.join(("arg", at, slot)), own)
        if kind := _kind(name + "(", self.sinks):
            for slot, a in slots:
                if slot == "0" or slot[0] == "=" and slot[1:] not in BOUND:
                    name_of = next((x.id for x in ast.walk(a) if isinstance(x, ast.Name) and state.get(x.id)), "")
                    self.say("flow", SEP.join(("sink", self.path, str(n.lineno), kind, name_of)), given[slot])
        if kind := _kind(ast.unparse(n), self.sources) if not any(given.values()) else _kind(name + "(", self.sources):
            return {SEP.join(("source", self.path, str(n.lineno), kind))}
        return {SEP.join(("call", at))}

    def origins(self, n: ast.AST | None, state: dict) -> set:
        if n is None or isinstance(n, ast.Constant):
            return set()
        if isinstance(n, ast.Call):
            return self.call(n, state)
        if isinstance(n, ast.Name):
            return set(state.get(n.id, ()))
        if isinstance(n, (ast.Lambda, ast.GeneratorExp, ast.ListComp, ast.SetComp, ast.DictComp)):
            inner = dict(state)
            for g in getattr(n, "generators", []):
                self.bind(g.target, self.origins(g.iter, inner), inner)
            return set().union(*[self.origins(c, inner) for c in ast.iter_child_nodes(n) if not isinstance(c, (ast.comprehension, ast.arguments))])
        if isinstance(n, (ast.Attribute, ast.Subscript)) and (kind := _kind(ast.unparse(n), self.sources)):
            return {SEP.join(("source", self.path, str(n.lineno), kind))}
        if isinstance(n, ast.NamedExpr):
            own = self.origins(n.value, state)
            state[n.target.id] = own
            return own
        return set().union(*[self.origins(c, state) for c in ast.iter_child_nodes(n) if isinstance(c, (ast.expr, ast.keyword, ast.FormattedValue))])

    def bind(self, target: ast.AST, own: set, state: dict, more: bool = False) -> None:
        for n in ast.walk(target):
            if isinstance(n, ast.Name):
                # a part of a variable that is set keeps the rest
                partly = more or not isinstance(target, (ast.Name, ast.Tuple, ast.List, ast.Starred))
                state[n.id] = own | set(state.get(n.id, ())) if partly else set(own)

    def function(self, s, inside: str = "") -> None:
        outer, self.fn = self.fn, f"{self.path}:{s.lineno}:{s.name}"
        a = s.args
        names = [x.arg for x in [*a.posonlyargs, *a.args]]
        bound = names[1:] if inside and names and names[0] in ("self", "cls") else names
        self.say("def", f"{inside}.{s.name}" if inside else s.name, [""])
        slots = [(str(k), x) for k, x in enumerate(bound)] + [(f"={x}", x) for x in [*bound, *[k.arg for k in a.kwonlyargs]]] + ([("self", names[0])] if bound is not names else [])
        for slot, x in slots:
            self.say("param", slot, [x])
        state = {x: {SEP.join(("param", x))} for x in [*names, *[k.arg for k in a.kwonlyargs], *[v.arg for v in (a.vararg, a.kwarg) if v]]}
        self.block(s.body, state, inside)
        self.fn = outer

    def block(self, body: list, state: dict, inside: str = "") -> dict:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(s, inside if self.fn.endswith("<module>") else "")
            elif isinstance(s, ast.ClassDef):
                self.block(s.body, dict(state), s.name)
            elif isinstance(s, ast.If):
                self.origins(s.test, state)
                state = _union(self.block(s.body, dict(state), inside), self.block(s.orelse, dict(state), inside))
            elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
                while True:
                    own = self.origins(s.test if isinstance(s, ast.While) else s.iter, state)
                    inner = dict(state)
                    if not isinstance(s, ast.While):
                        self.bind(s.target, own, inner)
                    after = _union(state, self.block(s.body, inner, inside))
                    if after == state:
                        break
                    state = after
                state = self.block(s.orelse, state, inside)
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                for i in s.items:
                    own = self.origins(i.context_expr, state)
                    if i.optional_vars is not None:
                        self.bind(i.optional_vars, own, state)
                state = self.block(s.body, state, inside)
            elif isinstance(s, (ast.Try, ast.TryStar)):
                before = dict(state)
                state = self.block(s.body, state, inside)
                for h in s.handlers:
                    state = _union(state, self.block(h.body, _union(before, state), inside))
                state = self.block([*s.orelse, *s.finalbody], state, inside)
            elif isinstance(s, ast.Match):
                own, ends = self.origins(s.subject, state), [dict(state)]
                for c in s.cases:
                    inner = dict(state)
                    for n in ast.walk(c.pattern):
                        if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
                            inner[n.name] = own
                    ends.append(self.block(c.body, inner, inside))
                for e in ends:
                    state = _union(state, e)
            elif isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                own = self.origins(s.value, state)
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    if s.value is not None:
                        self.bind(t, own, state, isinstance(s, ast.AugAssign))
                    if kind := _kind(ast.unparse(t) + " = ", self.sinks):
                        self.say("flow", SEP.join(("sink", self.path, str(s.lineno), kind, "")), own)
            elif isinstance(s, ast.Return):
                self.say("flow", "return", self.origins(s.value, state))
            elif isinstance(s, ast.Expr) and isinstance(s.value, (ast.Yield, ast.YieldFrom)):
                self.say("flow", "return", self.origins(s.value.value, state))
            else:
                for n in ast.iter_child_nodes(s):
                    if isinstance(n, ast.expr):
                        self.origins(n, state)
                if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Attribute) and isinstance(s.value.func.value, ast.Name) and s.value.func.attr in ("append", "add", "extend", "update", "insert"):
                    held = s.value.func.value.id
                    state[held] = set(state.get(held, ())).union(*[self.origins(a, state) for a in s.value.args])
        return state


def _union(a: dict, b: dict) -> dict:
    return {k: set(a.get(k, ())) | set(b.get(k, ())) for k in a.keys() | b.keys()}


def facts_of(path: str, content: str | None, tables: tuple) -> list[tuple]:
    try:
        walk = _Walk(path, tables)
        walk.block(ast.parse(content or "").body, {})
    except (SyntaxError, ValueError, RecursionError):
        return []
    return sorted(walk.rows)


def facts(files: DataFrame, sources, sinks, sanitizers) -> DataFrame:
    """file, fn, what, target and origin from Python files (path, content). what: flow (target: return, arg or sink; origin: source, param or
    call), call (target: the call, origin: what is called), param (target: slot, origin: name), def (target: name)."""
    tables = (sources, sinks, sanitizers)
    return scanned(files, ["path", "content"], lambda path, content: facts_of(path, content, tables), FACT)


def callees(found: DataFrame, behind: DataFrame | None = None, modules: DataFrame | None = None) -> DataFrame:
    """call and fn: the function that a call runs. In its own file by name, or as ``self.name``; in others by what an import's definition is
    (behind: file, local, target, origin, as imports.definitions_behind gives it) or a module's alias stands for (modules: file, local, target)."""
    defined = found.where("what = 'def'").select(F.col("file").alias("at"), F.substring_index("target", ".", -1).alias("name"), F.col("target").contains(".").alias("member"), "fn")
    last = defined.groupBy("at", "name", "member").agg(F.max_by("fn", F.split("fn", ":")[F.lit(1)].cast("int")).alias("fn"))
    calls = found.where("what = 'call'").select("file", F.col("target").alias("call"), F.col("origin").alias("name"))
    own = calls.select("call", F.col("file").alias("at"), F.regexp_replace("name", r"^(?:self|cls)\.", "").alias("name"), F.col("name").rlike(r"^(?:self|cls)\.").alias("member"))
    ways = own.where("NOT name LIKE '%.%'")
    if behind is not None:
        ways = ways.unionByName(calls.join(behind.select("file", F.col("local").alias("name"), "target", "origin"), ["file", "name"]).select("call", F.col("target").alias("at"), F.col("origin").alias("name"), F.lit(False).alias("member")))
    if modules is not None:
        dotted = calls.where("name LIKE '%.%'").select("file", "call", F.substring_index("name", ".", -1).alias("name"), F.expr("substring_index(name, '.', size(split(name, '[.]')) - 1)").alias("local"))
        ways = ways.unionByName(dotted.join(modules.select("file", "local", "target"), ["file", "local"]).select("call", F.col("target").alias("at"), "name", F.lit(False).alias("member")))
    return ways.join(last, ["at", "name", "member"]).groupBy("call").agg(F.min("fn").alias("fn"))


def closed(found: DataFrame, callee: DataFrame) -> DataFrame:
    """All (fn, target, origin) that follow from the facts, call origins among them."""
    part = lambda c, n: F.split(F.col(c), SEP).getItem(n)
    call_of = lambda c: F.concat_ws(SEP, part(c, 1), part(c, 2))
    params = found.where("what = 'param'").select("fn", F.col("target").alias("slot"), F.concat_ws(SEP, F.lit("param"), "origin").alias("origin"))
    link = saved(callee.withColumnRenamed("fn", "g").join(params.withColumnRenamed("fn", "g"), "g").select("call", "slot", "g", "origin"))
    known = saved(callee.withColumnRenamed("fn", "g"))
    flows = saved(found.where("what = 'flow'").select("fn", "target", "origin").distinct())
    # what comes back from functions that aren't known
    free = found.where("what = 'call'").select(F.col("target").alias("call")).join(known.select("call"), "call", "left_anti")

    def kinds(t):
        results = t.where(F.col("origin").startswith("call" + SEP)).select("fn", "target", call_of("origin").alias("call"))
        args = t.where(F.col("target").startswith("arg" + SEP)).select(call_of("target").alias("call"), part("target", 3).alias("slot"), F.col("origin").alias("given"))
        ends = t.where(~F.col("origin").startswith("call" + SEP))
        returned = ends.where("target = 'return'").select(F.col("fn").alias("g"), "origin")
        back = known.join(returned.where(F.col("origin").startswith("source")), "g").select("call", "origin")
        through = link.join(returned, ["g", "origin"]).select("call", "slot")
        sunk = link.join(ends.where(F.col("target").startswith("sink")).select(F.col("fn").alias("g"), "target", "origin"), ["g", "origin"]).select("call", "slot", "target")
        return results, args, back.distinct(), through.distinct(), sunk.distinct()

    callers = found.where("what = 'call'").select(F.col("target").alias("call"), F.col("fn"))
    new, total = flows, flows
    first = True
    while True:
        r, a, b, th, s = kinds(total)
        dr, da, db, dth, ds = kinds(new)
        if first:  # later they are no news
            loose = a.join(free, "call", "left_semi").select("call", "slot").distinct()
            dth, first = dth.unionByName(loose), False
        loose = a.join(free, "call", "left_semi").select("call", "slot").distinct()
        th = th.unionByName(loose)
        out = [
            dr.join(b, "call").select("fn", "target", "origin"), r.join(db, "call").select("fn", "target", "origin"),
            *[x.join(y, "call").join(z, ["call", "slot"]).select("fn", "target", F.col("given").alias("origin")) for x, y, z in ((dr, th, a), (r, dth, a), (r, th, da))],
            *[x.join(y, ["call", "slot"]).join(callers, "call").select("fn", "target", F.col("given").alias("origin")) for x, y in ((da, s), (a, ds))],
        ]
        more = out[0]
        for x in out[1:]:
            more = more.unionByName(x)
        new = saved(more.distinct().join(total, ["fn", "target", "origin"], "left_anti"))
        if new.isEmpty():
            return total
        total = saved(total.unionByName(new))


def findings(total: DataFrame) -> DataFrame:
    """file, line, variable and sink of each place that a source reaches, and its source, source_file and source_line."""
    end, start = F.split("target", SEP), F.split("origin", SEP)
    found = total.where(F.col("target").startswith("sink" + SEP) & F.col("origin").startswith("source" + SEP))
    return found.select(end[1].alias("file"), end[2].cast("long").alias("line"), end[4].alias("variable"), start[3].alias("source"), end[3].alias("sink"), start[1].alias("source_file"), start[2].cast("long").alias("source_line")).distinct()


def python_flows(files: DataFrame, sources, sinks, sanitizers, behind: DataFrame | None = None, modules: DataFrame | None = None) -> DataFrame:
    """findings of Python files; across files where behind and modules say what imported names are."""
    found = saved(facts(files, sources, sinks, sanitizers))
    return findings(closed(found, callees(found, behind, modules)))


def python_flows_across(files: DataFrame, sources, sinks, sanitizers) -> DataFrame:
    """findings of Python files (path, content), with imports resolved among them."""
    from weftline.sources import imports

    found = saved(facts(files, sources, sinks, sanitizers))
    bound = saved(imports.resolved(imports.bindings(files), files.select("path")))
    defined = found.where("what = 'def' AND NOT target LIKE '%.%'").select("file", F.col("target").alias("name"))
    behind = imports.definitions_behind(bound, defined)
    # an import of a module by itself, or from its package
    modules = bound.where("what = 'import'").join(bound.select(F.col("file").alias("target")).distinct().unionByName(files.select(F.col("path").alias("target"))).distinct(), "target").where("name = '*' OR regexp_replace(target, '^.*/|[.]pyi?$', '') = name OR target RLIKE concat('/', name, '/__init__[.]py$')")
    modules = modules.select("file", F.when(F.col("name") == "*", F.col("local")).otherwise(F.col("local")).alias("local"), "target").distinct()
    return findings(closed(found, callees(found, behind, modules)))
