"""Control flow of Python functions: blocks, edges, reaching definitions, and what follows from them about dead code.

A file is parsed in one task, and each of its functions becomes basic blocks and edges; a worklist over bit sets (a bit for each definition, and
one for each variable that isn't set yet) says which definitions reach which uses. What comes out is one relation, from which joins and
grouping find unreachable code, dead stores, unused variables and uses before anything is set. A definition that reaches no use is one after which
its variable isn't live.

Exceptions may leave a ``try`` after any of its definitions; ``finally`` is entered by every way out and left by all of them. A variable that an inner
function reads, that is ``global`` or ``nonlocal``, or that ``locals()``, ``eval`` or ``exec`` may see, escapes and is never reported. Conditions are
looked at only where they are constants.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.scanned import scanned

#: what: block (id, line, end_line, name: why it is not reached, flag: is it reached), edge (id to other, name: kind), def (id, name, how, other: its
#: block, flag: is it read), use (id, name, other: its block, how: never or maybe where it may not be set, flag: not just for ``+=``).
FACT = "file string, fn string, what string, id int, line int, end_line int, name string, how string, other int, flag boolean"
#: Ways of setting a variable that say something if nobody reads it; targets of loops and of unpacking often have to be there.
TOLD = ("assign", "augment", "with", "except", "import", "walrus")
#: Managers that may swallow an exception (parts of their names; fixed values).
SWALLOW = ("suppress", "raises", "assertRaises", "assertWarns", "ignored")
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)


class _Flow:
    """Blocks of one function. ``at`` is the open block, or None after a way out."""

    def __init__(self, body: list, params: list[str], module: bool):
        self.lines, self.events, self.why, self.live, self.edges, self.frames = [], [], [], [], {}, []
        self.escaped: set[str] = set()
        self.all_escape = module
        self.entry = self.at = self.block()
        self.live[self.entry] = True
        for p in params:
            self.events[self.entry].append(("def", p, 0, "param"))
        self.exit = self.block()
        self.ended = "return"
        self.body(body)
        if self.at is not None:
            self.edge(self.at, self.exit, "next")

    def block(self) -> int:
        self.lines.append([None, None])
        self.events.append([])
        self.why.append("")
        self.live.append(False)
        return len(self.lines) - 1

    def edge(self, a: int | None, b: int, kind: str) -> None:
        if a is not None:
            self.edges.setdefault((a, b), kind)
            self.live[b] |= self.live[a]

    def mark(self, first: int, last: int) -> None:
        own = self.lines[self.at]
        own[0], own[1] = own[0] or first, max(own[1] or 0, last)

    # --- expressions ---

    def use(self, n: ast.AST | None) -> None:
        """Uses of an expression in the order of evaluation, as far as it matters; definitions by ``:=`` may not happen."""
        if n is None:
            return
        if isinstance(n, ast.Name):
            if isinstance(n.ctx, (ast.Load, ast.Del)):
                self.events[self.at].append(("use", n.id, n.lineno, ""))
                self.all_escape |= n.id in ("locals", "eval", "exec", "vars")
        elif isinstance(n, ast.Lambda):
            self.escape(n)
        elif isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            own = {x.id for g in n.generators for x in ast.walk(g.target) if isinstance(x, ast.Name)}
            for x in ast.walk(n):
                if isinstance(x, ast.NamedExpr):
                    self.events[self.at].append(("def", x.target.id, x.lineno, "walrus"))
                if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load) and x.id not in own:
                    self.events[self.at].append(("use", x.id, x.lineno, ""))
        else:
            for c in ast.iter_child_nodes(n):
                self.use(c)
            if isinstance(n, ast.NamedExpr):
                self.events[self.at].append(("def", n.target.id, n.lineno, "walrus"))

    def escape(self, n: ast.AST) -> None:
        self.escaped |= {x.id for x in ast.walk(n) if isinstance(x, ast.Name)} | {v for x in ast.walk(n) if isinstance(x, (ast.Nonlocal, ast.Global)) for v in x.names}

    def bind(self, target: ast.AST, how: str) -> None:
        if isinstance(target, ast.Name):
            self.events[self.at].append(("def", target.id, target.lineno, how))
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.bind(t, "unpack" if how == "assign" else how)
        elif isinstance(target, ast.Starred):
            self.bind(target.value, how)
        else:
            self.use(target)

    # --- ways out ---

    def leave(self, kind: str) -> None:
        """Jump from the open block to where ``kind`` leads; a ``finally`` on the way goes first, and goes on from there."""
        for depth in range(len(self.frames) - 1, -1, -1):
            what, *f = self.frames[depth]
            if what == "finally":
                self.edge(self.at, f[0], kind)
                if self.live[self.at]:
                    f[1].add(kind)
                break
            if what == "loop" and kind in ("break", "continue"):
                self.edge(self.at, f[0] if kind == "continue" else f[1], kind)
                break
        else:
            self.edge(self.at, self.exit, kind)
        self.at, self.ended = None, kind

    # --- statements ---

    def body(self, body: list) -> None:
        for s in body:
            if self.at is None:
                self.at = self.block()
                self.why[self.at] = self.ended
                self.lines[self.at] = [s.lineno, body[-1].end_lineno]
            self.statement(s)

    def branch(self, start: int, body: list, kind: str, taken: bool = True) -> int | None:
        """Open block after a body that begins at an edge from start."""
        self.at = self.block()
        if taken:
            self.edge(start, self.at, kind)
        elif body:
            self.why[self.at], self.lines[self.at] = "condition", [body[0].lineno, body[-1].end_lineno]
        self.body(body)
        return self.at

    def join(self, ends: list, ended: str) -> None:
        ends = [e for e in ends if e is not None]
        if not any(self.live[e] for e in ends):  # dead ends lead nowhere
            self.at, self.ended = None, ended
            return
        self.at = self.block()
        for e in ends:
            self.edge(e, self.at, "next")

    def statement(self, s: ast.stmt) -> None:
        compound = isinstance(s, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.Match))
        self.mark(s.lineno, s.lineno if compound else s.end_lineno)
        if isinstance(s, ast.If):
            self.use(s.test)
            start, known = self.at, s.test.value if isinstance(s.test, ast.Constant) else None
            one = self.branch(start, s.body, "true", known is None or bool(known))
            other = self.branch(start, s.orelse, "false", known is None or not known)
            self.join([one, other if s.orelse or known is None or not known else None], "branch")
        elif isinstance(s, ast.While):
            self.loop(s, lambda: self.use(s.test), not (isinstance(s.test, ast.Constant) and s.test.value))
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            self.use(s.iter)
            self.loop(s, lambda: None, True)
        elif isinstance(s, (ast.Try, ast.TryStar)):
            self.trial(s)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for i in s.items:
                self.use(i.context_expr)
                if i.optional_vars is not None:
                    self.bind(i.optional_vars, "with")
            start = self.at
            inside = self.branch(start, s.body, "next")
            held = [start, *range(start + 1, len(self.lines))] if any(w in ast.unparse(i.context_expr) for i in s.items for w in SWALLOW) else []
            self.join([inside, *held[:1]], self.ended)
            for b in held:
                if b != self.at:
                    self.edge(b, self.at, "except")
        elif isinstance(s, ast.Match):
            self.use(s.subject)
            start, ends, open_ = self.at, [], True
            for c in s.cases:
                self.at = arm = self.block()
                self.edge(start, arm, "case")
                for n in ast.walk(c.pattern):
                    if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
                        self.events[arm].append(("def", n.name, c.pattern.lineno, "match"))
                    elif isinstance(n, (ast.MatchValue, ast.MatchClass)):
                        self.use(n.value if isinstance(n, ast.MatchValue) else n.cls)
                self.use(c.guard)
                self.body(c.body)
                ends.append(self.at)
                open_ &= not (isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.guard is None)
            self.join([*ends, start if open_ else None], "branch")
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for n in [*s.decorator_list, *([*s.args.defaults, *s.args.kw_defaults] if not isinstance(s, ast.ClassDef) else s.bases)]:
                self.use(n)
            self.escape(s)
            self.events[self.at].append(("def", s.name, s.lineno, "class" if isinstance(s, ast.ClassDef) else "function"))
        elif isinstance(s, (ast.Global, ast.Nonlocal)):
            self.escaped |= set(s.names)
        elif isinstance(s, (ast.Import, ast.ImportFrom)):
            for a in s.names:
                if a.name != "*":
                    self.events[self.at].append(("def", a.asname or a.name.split(".")[0], s.lineno, "import"))
        elif isinstance(s, (ast.Assign, ast.AnnAssign)):
            self.use(s.value)
            for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if s.value is not None else []:
                self.bind(t, "assign")
        elif isinstance(s, ast.AugAssign):
            if isinstance(s.target, ast.Name):
                self.events[self.at].append(("use", s.target.id, s.lineno, "augment"))
            self.use(s.value)
            self.bind(s.target, "augment")
        elif isinstance(s, (ast.Return, ast.Raise)):
            for n in ast.iter_child_nodes(s):
                self.use(n)
            if isinstance(s, ast.Return):
                self.leave("return")
            else:  # handlers have their edges from every block of the try
                self.edge(self.at, self.exit, "raise") if not any(f[0] in ("try", "finally") for f in self.frames) else None
                self.at, self.ended = None, "raise"
        elif isinstance(s, (ast.Break, ast.Continue)):
            self.leave("break" if isinstance(s, ast.Break) else "continue")
        else:
            self.use(s)

    def loop(self, s, test, ends: bool) -> None:
        head, after = self.block(), self.block()
        self.edge(self.at, head, "next")
        self.at = head
        test()
        self.frames.append(("loop", head, after))
        self.at = self.block()
        self.edge(head, self.at, "true")
        if not isinstance(s, ast.While):
            self.bind(s.target, "loop")
        self.body(s.body)
        self.edge(self.at, head, "loop")
        self.frames.pop()
        if ends:
            self.edge(self.branch(head, s.orelse, "false"), after, "next")
        self.at, self.ended = (after, "") if self.live[after] else (None, "loop")

    def trial(self, s) -> None:
        last = (self.block(), set()) if s.finalbody else None
        if last:
            self.frames.append(("finally", *last))
        first = self.block()
        self.edge(self.at, first, "next")
        self.at = first
        handlers = [self.block() for _ in s.handlers]
        self.frames.append(("try",))
        self.body(s.body)
        self.frames.pop()
        tried = [first, *range(first + 1 + len(handlers), len(self.lines))]
        if s.orelse:
            self.body(s.orelse)
        ends, ended = [self.at], self.ended
        for h, start in zip(s.handlers, handlers, strict=True):
            for b in tried:
                self.edge(b, start, "except")
            self.at = start
            self.mark(h.lineno, h.lineno)
            self.use(h.type)
            if h.name:
                self.events[start].append(("def", h.name, h.lineno, "except"))
            self.body(h.body)
            ends.append(self.at)
        if not last:
            self.join(ends, ended if len(ends) == 1 else "branch")
            return
        self.frames.pop()
        start, kinds = last
        for b in range(start + 1, len(self.lines)):
            self.edge(b, start, "except")
        for e in [e for e in ends if e is not None]:
            self.edge(e, start, "next")
            self.edges[e, start] = "next"
        # the end of what is dead already doesn't go on behind it
        normal = any(e is not None and self.live[e] for e in ends)
        self.at = start
        self.body(s.finalbody)
        end = self.at
        if end is None or not self.live[end]:
            self.at = None
            return
        for kind in sorted(kinds):
            self.at = end
            self.leave(kind)
        if normal:
            self.join([end], "")
        else:
            self.at, self.ended = None, ended

    # --- what reaches what ---

    def solved(self):
        """Sets that reach each block's begin (None: nothing does), the definitions, which of them are read, and for uses whether they are set."""
        defs, names = [], {}
        for b, events in enumerate(self.events):
            for k, (what, name, line, how) in enumerate(events):
                names.setdefault(name, len(names)) if what == "def" else None
                if what == "def":
                    defs.append((b, k, name, line, how))
        number = {(b, k): d for d, (b, k, *_) in enumerate(defs)}
        unset = {name: 1 << (len(defs) + v) for name, v in names.items()}
        mask = dict(unset)
        for d, (_, _, name, *_) in enumerate(defs):
            mask[name] |= 1 << d

        def through(b: int, state: int, seen=None) -> tuple[int, int]:
            """State after a block, and all that held at any time within it."""
            ever = state
            for k, (what, name, _, how) in enumerate(self.events[b]):
                if what == "def":
                    state = (state if how == "walrus" else state & ~mask[name]) | 1 << number[b, k]
                    ever |= state
                elif seen is not None and name in mask:
                    seen(b, k, state & mask[name])
            return state, ever

        after: dict[int, list] = {}
        for (a, b), kind in self.edges.items():
            after.setdefault(a, []).append((b, kind))
        came: list = [None] * len(self.lines)
        came[self.entry] = sum(unset.values())
        work = [self.entry]
        while work:
            b = work.pop()
            out, ever = through(b, came[b])
            for n, kind in after.get(b, ()):
                new = (ever if kind == "except" else out) | (came[n] or 0)
                if new != came[n]:
                    came[n] = new
                    work.append(n)
        read, uses, added = 0, [], []

        def seen(b, k, state):
            nonlocal read
            _, name, line, how = self.events[b][k]
            uses.append((b, name, line, state, how))
            if how == "augment":  # x += 1 reads x for whoever reads what it sets
                added.append((next(number[b, n] for n in range(k + 1, len(self.events[b])) if self.events[b][n][:2] == ("def", name)), state))
            else:
                read |= state

        for b, state in enumerate(came):
            if state is not None:
                through(b, state, seen)
        before = None
        while before != read:
            before = read
            for d, state in added:
                read |= state if read >> d & 1 else 0
        return came, defs, read, [(b, name, line, bool(state & ~unset[name]), bool(state & unset[name]), how) for b, name, line, state, how in uses]

    def rows(self, path: str, fn: str):
        came, defs, read, uses = self.solved()
        for b, (first, last) in enumerate(self.lines):
            yield path, fn, "block", b, first, last, self.why[b] if came[b] is None else "", None, None, came[b] is not None
        for (a, b), kind in self.edges.items():
            yield path, fn, "edge", a, None, None, kind, None, b, None
        for d, (b, _, name, line, how) in enumerate(defs):
            if came[b] is not None:
                out = self.all_escape or name in self.escaped
                yield path, fn, "def", d, line, None, name, how, b, out or bool(read >> d & 1)
        for u, (b, name, line, some, none, how) in enumerate(uses):
            if not (self.all_escape or name in self.escaped) and (none or how != "augment"):
                yield path, fn, "use", u, line, None, name, ("maybe" if some else "never") if none else "", b, how != "augment"


def facts_of(path: str, content: str | None) -> list[tuple]:
    """Rows as FACT has them; text that isn't Python, and null, give none."""
    out: list[tuple] = []
    try:
        tree = ast.parse(content or "")
        todo: list[tuple] = [(f"{path}:0:<module>", tree.body, [], True)]
        for n in ast.walk(tree):
            if isinstance(n, _FUNCTIONS[:2]):
                a = n.args
                names = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *[v for v in (a.vararg, a.kwarg) if v]]]
                todo.append((f"{path}:{n.lineno}:{n.name}", n.body, names, False))
            elif isinstance(n, ast.ClassDef):
                todo.append((f"{path}:{n.lineno}:{n.name}", n.body, [], True))
        for fn, body, names, module in todo:
            out += _Flow(body, names, module).rows(path, fn)
    except (SyntaxError, ValueError, RecursionError):
        return []
    return out


def facts(files: DataFrame) -> DataFrame:
    """Blocks, edges, definitions and uses (FACT) of the functions, classes and modules of Python files (path, content)."""
    return scanned(files, ["path", "content"], facts_of, FACT)


def unreachable(found: DataFrame) -> DataFrame:
    """file, fn, line, end_line and reason (return, raise, break, continue, branch: every branch leaves, loop: it never ends, condition: it is
    constant) of each stretch that no path reaches. What stands within such a stretch isn't listed again."""
    dead = found.where("what = 'block' AND NOT flag AND name != '' AND line IS NOT NULL").select("file", "fn", "line", "end_line", F.col("name").alias("reason"))
    before = F.max("end_line").over(_by("fn").rowsBetween(-(1 << 31), -1))
    return dead.withColumn("_before", before).where("_before IS NULL OR line > _before").drop("_before")


def _by(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy("file", *keys).orderBy("line", F.desc("end_line"))


def dead_stores(found: DataFrame) -> DataFrame:
    """file, fn, line, name and how of definitions that reach no use, of variables that are read elsewhere."""
    used = found.where("what = 'use' AND flag").select("file", "fn", "name").distinct()
    return _unread(found).join(used, ["file", "fn", "name"], "left_semi").select("file", "fn", "line", "name", "how")


def unused_variables(found: DataFrame) -> DataFrame:
    """file, fn, line (of the first definition), name and how of variables that nothing reads; only ``x += 1`` isn't reading."""
    all_ = found.where("what = 'def'").groupBy("file", "fn", "name").agg(F.count_if("flag").alias("read"), F.count_if(~F.col("how").isin(*TOLD)).alias("other"))
    used = found.where("what = 'use' AND flag").select("file", "fn", "name").distinct()
    first = _unread(found).groupBy("file", "fn", "name").agg(F.min(F.struct("line", "how")).alias("d"))
    quiet = all_.where("read = 0 AND other = 0").join(used, ["file", "fn", "name"], "left_anti")
    return first.join(quiet, ["file", "fn", "name"], "left_semi").select("file", "fn", F.col("d.line").alias("line"), "name", F.col("d.how").alias("how"))


def _unread(found: DataFrame) -> DataFrame:
    return found.where((F.col("what") == "def") & ~F.col("flag") & F.col("how").isin(*TOLD) & ~F.col("name").startswith("_"))


def unset_uses(found: DataFrame) -> DataFrame:
    """file, fn, line, name and state (never, maybe) of uses that a path without a definition reaches, of variables that the function sets."""
    return found.where("what = 'use' AND how != ''").select("file", "fn", "line", "name", F.col("how").alias("state")).distinct()
