"""Control flow, reaching definitions and dead code, against what running or tracing programs shows."""

import itertools
import sys

from weftline.operators import control, deadcode
from weftline.sources import lexer

CASES = {
    "ends.py": ("""def f(a):
    x = 1
    x = 2
    if a:
        return x
    else:
        raise E
    print(a)
    while a:
        pass
def g():
    try:
        return h()
    finally:
        z = 1
        print(z)
    k = 1
def n():
    with suppress(E):
        raise E
    after()
    with open() as q:
        return q
    gone()
def r(a):
    for x in a:
        try:
            if x:
                continue
            break
        finally:
            done()
    end()
    try:
        raise E
    except E:
        pass
    fine()
    try:
        return 1
    finally:
        return 2
    never()
def s():
    while True:
        def inner():
            return 1
            lost()
    return 5
    if x:
        return 6
        more()
""", {("f", 8, 10, "branch"), ("g", 17, 17, "return"), ("n", 24, 24, "return"), ("r", 43, 43, "return"), ("s", 49, 52, "loop"), ("inner", 48, 48, "return")}, set(), {("f", 2, "x")}),
    "stores.py": ("""def f(a):
    t = 0
    t += 1
    u = 0
    u += 1
    _w = 3
    import os
    from x import y as z
    b, c = a
    for d in a:
        pass
    try:
        v = 1
        v = go()
    except E as e:
        print(v)
    def inner():
        return k
    k = 1
    h = 2
    if (m := a):
        h = m
    return u, [n for n in a if (o := n)], lambda: p
def g():
    q = 1
    return locals()
def h(n):
    global G
    G = n
    s = n
    while n:
        s = n
        n = s
    s = 4
""", set(), {("f", 2, "t"), ("f", 7, "os"), ("f", 8, "z"), ("f", 15, "e"), ("f", 23, "o"), ("f", 20, "h")}, {("h", 30, "s"), ("h", 34, "s")}),
    "broken.py": ("def (", set(), set(), set()), "none.py": (None, set(), set(), set()),
}


def test_unreachable_and_unread(spark):
    found = control.facts(spark.createDataFrame([(p, c[0]) for p, c in CASES.items()], "path string, content string").repartition(2)).cache()
    name = lambda fn: fn.split(":")[2]
    dead = {(r.file, name(r.fn), r.line, r.end_line, r.reason) for r in control.unreachable(found).collect()}
    assert dead == {(p, *x) for p, c in CASES.items() for x in c[1]}
    unused = {(r.file, name(r.fn), r.line, r.name) for r in control.unused_variables(found).collect()}
    assert unused == {(p, *x) for p, c in CASES.items() for x in c[2]}
    stores = {(r.file, name(r.fn), r.line, r.name) for r in control.dead_stores(found).collect()}
    assert stores == {(p, *x) for p, c in CASES.items() for x in c[3]}


PIECES = ["if next(t):\n  {}\nelse:\n  {}", "while next(t):\n  {}\n  {}", "for _ in range(2 * next(t)):\n  {}\n  {}", "try:\n  {}\nexcept V:\n  {}", "try:\n  {}\nfinally:\n  {}", "try:\n  boom(t)\n  {}\nexcept V:\n  {}", "while True:\n  {}\n  {}", "{}\n{}"]
LEAVES = ["mark({n})", "return", "break", "continue", "raise V"]


def _programs():
    """Two levels of pieces around leaves; each leaf and what follows it says that it was reached."""
    for outer, inner in itertools.product(PIECES, PIECES):
        for a, b in itertools.product(LEAVES, LEAVES[:3]):
            body = outer.replace("{}", "\x00", 1).replace("{}", f"mark(3)\n  {b}\n  mark(4)" if outer.startswith(("if", "w", "f", "t")) else f"mark(3)\n{b}\nmark(4)", 1)
            within = inner.format(f"mark(1)\n  {a}\n  mark(2)", "mark(5)") if inner != "{}\n{}" else f"mark(1)\n{a}\nmark(2)\nmark(5)"
            pad = "  " if not outer.startswith("{}") else ""
            body = body.replace("\x00", ("\n" + pad).join(within.split("\n")))
            yield "def f(t):\n for once in range(2 * next(t)):\n  " + "\n  ".join(body.replace("{n}", "9").split("\n")) + "\n  mark(6)\n mark(7)\n"


def test_no_line_that_runs_is_called_unreachable():
    """Every program is run with all answers to its questions; what ran must be reached, and what never runs is found
    where no exception is caught (any statement of a ``try`` counts as one that may raise, though here few do)."""
    missed = asked = 0
    for source in dict.fromkeys(_programs()):
        ran: set[int] = set()
        for answers in itertools.product((True, False), repeat=6):
            class V(Exception):
                pass

            def boom(t, V=V):
                if next(t):
                    raise V

            steps = itertools.count()

            def mark(n, steps=steps):
                ran.add(sys._getframe(1).f_lineno)
                if next(steps) > 30:
                    raise RuntimeError

            scope = {"V": V, "boom": boom, "mark": mark}
            exec(source, scope)
            try:
                scope["f"](itertools.chain(answers, itertools.repeat(False)))
            except (V, RuntimeError):
                pass
        rows = control.facts_of("a.py", source)
        dead = {n for r in rows if r[2] == "block" and not r[9] and r[6] for n in range(r[4], r[5] + 1)}
        marks = {k for k, line in enumerate(source.split("\n"), 1) if "mark(" in line}
        assert not ran & dead, source
        if "except" not in source and not ("finally" in source and "while True" in source):
            asked += len(marks - ran)
            missed += len(marks - ran - dead)
    assert asked > 1000 and missed == 0, (missed, asked)


def test_bindings_of_scripts(spark):
    texts = {
        "a.js": "let a = 1\nfunction f(b, c = 2) {\n  const d = () => e, g = 3\n  for (const h of b) { i(h) }\n  for (let j = 0, n = 2; j < n; j++) {}\n  const [k, , ...m] = b\n  return d\n}\nlet e = 4\nvar _p\n",
        "b.ts": "const q: Map<string, T> = new Map();\nexport const { r } = q;\nimport { s as t } from 'u';\nconst w = { x: 1, q };\nlet y: number;\ny = 2; obj.y; const z = 'y z';\n",
        "c.js": "", "d.js": None,
    }
    files = spark.createDataFrame([(p, t, "typescript" if p.endswith("ts") else "javascript") for p, t in texts.items()], "path string, content string, language string")
    got = {(r.file, r.line, r.name) for r in deadcode.unused_bindings(lexer.tokens(files)).collect()}
    assert got == {("a.js", 1, "a"), ("a.js", 3, "g"), ("a.js", 6, "k"), ("a.js", 6, "m"), ("b.ts", 4, "w"), ("b.ts", 5, "y"), ("b.ts", 6, "z")}


def test_exports_and_listeners(spark):
    text = "export const a = 1;\nexport default function b() {}\nexport { c, d as e };\nexport { f } from './g';\nexport * from './h';\nexport async function* i() {}\nexport function* j() {}\nexport interface K { l: string }\nexport abstract class M {}\n"
    files = spark.createDataFrame([("x.ts", text, "typescript")], "path string, content string, language string")
    assert {(r.line, r.name) for r in deadcode.exports(lexer.tokens(files)).collect()} >= {(1, "a"), (2, "default"), (3, "c"), (3, "e"), (7, "j"), (8, "K"), (9, "M")}
    assert not {r.name for r in deadcode.exports(lexer.tokens(files)).collect()} & {"b", "d", "f", "l"}
    text = "let x = document.getElementById('no'); x = document.getElementById('yes');\nx.addEventListener('a', f);\ndocument.querySelector('#no')?.addEventListener('b', f);\ndocument.querySelector('div > .no').addEventListener('c', f);\ny.on('d', f);\n"
    files = spark.createDataFrame([("x.js", text, "javascript")], "path string, content string, language string")
    refs = spark.createDataFrame([("id", "yes")], "entry_type string, name string")
    assert [tuple(r) for r in deadcode.dead_listeners(lexer.tokens(files), refs).collect()] == [("x.js", 3, "id", "no")]
