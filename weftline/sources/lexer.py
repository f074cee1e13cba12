"""Tokens of whole source files, and what follows from them: definitions, calls and complexity of languages with braces.

The scan of a file is Python: it tells names from what strings, templates, comments and regular expressions hold, and pairs brackets. Scopes, calls
and complexity come of the same pass, file by file: tokens are a hundred times a file's rows, and no other file is needed to know them. A file is at
most as long as discovery lets through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.scanned import batched, dealt, large, scanned

#: Languages that are scanned here, and how they differ.
TEMPLATES = ("javascript", "typescript")
NESTED_COMMENTS = ("rust", "swift", "kotlin", "scala", "dart")
BRACES = ("javascript", "typescript", "rust", "go", "java", "kotlin", "c", "cpp", "csharp", "swift", "scala", "dart", "php", "css")
#: Conditions that stand in no parentheses.
BARE_CONDITIONS = ("rust", "go", "swift")
#: Words that call nothing, though a parenthesis may follow (fixed values).
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "yield", "throw", "in", "of", "do", "else", "try", "finally", "case", "with", "import", "export", "match", "loop", "fn", "func", "fun", "let", "mut", "impl", "where", "super", "void", "delete", "instanceof", "class", "struct", "enum", "trait", "interface", "namespace", "mod", "new", "unsafe", "move", "as", "const", "var", "async", "default", "extends", "implements", "sizeof", "synchronized", "foreach", "when")
#: Of them, those that a method can't be named.
CONTROLS = ("if", "for", "while", "switch", "catch", "with", "function", "return", "foreach", "synchronized", "when", "match", "await", "typeof")
MODIFIERS = ("async", "static", "public", "private", "protected", "get", "set", "readonly", "override", "abstract", "*")
FUNCTION_WORDS, TYPE_WORDS = ("function", "fn", "func", "fun"), ("class", "struct", "enum", "trait", "interface", "namespace", "mod", "impl", "object")
#: What counts for complexity: words with a block below them, and single signs.
NESTING = ("if", "for", "while", "switch", "catch", "match", "loop", "do", "foreach", "when")
DECISIONS = ("if", "for", "while", "case", "catch", "loop", "foreach", "&&", "||", "??")
#: Words that begin a statement, and so end an expression above them.
STATEMENTS = frozenset(("const", "let", "var", "function", "export", "class", "import", "return", "if", "for", "async", "module"))
WORDED = frozenset((*FUNCTION_WORDS, *TYPE_WORDS))
TOKEN = "file string, language string, k int, line int, kind string, text string, level int, owner int, pair int"

_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?\w*")
_NAME = re.compile(r"[@#]?[A-Za-z_$][\w$]*")
_CSS_NAME = re.compile(r"-{0,2}[A-Za-z_][\w-]*")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])*/[a-z]*")
_STRINGS = {'"': re.compile(r'"(?:[^"\\\n]|\\.|\\\n)*"'), "'": re.compile(r"'(?:[^'\\\n]|\\.|\\\n)*'")}
_LONG_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_RAW = re.compile(r'b?r(#*)".*?"\1', re.S)
_CHAR = re.compile(r"b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))'")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?:`|\$\{|\Z)", re.S)
_PUNCT = re.compile(r"=>|->|\?\.(?!\d)|\?\?|&&|\|\||::|\.\.\.|[=!]==?|[<>]=|[-+*/%]=|\+\+|--|.", re.S)
_PLAIN_NAME = re.compile(r"[#@]?[A-Za-z_$][\w$]*", re.ASCII)
_MEMBER = re.compile(r"[\w$#]+", re.ASCII)
_CLOSES = {")": "(", "]": "[", "}": "{"}


def scan(content: str, language: str):
    """(kind, text, offset) of each token. Templates come in the pieces between what ``${}`` encloses."""
    at, last, held = 0, None, []  # held: for each open template expression, how many braces are open in it
    css = language == "css"
    while at < len(content):
        c = content[at]
        if m := _SPACE.match(content, at):
            at = m.end()
            continue
        kind, end = "punct", None
        if content.startswith("/*", at):
            kind, end = "comment", at + 2
            depth = 1
            while depth and end < len(content):
                close, inner = content.find("*/", end), content.find("/*", end) if language in NESTED_COMMENTS else -1
                depth, end = (depth, len(content)) if close < 0 else (depth + 1, inner + 2) if 0 <= inner < close else (depth - 1, close + 2)
        elif content.startswith("//", at) and not css or c == "#" and language == "php":
            kind, end = "comment", content.find("\n", at)
            end = len(content) if end < 0 else end
        elif c == "`" and language in TEMPLATES or c == "}" and held and held[-1] == 0:
            if c == "}":
                held.pop()
            end = _TEMPLATE.match(content, at + 1).end()
            kind = "template"
            if content.startswith("${", end - 2) and end - 2 > at:
                held.append(0)
        elif language == "rust" and (m := _RAW.match(content, at) or c in "b'" and _CHAR.match(content, at)):
            kind, end = "string", m.end()
        elif c == "`" and language == "go":
            kind, end = "string", content.find("`", at + 1) + 1 or len(content)
        elif c in _STRINGS and not (c == "'" and language == "rust") and (m := (_LONG_STRING if c == '"' and language == "rust" else _STRINGS[c]).match(content, at)):
            kind, end = "string", m.end()
        elif c == "/" and language in TEMPLATES and not (last and (last[0] in ("number", "string", "template", "regex") or last[0] == "name" and last[1] not in ("return", "typeof", "case", "in", "of", "do", "else", "void", "await", "yield") or last[1] in (")", "]", "}", "<"))) and (m := _REGEX.match(content, at)):
            kind, end = "regex", m.end()
        elif m := (_CSS_NAME if css else _NAME).match(content, at):
            kind, end = "name", m.end()
        elif m := _NUMBER.match(content, at):
            kind, end = "number", m.end()
        else:
            end = _PUNCT.match(content, at).end()
            if held:
                held[-1] += {"{": 1, "}": -1}.get(c, 0)
        yield kind, content[at:end], at
        if kind != "comment":
            last = kind, content[at:end]
        at = end


def _rows(path: str, content: str, language: str):
    """Rows as TOKEN has them. Comments have no k; a closing bracket without an opening one has no pair."""
    rows, open_, line, seen, k = [], [], 1, 0, 0
    for kind, text, at in scan(content, language):
        line += content.count("\n", seen, at)
        seen = at
        if kind == "comment":
            rows.append([path, language, None, line, kind, text, len(open_), open_[-1][1] if open_ else -1, None])
            continue
        pair = None
        if kind == "punct" and text in _CLOSES and any(o[0] == _CLOSES[text] for o in open_):
            while open_[-1][0] != _CLOSES[text]:
                open_.pop()
            _, pair, row = open_.pop()
            rows[row][8] = k
        rows.append([path, language, k, line, kind, text, len(open_), open_[-1][1] if open_ else -1, pair])
        if kind == "punct" and text in "([{":
            open_.append((text, k, len(rows) - 1))
        k += 1
    return rows


def tokens(files: DataFrame) -> DataFrame:
    """file, language, k (its number, null for comments), line, kind (name, number, string, template, regex, comment, punct), text, level (open
    brackets around it), owner (k of the innermost, -1: none) and pair (k of a bracket's partner) of each token of files (path, content, language)."""
    return scanned(files.where(F.col("language").isin(*BRACES)), ["path", "content", "language"], lambda path, content, language: _rows(path, content or "", language), TOKEN)


class Code:
    """Tokens of one file without comments, by their k: lines, kinds, texts, owners and pairs; shown: the texts of names and signs, else empty."""

    def __init__(self, rows: list) -> None:
        rows = [r for r in rows if r[2] is not None]
        _, _, _, self.lines, self.kinds, self.texts, _, self.owners, self.pairs = zip(*rows, strict=True) if rows else [()] * 9
        self.size = len(rows)
        self.shown = [text if kind in ("name", "punct") else "" for kind, text in zip(self.kinds, self.texts, strict=True)]

    def text(self, i: int) -> str | None:
        return self.texts[i] if 0 <= i < self.size else None

    def before(self, i: int, n: int = 1) -> str | None:
        return self.shown[i - n] if i >= n else None

    def after(self, i: int, n: int = 1) -> str | None:
        return self.shown[i + n] if i + n < self.size else None

    def five(self, i: int) -> list:
        """The texts before, the nearest first."""
        return [self.before(i, n) for n in range(1, 6)]

    def siblings(self) -> tuple[list, list, list]:
        """For each token, of those behind it between the same brackets: the first that ends a head, the first that begins a body, and, but for the
        next, the first that can't be part of an expression."""
        stop, body, end = ([None] * self.size for _ in range(3))
        stops, bodies, ends, later = {}, {}, {}, {}
        for i in range(self.size - 1, -1, -1):
            o, text, punct = self.owners[i], self.texts[i], self.kinds[i] == "punct"
            stop[i], body[i], end[i] = stops.get(o), bodies.get(o), later.get(o)
            later[o] = ends.get(o)
            if punct and text in ("{", ";", "=>", ",", "=", "}", "?"):
                stops[o] = i
            if punct and text in ("{", ";"):
                bodies[o] = i
            if punct and text in (",", ";") or text in STATEMENTS and i and self.lines[i] > self.lines[i - 1]:
                ends[o] = i
        return stop, body, end


def by_file(found: DataFrame, rows_of: Callable[[str, str, Code], Iterable[tuple]], ddl: str) -> DataFrame:
    """The rows (as ddl has them) that ``rows_of`` gives for path, language and tokens of each file. found: files (path, content, language), whose
    tokens never leave the task that scans them, or tokens as ``tokens`` gives them, which are dealt and sorted."""
    if "content" in found.columns:
        return scanned(found.where(F.col("language").isin(*BRACES)), ["path", "content", "language"], lambda path, content, language: rows_of(path, language, Code(_rows(path, content or "", language))), ddl)
    names = [c.split()[0] for c in TOKEN.split(", ")]
    code = dealt(found.where("k IS NOT NULL").select(*names), "file").sortWithinPartitions("file", "language", "k")

    def run(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (path, language), own in groupby(rows, lambda r: r[:2]):
            yield from rows_of(path, language, Code(list(own)))

    return large(code.mapInArrow(batched(run, ddl), ddl))


def _is_name(text: str | None, but: frozenset | tuple = KEYWORDS) -> bool:
    return text is not None and text not in but and _PLAIN_NAME.fullmatch(text) is not None


def _given(b: list) -> str:
    """The name that what follows is given by ``name =``, ``name: Type =`` or ``name:``, with the nearest text first."""
    if b[0] == "=" and b[2] == ":" and _is_name(b[3]):
        return b[3]
    return b[1] if b[0] in ("=", ":") and _is_name(b[1]) else ""


class Scope(NamedTuple):
    kind: str
    name: str
    k: int
    line: int
    start: int
    until: int
    end_line: int
    parent: str | None


def scopes(found: DataFrame) -> DataFrame:
    """Named functions and types of tokens: file, language, kind (function, method, class), name, k, line, start, until (k of the end of the
    body), end_line, parent, params (k of the opening parenthesis), members' owner. A function in an object that has a name is called
    ``object.name``; a function without a name belongs to what is around it. found: files or tokens, as ``by_file`` takes them."""
    return by_file(found, lambda path, language, t: ((path, language, *s) for s in _scopes(t, language, *t.siblings())), "file string, language string, kind string, name string, k int, line int, start int, until int, end_line int, parent string")


def _scopes(t: Code, language: str, stop: list, body: list, end: list) -> list[Scope]:
    every = []  # kind, name, k, line, owner, start, until

    def headed(kind, name, k, line, head):
        # a body in braces, or an expression up to the next sibling that can't be part of it
        owner = t.owners[head]
        if t.texts[head] == "{":
            until = t.pairs[head]
        elif t.after(head) == "{":
            until = t.pairs[head + 1]
        else:
            around = t.pairs[owner] if owner >= 0 else None
            until = next(x for x in (end[head], around, t.size) if x is not None)
        every.append((kind, name, k, line, owner, head, until))

    for i, (kind, text) in enumerate(zip(t.kinds, t.texts, strict=True)):
        if kind == "name" and text in WORDED and body[i] is not None and t.texts[body[i]] == "{" and t.before(i) not in (".", "?."):
            b, after, name = t.five(i), t.after(i), ""
            if after != "<" and _is_name(after, ("for",)):
                name = after
            elif text in FUNCTION_WORDS:
                name = t.after(i, 2) if after == "*" and _is_name(t.after(i, 2)) else _given(b[1:] if b[0] == "async" else b)
            every.append(("function" if text in FUNCTION_WORDS else "class", name, i, t.lines[i], t.owners[i], body[i], t.pairs[body[i]]))
        elif kind == "punct" and text == ")" and t.pairs[i] is not None and stop[i] is not None:
            # what a pair of parentheses is the head of
            opened, after, ends = t.pairs[i], t.after(i), t.texts[stop[i]]
            if ends == "{":
                o = t.five(opened)
                free = after in (":", "->") and o[1] is not None and (o[1] in ("{", "}", ";", ",") or o[1] in MODIFIERS)
                generator = o[1] == "*" and o[2] == "function"
                if (after == "{" or free) and _is_name(o[0], CONTROLS) and not generator and o[1] not in (".", "?.", "new", "=", "(", *FUNCTION_WORDS):
                    headed("method", o[0], opened, t.lines[opened], stop[i])
            elif ends == "=>" and after in ("=>", ":"):
                o = t.five(opened)
                headed("function", _given(o[1:] if o[0] == "async" else o), opened, t.lines[opened], stop[i])
        elif kind == "punct" and text == "=>" and language in TEMPLATES and i and t.kinds[i - 1] == "name":
            b = t.five(i)
            headed("function", _given([*b[2:], ""] if b[1] == "async" else b[1:]), i - 1, t.lines[i], i)
    every = [x for x in every if x[6] is not None and x[1] != ""]
    # a name that the braces around it give: an object's or a type's
    types: dict[int, list] = {}
    for kind, name, _, _, _, start, _ in every:
        if kind == "class":
            types.setdefault(start, []).append(name)
    out = []
    for kind, name, k, line, owner, start, until in every:
        held = owner >= 0 and t.texts[owner] == "{" and t.kinds[owner] == "punct" and t.before(owner) == "="
        holder = _given(t.five(owner)) if held else None
        last = t.lines[until] if until < t.size else line
        for parent in types.get(owner, [None]):
            called = f"{holder}.{name}" if parent is None and holder and kind != "class" else name
            out.append(Scope(kind, called, k, line, start, until, last, holder if parent is None else parent))
    return out


def _node(c: str = "") -> Column:
    return F.concat_ws(":", "file", F.col(f"{c}line").cast("string"), f"{c}name")


def definitions(found: DataFrame) -> DataFrame:
    """node_id, node_type, name, file and line, as ``code.definitions`` gives them for lines."""
    s = scopes(found)
    return s.select(_node().alias("node_id"), F.when(F.col("kind") == "class", "class").otherwise("function").alias("node_type"), "name", "file", F.col("line").cast("long").alias("line"))


def inside(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (file, k, ...) with ``scope``, the name of the innermost of the spans (file, k, until, scope) around each. Spans nest, so that the
    innermost is the last that began at the depth that is open: two windows by file, no range join."""
    names = [c for c in rows.columns if c not in ("file", "k")]
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names]
    begin = spans.select("file", "k", *none, F.lit(1).alias("_step"), F.col("scope").alias("_scope"))
    end = spans.select("file", F.col("until").alias("k"), *none, F.lit(-1).alias("_step"), F.lit(None).cast("string").alias("_scope"))
    every = rows.select("file", "k", *names, F.lit(0).alias("_step"), F.lit(None).cast("string").alias("_scope")).unionByName(begin).unionByName(end)
    every = every.withColumn("_depth", F.sum("_step").over(Window.partitionBy("file").orderBy("k").rangeBetween(Window.unboundedPreceding, 0)))
    held = F.last("_scope", True).over(Window.partitionBy("file", "_depth").orderBy("k", F.desc("_step")).rowsBetween(Window.unboundedPreceding, 0))
    return every.withColumn("scope", F.when(F.col("_depth") > 0, held)).where("_step = 0").select("file", "k", *names, "scope")


def _innermost(at: Iterable[int], spans: Iterable[tuple[int, int, str]]) -> dict[int, str]:
    """``inside`` for one file: the scope of the innermost of the spans (k, until, scope) around each place that has one."""
    at, spans = set(at), sorted(spans)
    ends = sorted(s[1] for s in spans)
    begun = ended = 0
    held, out = {}, {}
    for k in sorted(at.union(s[0] for s in spans)):
        first = begun
        while begun < len(spans) and spans[begun][0] <= k:
            begun += 1
        while ended < len(ends) and ends[ended] <= k:
            ended += 1
        depth = begun - ended
        if begun > first:
            held[depth] = spans[begun - 1][2]
        if k in at and depth > 0 and depth in held:
            out[k] = held[depth]
    return out


def calls(found: DataFrame) -> DataFrame:
    """call_id, file, line, to_fn (with what stands before its dot) and from_id, the function around the call or ``file:0:<module>``. found: files
    or tokens, as ``by_file`` takes them."""
    return by_file(found, _calls, "call_id string, file string, line long, to_fn string, from_id string")


def _calls(path: str, language: str, t: Code) -> Iterable[tuple]:
    s = _scopes(t, language, *t.siblings())
    methods, types = {x.k for x in s if x.kind == "method"}, {x.start for x in s if x.kind == "class"}
    at = {}
    for i, (kind, text) in enumerate(zip(t.kinds, t.texts, strict=True)):
        if kind != "name" or text in KEYWORDS or not (t.after(i) == "(" or t.after(i) == "?." and t.after(i, 2) == "("):
            continue
        b1, b2 = t.before(i), t.before(i, 2)
        # a member that a type declares without a body
        declared = t.owners[i] in types and b1 is not None and (b1 in ("{", "}", ";", ",") or b1 in MODIFIERS)
        if b1 in FUNCTION_WORDS or b1 == "*" and b2 == "function" or declared or i + 1 in methods:
            continue
        at[i] = f"{b2}.{text}" if b1 in (".", "?.", "::") and b2 is not None and _MEMBER.fullmatch(b2) else text
    around = _innermost(at, ((x.k, x.until, f"{path}:{x.line}:{x.name}") for x in s if x.kind != "class"))
    return ((f"{path}:{t.lines[i]}:{i}", path, t.lines[i], to, around.get(i, f"{path}:0:<module>")) for i, to in at.items())


def symbols(found: DataFrame) -> DataFrame:
    """file, line, end_line, kind, name, parameters, cyclomatic, cognitive and nesting of each named function, as ``code.python_symbols`` has
    them. Sums over a function are differences of running sums over its file, so that nested functions count in what is around them. found: files
    or tokens, as ``by_file`` takes them."""
    return by_file(found, _symbols, "file string, line long, end_line long, kind string, name string, parameters long, cyclomatic long, cognitive long, nesting long")


def _symbols(path: str, language: str, t: Code) -> Iterable[tuple]:
    stop, body, end = t.siblings()
    named = [x for x in _scopes(t, language, stop, body, end) if x.kind != "class"]
    bare, blocks, marks = language in BARE_CONDITIONS, set(), []
    for i, (kind, text) in enumerate(zip(t.kinds, t.texts, strict=True)):
        punct, after = kind == "punct", t.after(i)
        word = kind == "name" and t.before(i) not in (".", "?.")
        nests = word and text in NESTING
        ternary = punct and text == "?" and language != "rust" and after not in (".", ":", ")", ",", "=", ";")
        logical = punct and text in ("&&", "||")
        arm = punct and text == "=>" and language == "rust"
        if word and text == "else" and after == "{":
            blocks.add((i + 1, t.pairs[i + 1]))
        elif nests and body[i] is not None and t.texts[body[i]] == "{" and (bare or after == "{" or after == "(" and t.pairs[i + 1] is not None and body[i] == t.pairs[i + 1] + 1):
            blocks.add((body[i], t.pairs[body[i]]))
        turns = word and text == "else" and after is not None and after != "if"
        marks.append((word and text in DECISIONS or logical or punct and text == "??" or ternary or arm, nests or ternary or word and text == "case", turns, logical))
    steps = [0] * t.size
    for k, until in blocks:
        if until is not None:
            steps[k] += 1
            steps[until] -= 1
    depth = decision = cost = weight = 0
    sums = []
    for step, (decides, breaks, turns, logical) in zip(steps, marks, strict=True):
        depth += step
        decision += decides
        cost += breaks * (1 + depth) + turns * depth + logical
        weight += breaks + turns
        sums.append((depth, decision, cost, weight))
    last = t.size - 1
    deep: dict[int, int] = {}
    for k, scope in _innermost((k for k, step in enumerate(steps) if step > 0), ((x.k, min(x.until, last), x.k) for x in named)).items():
        deep[scope] = max(deep.get(scope, 0), sums[k][0])
    # between parentheses: commas, how many tokens, the last; and the first parenthesis from each place on
    held: dict[int, list] = {}
    for text, owner in zip(t.texts, t.owners, strict=True):
        seen = held.setdefault(owner, [0, 0, ""])
        seen[:] = seen[0] + (text == ","), seen[1] + 1, text
    opens, onward = [last + 1] * t.size, last + 1
    for i in range(last, -1, -1):
        onward = i if t.texts[i] == "(" else onward
        opens[i] = onward
    for x in named:
        parameters = int(x.kind == "function")
        if opens[x.k] < x.start:
            commas, n, final = held.get(opens[x.k], (0, 0, ""))
            parameters = commas + (n > 0) - (final == ",")
        (depth, decision, cost, weight), upto = sums[x.start], sums[min(x.until, last)]
        nesting = max(deep.get(x.k, depth) - depth, 0)
        yield path, x.line, x.end_line, "function", x.name, parameters, 1 + upto[1] - decision, upto[2] - cost - depth * (upto[3] - weight), nesting
