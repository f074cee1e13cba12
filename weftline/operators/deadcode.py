"""Dead code beyond control flow: bindings that nothing reads, exports that nothing imports, listeners on elements that no page has.

What one file says is found from its tokens in the task that scans it (``sources.lexer``), all else is equi or anti joins; a name within a string,
a comment or behind a dot is no use. Python's variables within functions are in ``operators.control``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import is_test_file
from weftline.operators.graph import saved_large
from weftline.sources.lexer import KEYWORDS, Code, by_file
from weftline.sources.scanned import large

DECLARE = ("const", "let", "var")
#: Files whose exports are for others (patterns of their paths), and names that frameworks call (fixed values).
ENTRY_FILES = r"(^|/)(index\.[cm]?[jt]sx?|__init__\.pyi?|settings\.py|conftest\.py)$|(^|/)(config|conf|settings|routes|views|api|endpoints|controllers|docs_src|examples?|snippets)/"
ENTRY_NAMES = ("default", "handler", "app", "server", "router", "main", "configure", "setup")
#: What looks for elements, and whether its argument is a selector.
LOOKUPS = {"getElementById": "id", "getElementsByClassName": "class", "querySelector": "", "querySelectorAll": ""}


def _roles(t: Code) -> Iterable[tuple]:
    """k and role of each name of a variable: declared, write, key or read; whether it stands in a pattern that is taken apart; the brackets that
    hold it (-1: none)."""
    started: dict[int, str] = {}
    for i, (kind, text, owner) in enumerate(zip(t.kinds, t.texts, t.owners, strict=True)):
        if text in DECLARE or text == ";":
            started[owner] = text
        b1, a1 = t.text(i - 1), t.text(i + 1)
        if kind != "name" or text in KEYWORDS or text in DECLARE or b1 in (".", "?."):
            continue
        held, before = (t.text(owner), t.text(owner - 1)) if owner >= 0 else (None, None)
        pattern = before in DECLARE and held in ("{", "[")
        declared = b1 in DECLARE or b1 == "," and a1 == "=" and started.get(owner) in DECLARE and held != "("
        if declared or pattern and b1 != "=" and a1 not in (":", "(", ".", "["):
            role = "declared"
        elif a1 == ":" and b1 in ("{", ",") or b1 == "as" and before in ("import", "export"):
            role = "key"
        else:
            role = "write" if a1 == "=" and not (pattern and b1 == "=") else "read"
        yield i, role, pattern, owner


def unused_bindings(found: DataFrame) -> DataFrame:
    """file, line and name of ``const``, ``let`` and ``var`` (destructured ones too) that nothing between the brackets around them reads. Exported
    names, and those that begin with ``_``, don't count. found: files or tokens of JavaScript and TypeScript, as ``lexer.by_file`` takes them."""
    return by_file(found, _unused_bindings, "file string, line long, name string")


def _unused_bindings(path: str, language: str, t: Code) -> Iterable[tuple]:
    names = list(_roles(t))
    reads: dict[str, list[int]] = {}
    for i, role, _, _ in names:
        if role == "read":
            reads.setdefault(t.texts[i], []).append(i)
    for i, role, pattern, owner in names:
        if role != "declared" or t.texts[i].startswith("_"):
            continue
        # brackets around a pattern are those of its statement, around a loop's head those of the loop
        head = owner >= 0 and t.texts[owner] == "(" and t.text(owner - 1) in ("for", "await")
        around = t.owners[owner] if pattern or head else owner
        word = t.text(owner - 2) if pattern else t.text(i - 2) if t.text(i - 1) in DECLARE else None
        until = t.pairs[around] if around >= 0 else None
        of = reads.get(t.texts[i], [])
        n = bisect_left(of, i)
        used = n < len(of) and of[n] < (t.size if until is None else until) or n > 0 and of[n - 1] > around
        if not used and word != "export":
            yield path, t.lines[i], t.texts[i]


def exports(found: DataFrame, used: bool = False) -> DataFrame:
    """file, line and name of what JavaScript and TypeScript export by declaration, list or default; with ``used`` also whether ``uses`` has it, which
    is found in the same pass. found: files or tokens, as ``lexer.by_file`` takes them."""

    def rows(path, language, t):
        read = _uses(t) if used else ()
        return ((path, name, line, name in read)[: 3 + used] for name, line in _exports(t).items())

    return by_file(found, rows, "file string, name string, line long" + ", used boolean" * used)


def _exports(t: Code) -> dict[str, int]:
    """The first line of each name."""
    kinds, out, own = ("function", "class", "interface", "type", "enum", *DECLARE), {}, set()
    for i, (kind, text) in enumerate(zip(t.kinds, t.texts, strict=True)):
        b1, b2, b3 = (t.text(i - n) for n in (1, 2, 3))
        # export { a, b as c }, but for those that pass on another module's names
        if text == "{" and b1 == "export" and t.pairs[i] is not None and t.text(t.pairs[i] + 1) != "from":
            own.add(i)
        declared = b1 in kinds and (b2 == "export" or b2 in ("async", "abstract", "declare") and b3 == "export") or b1 == "*" and b2 == "function" and b3 == "export"
        if kind == "name" and declared or text == "default" and b1 == "export" or kind == "name" and t.text(i + 1) in (",", "}") and text != "as" and t.owners[i] in own:
            out.setdefault(text, t.lines[i])
    return out


def unused_exports(exported: DataFrame, bound: DataFrame, entries: str = ENTRY_FILES, names: tuple = ENTRY_NAMES, uses: DataFrame | None = None) -> DataFrame:
    """file, line, name and severity of exported (file, line, name) that no import of another file takes, by its name or with the whole module.
    bound: ``imports.bindings`` with ``target``. Re-exports count as imports. Files that fit ``entries``, tests, and ``names`` are left out.
    uses (file, name), or a column ``used`` of exported: what files use themselves; such exports are only an info."""
    asked = exported.where(~F.col("file").rlike(entries) & ~is_test_file(F.col("file")) & ~F.col("name").isin(*names))
    taken = bound.where("name NOT IN ('*', '')").select(F.col("target").alias("file"), "name").distinct()
    whole = bound.where("name = '*'").select(F.col("target").alias("file")).distinct()
    left = asked.join(large(taken), ["file", "name"], "left_anti").join(large(whole), "file", "left_anti")
    if "used" in exported.columns:
        return left.select("file", "line", "name", F.when(F.col("used"), "info").otherwise("warning").alias("severity"))
    if uses is None:
        return left.select("file", "line", "name", F.lit("warning").alias("severity"))
    here = uses.select("file", "name").distinct().withColumn("_used", F.lit(True))
    return left.join(large(here), ["file", "name"], "left").select("file", "line", "name", F.when(F.col("_used"), "info").otherwise("warning").alias("severity"))


def uses(found: DataFrame) -> DataFrame:
    """file and name of all that tokens read. found: files or tokens, as ``lexer.by_file`` takes them."""
    return by_file(found, lambda path, language, t: ((path, name) for name in sorted(_uses(t))), "file string, name string")


def _uses(t: Code) -> set[str]:
    named = ("function", "class", "interface", "type", "enum")
    return {t.texts[i] for i, role, _, _ in _roles(t) if role == "read" and t.text(i - 1) not in named and not (t.text(i - 1) == "*" and t.text(i - 2) == "function")}


def dead_listeners(found: DataFrame, refs: DataFrame) -> DataFrame:
    """file, line, entry_type and name of elements that code listens to, by ``addEventListener`` or ``on`` behind a lookup or behind the
    variable that holds it, and that no page has. refs: entry_type and name, as ``markup.references`` gives them."""
    by = Window.partitionBy("file").orderBy("k")
    code = found.where("k IS NOT NULL").select("file", "k", "line", "kind", "text")
    t = saved_large(code.select("*", *[F.lag("text", n).over(by).alias(f"b{n}") for n in (1, 2, 3, 4)], *[F.lead("text", n).over(by).alias(f"a{n}") for n in (1, 2, 3, 4, 5, 6)], F.lead("kind", 2).over(by).alias("argument")))
    listens = lambda c: F.coalesce(F.col(c).isin("addEventListener", "on"), F.lit(False))
    looked = t.where(F.col("text").isin(*LOOKUPS) & (F.col("a1") == "(") & (F.col("argument") == "string") & (F.col("a3") == ")"))
    value = F.expr("substring(a2, 2, length(a2) - 2)")
    by_id = F.when(F.col("text") == "getElementById", F.concat(F.lit("#"), value)).when(F.col("text") == "getElementsByClassName", F.concat(F.lit("."), value)).otherwise(value)
    looked = looked.withColumn("selector", by_id).where(F.col("selector").rlike(r"^[.#][\w-]+$"))
    entry = [F.when(F.col("selector").startswith("#"), "id").otherwise("class").alias("entry_type"), F.expr("substring(selector, 2)").alias("name")]
    direct = looked.where(F.col("a4").isin(".", "?.") & listens("a5")).select("file", "line", *entry)
    holder = F.when((F.col("b1") == ".") & (F.col("b3") == "="), F.col("b4")).when(F.col("b1") == "=", F.col("b2"))
    held = looked.where(~F.coalesce(F.col("a4").isin(".", "?.", "["), F.lit(False))).withColumn("variable", holder).where("variable IS NOT NULL").select("file", "k", "variable", *entry)
    heard = t.where((F.col("kind") == "name") & F.col("a1").isin(".", "?.") & listens("a2") & ~F.coalesce(F.col("b1").isin(".", "?."), F.lit(False))).select("file", "k", "line", F.col("text").alias("variable"))
    # the last lookup before it, by a window in place of a join of ranges
    both = held.select("file", "variable", "k", F.lit(None).cast("int").alias("line"), F.struct("entry_type", "name").alias("e")).unionByName(heard.select("file", "variable", "k", "line", F.lit(None).cast("struct<entry_type:string,name:string>").alias("e")))
    last = F.last("e", True).over(Window.partitionBy("file", "variable").orderBy("k"))
    through = both.withColumn("e", last).where("line IS NOT NULL AND e IS NOT NULL").select("file", "line", "e.*")
    return direct.unionByName(through).join(large(refs.select("entry_type", "name").distinct()), ["entry_type", "name"], "left_anti").select("file", F.col("line").cast("long").alias("line"), "entry_type", "name").distinct()
