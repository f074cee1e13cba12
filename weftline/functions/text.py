"""Scalar functions on text, as column expressions."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the search index leaves out (fixed values).
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def tokens(text: Column, most: int | None = None) -> Column:
    """Search tokens: cut at camel-case steps and at signs, lower case, two characters or more, no stopwords; all, or the first ``most``."""
    cut = F.split(F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+")
    kept = F.filter(cut, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))
    return kept if most is None else F.slice(kept, 1, most)


def term_counts(text: str | None) -> list[tuple[str, int, int]]:
    """Each different token of a text, as ``tokens`` gives them, with its number and that of all tokens. To count within a row takes no
    shuffle, and built-in functions would take the square of its tokens for it."""
    found = [t for t in re.findall(r"[a-z0-9]{2,}", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text or "").lower()) if t not in STOPWORDS]
    return [(t, n, len(found)) for t, n in Counter(found).items()]


def alternate_case(name: Column) -> Column:
    """snake_case for camelCase names and the other way; underscores in front stay."""
    lead = F.regexp_extract(name, r"^_*", 0)
    body = F.regexp_replace(name, r"^_+", "")
    words = F.split(body, "_+")
    camel = F.concat(F.lower(F.element_at(words, 1)), F.array_join(F.transform(F.slice(words, 2, 1000), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.expr("''")), w.substr(F.lit(2), F.length(w)))), ""))
    snake = F.lower(F.regexp_replace(body, r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.concat(lead, F.when(F.contains(body, F.lit("_")), camel).otherwise(snake))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def node_file(node_id: Column) -> Column:
    """File of a ``file:line:name`` id: all but the last two parts."""
    parts = F.split(node_id, ":")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 2), ":")).otherwise(F.element_at(parts, 1))


def node_line(node_id: Column) -> Column:
    """Line of such an id; 0 where it isn't a number."""
    parts = F.split(node_id, ":")
    return F.when(F.size(parts) > 2, F.coalesce(F.try_to_number(F.element_at(parts, -2), F.lit("999999999")).cast("long"), F.lit(0))).otherwise(F.lit(0))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1))


def is_test_file(path: Column) -> Column:
    """Paths of tests: a test directory, or a name that starts or ends with test or spec."""
    return path.rlike(r"(?i)(^|/)(tests?|__tests__|specs?|e2e)/") | base_name(path).rlike(r"(?i)(^test_|[._-](test|spec)\.[a-z]+$|_test\.[a-z]+$|^conftest\.py$)")


def mask(secret: Column) -> Column:
    return F.concat(F.substring(secret, 1, 4), F.lit("***"))


def version_key(version: Column, parts: int = 6) -> Column:
    """Array of numbers that orders dotted versions; missing parts are 0, signs before and words after are dropped."""
    numbers = F.transform(F.split(F.regexp_replace(version, r"^[^0-9]*", ""), r"[.\-+]"), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d{1,9})", 1).try_cast("long"), F.lit(0)))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), parts)), 1, parts)


def in_range(version: Column, rule: Column) -> Column:
    """Does the version satisfy one comparison such as '<1.2.3' or '>= 2.0'?"""
    op, bound = F.regexp_extract(rule, r"^\s*(<=|>=|==|!=|<|>|=)?", 1), version_key(F.regexp_replace(rule, r"^\s*(<=|>=|==|!=|<|>|=)?\s*", ""))
    v = version_key(version)
    return F.when(op == "<", v < bound).when(op == "<=", v <= bound).when(op == ">", v > bound).when(op == ">=", v >= bound).when(op == "!=", v != bound).otherwise(v == bound)


def decisions(code: Column) -> Column:
    """Decision points in a stretch of code: branches, loops, cases, handlers and short-circuit operators."""
    return F.regexp_count(code, F.lit(r"\b(if|elif|for|while|case|catch|except|and|or)\b|&&|\|\||\?(?![.?:])"))


#: Bounds of cyclomatic complexity and their names (fixed values).
COMPLEXITY_LEVELS = ((5, "simple"), (10, "moderate"), (20, "complex"), (50, "very_complex"))


def complexity_level(cyclomatic: Column) -> Column:
    out = F.lit("untamable")
    for bound, name in reversed(COMPLEXITY_LEVELS):
        out = F.when(cyclomatic <= bound, name).otherwise(out)
    return out


def code_lines(body: Column) -> Column:
    """Lines of code in a stretch: blank lines, lines of ``//``, ``#`` or ``*`` and what stands in block comments don't count."""
    bare = F.regexp_replace(body, r"(?s)/\*.*?(\*/|$)", "")
    return F.size(F.filter(F.split(bare, "\n"), lambda x: ~x.rlike(r"^\s*(//|#|\*|$)")))


def without_strings(code: Column) -> Column:
    """Code with the contents of its quoted strings taken out; an escaped quote doesn't end one."""
    return F.regexp_replace(code, r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", '""')


def truncated(text: Column, width: int) -> Column:
    """At most ``width`` characters; what is cut ends in three dots."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(text.substr(F.lit(1), F.lit(max(0, width - 3))), F.lit("..."[:width])))


def relative_path(path: Column, root: str) -> Column:
    """A path without the prefix ``root``, where it has that; slashes forward."""
    clean, top = forward_slashes(path), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(clean.startswith(top), clean.substr(F.lit(len(top) + 1), F.length(clean))).otherwise(clean)


def is_within(path: Column, root: str) -> Column:
    """Does a path stay below ``root``, when each ``..`` takes back the part before it? Relative paths begin there; null stays null."""
    top = root.replace("\\", "/").rstrip("/")
    clean = F.regexp_replace(forward_slashes(path), r"/(\./)+", "/")
    whole = F.when(clean.startswith("/"), clean).otherwise(F.concat(F.lit(top + "/"), clean))
    parts = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.lit("/")).startswith(f"{top}/")


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob over whole paths: ``**`` crosses slashes, ``*`` and ``?`` don't; without a slash it is about names."""
    out, k = "", 0
    while k < len(glob):
        if glob[k : k + 3] == "**/":
            out, k = out + "(?:.*/)?", k + 3
        elif glob[k : k + 2] == "**":
            out, k = out + ".*", k + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[k]) or re.escape(glob[k])
            k += 1
    return f"^{out}$" if "/" in glob else f"(?:^|/){out}$"


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def json_field(text: Column, name: str) -> Column:
    """A field of a JSON text, as text; null where the text isn't JSON or has no such field."""
    return F.get_json_object(text, f"$.{name}")


def finding_id(rule: Column, file: Column, line: Column, severity: Column) -> Column:
    """Sixteen hexadecimal digits that name a finding."""
    return F.substring(F.sha1(F.concat_ws("|", F.coalesce(rule, F.lit("")), F.coalesce(file, F.lit("")), F.coalesce(line.cast("string"), F.lit("0")), F.coalesce(severity, F.lit(""))).cast("binary")), 1, 16)


def rotated(cycle: Column) -> Column:
    """An array turned so that its least element comes first."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.when(F.size(cycle) == 0, cycle).otherwise(F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, F.lit(1), at - 1)))
