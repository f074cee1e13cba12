"""Imports: what a file takes from which module, the file a module is, and the definition behind a name that others pass on.

Everything is built-in functions and joins. A module gives a list of paths to try, best first; one equi-join with the files and a least rank
choose among them. Chains of re-exports are closed by pointer doubling, so that rounds grow with the logarithm of a chain's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import saved_large
from weftline.sources.code import language
from weftline.sources.scanned import dealt, large

#: Endings that are tried, by language of the importing file, best first; endings that a module may name though the file has another (fixed values).
ENDINGS = {
    "js": ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts", ".vue", ".svelte", ".json", ".css", ".scss", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.vue"),
    "python": (".py", "/__init__.py", ".pyi"),
    "css": ("", ".css", ".scss", ".sass", ".less", "/index.scss"),
    "rust": (".rs", "/mod.rs"),
}
WRITTEN = r"\.(?:js|jsx|mjs|cjs|ts|tsx)$"
_JS = ("javascript", "typescript", "vue", "svelte", "html")


def normalised(path: Column) -> Column:
    """A path without ``.`` and empty parts, in which each ``..`` takes back the part before it; what leads above the top gives null. A leading
    slash or scheme stays."""
    top = F.regexp_extract(path, r"^([A-Za-z][\w+.-]*:/+|/)?", 1)
    parts = F.filter(F.split(path.substr(F.length(top) + 1, F.length(path)), "/"), lambda x: ~x.isin("", "."))
    step = lambda acc, x: F.when(acc.isNull() | ((x == "..") & (F.size(acc) == 0)), F.lit(None)).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.concat(top, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def _folder(path: Column) -> Column:
    """The part before the last slash, empty for a file at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _above(path: Column) -> Column:
    """A file's folder and those above it, nearest first, the top (empty) last."""
    parts = F.filter(F.split(_folder(path), "/"), lambda x: x != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _under(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def _families() -> Column:
    lang = language(F.col("file"))
    return F.when(lang == "python", "python").when(lang == "css", "css").when(lang == "rust", "rust").otherwise("js")


def candidates(found: DataFrame, aliases: dict[str, str] | None = None, roots: tuple[str, ...] = ("", "src")) -> DataFrame:
    """found (file, module and, where it is known, name) with ``paths``, the paths that the module may be, best first. aliases: beginnings of
    modules and what stands for them, as configuration files of projects have them; roots: folders from which bare modules are looked for."""
    ends = F.lit(None).cast("array<string>")
    for key, values in ENDINGS.items():
        ends = F.when(F.col("_family") == key, F.array(*[F.lit(v) for v in values])).otherwise(ends)
    paths = F.flatten(F.transform("_stems", lambda s: F.transform(F.col("_ends"), lambda e: F.concat(s, e))))
    return _stems(found, aliases, roots).withColumn("_ends", ends).select(*found.columns, F.array_distinct(paths).alias("paths"))


def _stems(found: DataFrame, aliases: dict[str, str] | None, roots: tuple[str, ...]) -> DataFrame:
    """found with ``_family`` and ``_stems``, what the paths of candidates have before their endings, best first."""
    # what is used several times is a column, so that it is found once a row
    asked, found = found, found.withColumns({"_here": _folder(F.col("file")), "_family": _families()})
    file, module, here, family = F.col("file"), F.col("module"), F.col("_here"), F.col("_family")
    name = F.col("name") if "name" in asked.columns else F.lit(None).cast("string")
    # modules by path
    relative = F.array(_under(here, module))
    aliased = [F.when(module.startswith(a.rstrip("*")), F.concat(F.lit(to.rstrip("*")), module.substr(F.lit(len(a.rstrip("*")) + 1), F.length(module)))) for a, to in sorted((aliases or {}).items(), key=lambda x: -len(x[0]))]
    bare = F.array(*[_under(F.lit(r), module) for r in roots])
    plain = F.when(module.rlike(r"^\.\.?(/|$)"), relative).when(module.startswith("/"), F.array(module.substr(F.lit(2), F.length(module))))
    js = plain.when(F.coalesce(*aliased).isNotNull(), F.array(F.coalesce(*aliased))).otherwise(bare) if aliased else plain.otherwise(bare)
    css = F.when(module.rlike(r"^[a-z]+:|^//"), F.array().cast("array<string>")).otherwise(F.concat(relative, F.array(_under(here, F.regexp_replace(module, r"([^/]+)$", "_$1"))), js))
    # modules by dots
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.translate(module.substr(dots + 1, F.length(module)), ".", "/")
    up = F.concat(here, F.repeat(F.lit("/.."), dots - 1))
    python = F.when(dots > 0, F.array(F.concat_ws("/", F.nullif(up, F.lit("")), F.nullif(rest, F.lit(""))))).otherwise(F.concat(F.transform(_above(file), lambda a: _under(a, rest)), F.array(*[_under(F.lit(r), rest) for r in roots])))
    # modules by colons: the last parts may be items of the module
    crate = F.regexp_extract(file, r"^((?:.*/)?src)/", 1)
    path = F.replace(F.regexp_replace(module, r"^(?:crate|self|super)::", ""), F.lit("::"), F.lit("/"))
    base = F.when(module.startswith("crate::"), crate).when(module.startswith("super::"), F.concat(here, F.lit("/.."))).when(module.startswith("self::"), here)
    rust = F.when(base.isNotNull(), F.array(*[_under(base, p) for p in (path, _folder(path))])).otherwise(F.array().cast("array<string>"))

    stems = F.when(family == "python", python).when(family == "css", css).when(family == "rust", rust).otherwise(js)
    found = found.withColumn("_stems", F.array_compact(stems))
    # a name may be a module of a package, which comes first; a written ending may stand for another
    named = F.concat(F.transform("_stems", lambda s: F.concat_ws("/", F.nullif(s, F.lit("")), name)), F.col("_stems"))
    either = F.flatten(F.transform("_stems", lambda s: F.array(s, F.regexp_replace(s, WRITTEN, ""))))
    stems = F.when((family == "python") & name.isNotNull() & (name != "*"), named).when(family == "js", either).otherwise(F.col("_stems"))
    found = found.withColumn("_stems", F.array_distinct(stems))
    return found.withColumn("_stems", F.array_compact(F.transform("_stems", normalised))).select(*asked.columns, "_family", "_stems")


def resolved(found: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, roots: tuple[str, ...] = ("", "src")) -> DataFrame:
    """found (file, module and maybe name) with ``target``, the file that the module is; modules outside files are left out."""
    keys = [c for c in ("file", "module", "name") if c in found.columns]
    found = saved_large(found)  # read twice: what finds bindings costs more than this copy
    tried = _stems(found.select(*keys).distinct(), aliases, roots).select(*keys, "_family", F.posexplode("_stems").alias("_nth", "_stem"))
    # a file is found by its path without an ending: a module has few stems, but some twenty paths for each
    ends = F.array(*[F.struct(F.lit(family).alias("_family"), F.lit(n).alias("_end"), F.lit(e).alias("e")) for family, values in ENDINGS.items() for n, e in enumerate(values)])
    there = files.select("path").distinct().select("path", F.inline(F.filter(ends, lambda x: F.endswith("path", x["e"]))))
    there = there.select("path", "_family", "_end", F.col("path").substr(F.lit(1), F.length("path") - F.length("e")).alias("_stem"))
    best = tried.join(large(there), ["_family", "_stem"]).where("path != file").groupBy(*keys).agg(F.min_by("path", F.struct("_nth", "_end")).alias("target"))
    best = large(best.select(*[F.col(k).alias(f"_{k}") for k in keys], "target"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return found.join(best, on).drop(*[f"_{k}" for k in keys])


def _pairs(files: DataFrame, pattern: str, what: str) -> DataFrame:
    """file, what, clause and module of each fit: groups 1 and 2."""
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), 1).alias("clause"), F.regexp_extract_all("content", F.lit(pattern), 2).alias("module"))
    return files.select("file", F.lit(what).alias("what"), F.inline(both))


def bindings(files: DataFrame) -> DataFrame:
    """Of files (path, content): file, what (import, export), name (in the module; ``*`` all of it, ``default``, empty: only run), local (what it
    is called in the file) and module. Python's imports are bindings that others may import again."""
    files = dealt(files.select("path", "content"), "path")
    lang = language(F.col("path"))
    js = files.where(lang.isin(*_JS)).select(F.col("path").alias("file"), F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", " "), r"(?m)^\s*//.*$", "").alias("content"))
    quoted = r"""\s*['"]([^'"]+)['"]"""
    found = _pairs(js, r"\bimport\s+(?:type\s+)?([^'\"();]*?)\s*from" + quoted, "import").unionByName(_pairs(js, r"\bimport(\s*)" + quoted, "import"))
    found = found.unionByName(_pairs(js, r"\bexport\s+(?:type\s+)?(\*(?:\s*as\s+[\w$]+)?|\{[^}]*\})\s*from" + quoted, "export"))
    found = found.unionByName(_pairs(js, r"(?:\b(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*(?:await\s+)?)?\b(?:require|import)\(" + quoted, "require"))
    inner = F.filter(F.transform(F.split(F.regexp_extract("clause", r"\{([^}]*)\}", 1), ","), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^ ?type ", ""))), lambda x: x != "")
    listed = F.transform(inner, lambda x: F.struct(F.regexp_extract(x, r"^([\w$]+)", 1).alias("name"), F.regexp_extract(x, r"(?:^|as |: ?)([\w$]+)$", 1).alias("local")))
    first = F.regexp_extract("clause", r"^\s*([A-Za-z_$][\w$]*)", 1)
    star = F.regexp_extract("clause", r"(\*)", 1)
    lone = F.array(
        F.when(first != "", F.struct(F.when(F.col("what") == "require", "*").otherwise("default").alias("name"), first.alias("local"))),
        F.when(star != "", F.struct(F.lit("*").alias("name"), F.regexp_extract("clause", r"\*\s*as\s+([\w$]+)", 1).alias("local"))),
        F.when(F.trim("clause") == "", F.struct(F.lit("").alias("name"), F.lit("").alias("local"))),
    )
    js = found.select("file", F.when(F.col("what") == "require", "import").otherwise(F.col("what")).alias("what"), "module", F.inline(F.concat(listed, F.array_compact(lone))))
    py = files.where(lang == "python").select(F.col("path").alias("file"), F.regexp_replace("content", r"\\\n", " ").alias("content"))
    from_ = F.arrays_zip(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*from\s+(\.*[\w.]*)\s+import\s+(\([^)]*\)|[^\n#;]+)"), 1).alias("module"), F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*from\s+(\.*[\w.]*)\s+import\s+(\([^)]*\)|[^\n#;]+)"), 2).alias("clause"))
    each = py.select("file", F.inline(from_)).select("file", "module", F.explode(F.split(F.regexp_replace(F.regexp_replace("clause", r"#[^\n]*", ""), r"[()]", ""), ",")).alias("x"))
    whole = py.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*import\s+([^\n#;]+)"), 1)).alias("clause")).select("file", F.explode(F.split("clause", ",")).alias("x"))
    named = lambda x: (F.regexp_extract(x, r"^\s*([\w.*]+)", 1), F.regexp_extract(x, r"(?:^|\bas)\s+([\w*]+)\s*$", 1))
    name, local = named(F.col("x"))
    py = each.select("file", F.lit("import").alias("what"), "module", name.alias("name"), F.when(local != "", local).otherwise(name).alias("local"))
    py = py.unionByName(whole.select("file", F.lit("import").alias("what"), name.alias("module"), F.lit("*").alias("name"), F.when(local != "", local).otherwise(F.substring_index(name, ".", 1)).alias("local")))
    return js.unionByName(py.where("module != '' AND (name != '' OR local != '')")).distinct()


def definitions_behind(bound: DataFrame, defined: DataFrame) -> DataFrame:
    """The definition behind every imported name. bound: bindings with ``target``; defined: file and name of definitions. Gives file, local, name,
    target (the file that defines it) and origin (what it is called there). Re-exports are followed to their end, ``export *`` among them;
    chains that run in a circle end nowhere and are left out."""
    bound = saved_large(bound)  # read in every step
    none = bound.where("what = 'export'").unionByName(bound.where("what = 'import' AND file RLIKE '[.]pyi?$'"))
    defined = large(defined.select("file", "name").distinct())
    own = none.where("name != '*' AND name != ''").select("file", F.col("local").alias("name"), F.col("target").alias("to_file"), F.col("name").alias("to_name"))
    own = own.join(defined, ["file", "name"], "left_anti").groupBy("file", "name").agg(F.min(F.struct("to_file", "to_name")).alias("to")).select("file", "name", "to.*")
    # whole modules passed on: reach by doubling, then a pointer for each name that they have
    stars = none.where("name = '*' AND local IN ('', '*')").select(F.col("file").alias("a"), F.col("target").alias("b")).where("a != b").distinct()
    if not stars.isEmpty():
        reach, before = saved_large(stars.withColumn("far", F.lit(1))), -1
        while (n := reach.count()) != before:
            before = n
            far = reach.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("far").alias("more"))
            reach = saved_large(reach.unionByName(reach.join(far, "b").where("a != c").select("a", F.col("c").alias("b"), (F.col("far") + F.col("more")).alias("far"))).groupBy("a", "b").agg(F.min("far").alias("far")))
        has = large(defined.unionByName(own.select("file", "name")))
        passed = reach.join(has.withColumnRenamed("file", "b"), "b").where("name != 'default'").select(F.col("a").alias("file"), "name", "far", F.col("b").alias("to_file"), F.col("name").alias("to_name"))
        passed = passed.join(has, ["file", "name"], "left_anti").groupBy("file", "name").agg(F.min(F.struct("far", "to_file", "to_name")).alias("to")).select("file", "name", "to.to_file", "to.to_name")
        own = own.unionByName(passed)
    pointers, rounds = saved_large(own), 0
    open_ = lambda p: p.join(p.select(F.col("file").alias("to_file"), F.col("name").alias("to_name")), ["to_file", "to_name"], "left_semi")
    longest = pointers.count()
    while not open_(pointers).isEmpty() and 2**rounds <= longest:
        onward = pointers.select(F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.col("to_file").alias("next_file"), F.col("to_name").alias("next_name"))
        pointers = saved_large(pointers.join(onward, ["to_file", "to_name"], "left").select("file", "name", F.coalesce("next_file", "to_file").alias("to_file"), F.when(F.col("next_file").isNull(), F.col("to_name")).otherwise(F.col("next_name")).alias("to_name")))
        rounds += 1
    taken = bound.where("what = 'import' AND name NOT IN ('*', '')").select("file", "local", "name", F.col("target").alias("at"))
    via = pointers.select(F.col("file").alias("at"), "name", "to_file", "to_name")
    ends = taken.join(via, ["at", "name"], "left").select("file", "local", "name", F.coalesce("to_file", "at").alias("target"), F.when(F.col("to_file").isNull(), F.col("name")).otherwise(F.col("to_name")).alias("origin"))
    return ends.join(defined.select(F.col("file").alias("target"), F.col("name").alias("origin")), ["target", "origin"], "left_semi").select("file", "local", "name", "target", "origin").distinct()
