"""Finders over code: routes, entry points, state, side effects, smells, dead and unreachable code, tests, names to refactor.

Lines are (file, language, line, text), definitions (node_id, node_type, name, file, line). Rule tables are literals in one expression, so
that lines are read once; what needs neighbours is a window over one file's marked lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import complexity_level, glob_pattern, is_test_file, relative_path

#: Routes: framework, pattern with method (or '') and path (fixed values).
ROUTES = [
    ("express", r"""\b(?:app|router|server|fastify)\.(get|post|put|patch|delete|all)\(\s*['"`]([^'"`]+)"""), ("flask", r"""@\w+\.(route)\(\s*['"]([^'"]+)"""), ("fastapi", r"""@\w+\.(get|post|put|patch|delete)\(\s*['"]([^'"]+)"""),
    ("django", r"""\b(path|re_path)\(\s*r?['"]([^'"]*)"""), ("go", r"""\.(HandleFunc|Handle|GET|POST|PUT|DELETE)\(\s*"([^"]+)"""), ("spring", r"""@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*)?"([^"]+)"""),
    ("laravel", r"""Route::(get|post|put|patch|delete)\(\s*['"]([^'"]+)"""), ("rust", r"""#\[(get|post|put|patch|delete)\(\s*"([^"]+)"""), ("tauri", r"""\b(invoke)\(\s*['"]([^'"]+)"""),
]
#: Entry points, state holders and effects: kind, pattern (fixed values).
ENTRIES = [("main", r"""if __name__ == ['"]__main__['"]|\bfn main\(|\bfunc main\(|public static void main\("""), ("cli_command", r"@(click|app)\.command|argparse\.ArgumentParser|\.command\("), ("cron_job", r"cron\.schedule\(|@scheduled|CronJob\("), ("worker", r"new Worker\(|@celery|@shared_task|BullMQ"), ("event_handler", r"addEventListener\(|\.on\(\s*['\"]"), ("module_export", r"module\.exports|export default"), ("test_entry", r"\b(describe|it|test)\(\s*['\"]|def test_\w+\(")]
STORES = [("redux", r"createSlice\(|createStore\(|configureStore\("), ("context", r"createContext\("), ("zustand", r"\bcreate\(\s*(?:\(|set)"), ("mobx", r"makeAutoObservable\(|@observable"), ("pinia", r"defineStore\("), ("vuex", r"new Vuex\.Store\("), ("recoil", r"\batom\(\{|\bselector\(\{"), ("xstate", r"createMachine\("), ("swr", r"\buseSWR\("), ("react-query", r"\buseQuery\("), ("svelte", r"\b(writable|readable|derived)\("), ("global", r"^\s*(window|globalThis)\.\w+\s*=")]
EFFECTS = [("dom", r"document\.|innerHTML|querySelector"), ("network", r"\bfetch\(|axios|requests\.(get|post|put|delete)|XMLHttpRequest|urllib"), ("io", r"\bopen\(|fs\.|readFile|writeFile|print\(|console\."), ("timer", r"setTimeout\(|setInterval\(|time\.sleep"), ("random", r"Math\.random|random\.\w+\("), ("state", r"localStorage|sessionStorage|\bglobal\s+\w|this\.\w+\s*=[^=]|self\.\w+\s*=[^=]"), ("external", r"subprocess\.|os\.system|child_process")]
#: Thresholds of smells (fixed values).
LONG_FUNCTION, MANY_PARAMETERS, DEEP_NESTING, LARGE_FILE, MANY_METHODS = 50, 5, 4, 500, 20
#: Confidence by engine and kind of finding, and what changes it (fixed values); other kinds have 0.5.
CONFIDENCE = {
    "dead_code": {"unreachable": 0.95, "unused_vars": 0.70, "dead_listeners": 0.60, "zombie_css": 0.50, "unused_exports": 0.45, "registry_dead": 0.75},
    "secrets": {"pattern_match": 0.90, "env_exposed": 0.85, "entropy": 0.65},
}
#: Changes: in a test, in a configuration, of a public interface, with lowered severity, after return, after throw.
CONFIDENCE_CHANGES = {"dead_code": (-0.15, -0.10, -0.20, -0.05, 0.03, -0.03), "secrets": (-0.30, 0.0, 0.0, -0.10, 0.0, 0.0)}

#: Files to read first (fixed values): bonuses of names and folders, what is left out.
FILE_BONUS = {"main": 25, "app": 22, "index": 20, "server": 18, "cli": 15, "run": 15, "start": 15, "entry": 12, "init": 8, "setup": 6, "config": 5}
FOLDER_BONUS = {"src": 15, "lib": 12, "app": 12, "cmd": 12, "internal": 10, "server": 10, "api": 8, "core": 8, "main": 6, "pages": 5, "routes": 5, "controllers": 5, "handlers": 5}
LEFT_OUT_NAMES = ("test_", "_test.", ".test.", ".spec.", "_spec.", "conftest.", "fixtures.", "__tests__", ".generated.", ".gen.", ".min.", ".bundle.")
LEFT_OUT_FOLDERS = (
    "test tests __tests__ __specs__ spec specs migrations alembic versions dist build out target node_modules vendor .next .nuxt .output .turbo .cache .git .hg .svn __pycache__ .venv venv env coverage .nyc_output "
    ".pytest_cache .mypy_cache .ruff_cache"
).split()
SOURCE_ENDINGS = "py js jsx mjs cjs ts tsx mts cts go rs java kt kts c h cpp hpp cc cxx cs rb php swift scala dart lua sh vue svelte".split()


def _kinds(table: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in table]))


def marked(lines: DataFrame, table: list[tuple[str, str]]) -> DataFrame:
    """file, line, kind and text of lines that fit a table of patterns (ENTRIES, STORES, EFFECTS or one's own)."""
    return lines.select("file", "line", "text", _kinds(table).alias("kinds")).where(F.size("kinds") > 0).select("file", "line", F.explode("kinds").alias("kind"), "text")


def routes(lines: DataFrame) -> DataFrame:
    """file, line, framework, method and path of routes."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("framework"), F.upper(F.regexp_extract("text", p, 1)).alias("method"), F.regexp_extract("text", p, 2).alias("path"))) for k, p in ROUTES]))
    found = lines.select("file", "line", hits.alias("hits")).where(F.size("hits") > 0).select("file", "line", F.inline("hits"))
    return found.withColumn("method", F.when(F.col("method").isin("ROUTE", "PATH", "RE_PATH", "HANDLEFUNC", "HANDLE", "REQUEST", "ALL", "INVOKE"), "ANY").otherwise(F.col("method")))


def route_prefixes(found: DataFrame) -> DataFrame:
    return found.groupBy(F.regexp_extract("path", r"^(/?[^/]*)", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def effects(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """node_id, name, effects (sorted) and pure of each definition: effects on the lines from it to the next definition in its file."""
    marks = marked(lines, EFFECTS).select("file", "line", "kind", F.lit(None).cast("string").alias("node_id"))
    both = marks.unionByName(definitions.select("file", "line", F.lit(None).cast("string").alias("kind"), "node_id"))
    owner = F.last("node_id", ignorenulls=True).over(Window.partitionBy("file").orderBy("line", F.col("node_id").isNull()))
    found = both.withColumn("owner", owner).where("kind IS NOT NULL AND owner IS NOT NULL").groupBy("owner").agg(F.sort_array(F.collect_set("kind")).alias("effects"))
    out = definitions.select("node_id", "name").join(found, F.col("node_id") == F.col("owner"), "left")
    return out.select("node_id", "name", F.coalesce(F.array_join("effects", ","), F.lit("")).alias("effects"), F.col("effects").isNull().alias("pure"))


def smells(symbols: DataFrame) -> DataFrame:
    """file, line, name, category and severity from exact symbols (sources.code.python_symbols)."""
    size = F.col("end_line") - F.col("line") + 1
    fn = F.col("kind") == "function"
    checks = [
        ("long_function", fn & (size > LONG_FUNCTION), F.when(size > 2 * LONG_FUNCTION, "critical").otherwise("warning")), ("many_parameters", fn & (F.col("parameters") > MANY_PARAMETERS), F.lit("warning")),
        ("deep_nesting", fn & (F.col("nesting") > DEEP_NESTING), F.lit("warning")), ("complex", fn & (F.col("cyclomatic") > 20), F.lit("critical")),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("category"), s.alias("severity"))) for k, c, s in checks]))
    return symbols.select("file", "line", "name", F.inline(hits))


def complexity(symbols: DataFrame) -> DataFrame:
    """Functions with level and rank order: level, then cyclomatic and cognitive, all descending."""
    level = complexity_level(F.col("cyclomatic"))
    rank = F.when(F.col("cyclomatic") > 50, 4).when(F.col("cyclomatic") > 20, 3).when(F.col("cyclomatic") > 10, 2).when(F.col("cyclomatic") > 5, 1).otherwise(0)
    return symbols.where("kind = 'function'").withColumn("level", level).orderBy(F.desc(rank), F.desc("cyclomatic"), F.desc("cognitive"), "file", "line")


def complexity_summary(symbols: DataFrame) -> DataFrame:
    f = symbols.where("kind = 'function'")
    return f.agg(F.round(F.avg("cyclomatic"), 2).alias("avg_cyclomatic"), F.round(F.avg("cognitive"), 2).alias("avg_cognitive"), F.count_if(F.col("cyclomatic") > 20).alias("over_20"), F.count(F.lit(1)).alias("functions"))


def large_files(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file").agg(F.max("line").alias("lines")).where(F.col("lines") > LARGE_FILE)


def duplicate_lines(lines: DataFrame, run: int = 6) -> DataFrame:
    """Stretches of ``run`` lines, blanks aside, that stand at several places: hash, n, and the first place. Counts only; places are not paired.
    Places are in the order of ``file|line`` with nine digits of the line, so that ``a10`` stands before ``a1``."""
    solid = lines.where(F.trim("text") != "")
    w = Window.partitionBy("file").orderBy("line")
    block = solid.select("file", "line", F.collect_list(F.trim("text")).over(w.rowsBetween(0, run - 1)).alias("block")).where(F.size("block") == run)
    place = F.concat("file", F.lit("|"), F.lpad(F.col("line").cast("string"), 9, "0"))
    hashed = block.select(F.xxhash64("block").alias("hash"), F.xxhash64(F.lit(1), "block").alias("hash2"), F.struct(place.alias("place"), "file", "line").alias("at"))
    return hashed.groupBy("hash", "hash2").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1").select("hash", "n", "first.file", "first.line")


def unreachable(lines: DataFrame) -> DataFrame:
    """Lines that follow a return, raise, throw, break or continue at the same indent: file, line, text. Blank lines and comments don't count."""
    solid = lines.where(~F.col("text").rlike(r"^\s*(#|//|$)"))
    w = Window.partitionBy("file").orderBy("line")
    before, indent = F.lag("text").over(w), F.length(F.regexp_extract("text", r"^(\s*)", 1))
    seen = solid.withColumn("before", before).withColumn("indent", indent).withColumn("indent_before", F.lag(indent).over(w))
    ends = F.col("before").rlike(r"^\s*(return|raise|throw|break|continue)\b(.*[^,({\[\\\s])?\s*$")
    return seen.where(ends & (F.col("indent") == F.col("indent_before")) & ~F.col("text").rlike(r"^\s*([})\]]|case\b|default\b|else\b|elif\b|except\b|finally\b|catch\b)")).select("file", "line", "text")


def unused_definitions(definitions: DataFrame, calls: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Definitions whose name nothing calls or imports; in test files their severity falls from warning to info."""
    names = calls.select(F.element_at(F.split("to_fn", r"\."), -1).alias("name"))
    if imports is not None:
        names = names.unionByName(imports.select(F.element_at(F.split("module", r"[./:]"), -1).alias("name")))
    found = definitions.join(names.distinct(), "name", "left_anti").where(~F.col("name").isin("main") & ~F.col("name").startswith("__") & ~F.col("name").startswith("test"))
    return found.select("node_id", "name", "file", "line", F.when(is_test_file(F.col("file")), "info").otherwise("warning").alias("severity"))


def test_map(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """Definitions outside tests with the number of test files that call them by name: node_id, name, tests, tested."""
    tests = calls.where(is_test_file(F.col("file"))).select(F.element_at(F.split("to_fn", r"\."), -1).alias("name"), F.col("file").alias("test_file")).distinct()
    n = tests.groupBy("name").agg(F.count(F.lit(1)).alias("tests"))
    out = definitions.where(~is_test_file(F.col("file"))).join(n, "name", "left")
    return out.select("node_id", "name", F.coalesce("tests", F.lit(0)).alias("tests"), F.col("tests").isNotNull().alias("tested"))


def coverage(tested: DataFrame) -> DataFrame:
    return tested.agg(F.round(100 * F.avg(F.col("tested").cast("int")), 1).alias("percent"))


def mentions(lines: DataFrame, name: str) -> DataFrame:
    """Where a name stands that a rename would miss or break: file, line, kind (definition, string, comment, dynamic, code)."""
    word = rf"\b{name}\b"
    kind = (
        F.when(F.col("text").rlike(rf"^\s*(#|//|\*).*{word}"), "comment").when(F.col("text").rlike(rf"(getattr|setattr|hasattr|eval|exec|Reflect\.\w+)\(.*{word}|\[['\"]{name}['\"]\]"), "dynamic")
        .when(F.col("text").rlike(rf"['\"`][^'\"`]*{word}[^'\"`]*['\"`]"), "string").when(F.col("text").rlike(rf"\b(def|class|function|fn|func|const|let|var)\s+{name}\b"), "definition").otherwise("code")
    )
    return lines.where(F.col("text").rlike(word)).select("file", "line", kind.alias("kind"))


def outline(definitions: DataFrame) -> DataFrame:
    """file and its symbols in order, as an array of (line, name, node_type); a file bounds it."""
    return definitions.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "name", "node_type"))).alias("symbols"))


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language")


def frameworks(dependencies: DataFrame) -> DataFrame:
    """Known frameworks among dependencies (name)."""
    known = ["react", "vue", "svelte", "next", "nuxt", "express", "fastify", "koa", "django", "flask", "fastapi", "rails", "laravel/framework", "tauri", "actix-web", "axum", "gin-gonic/gin", "pyspark"]
    return dependencies.where(F.col("name").isin(*known)).select("name", "version", "source_file").distinct()


def confidence(found: DataFrame) -> DataFrame:
    """found (engine, kind, and, where known, in_test, source, downgraded, after) with confidence from 0 to 1, 2 places."""
    have = lambda c: F.col(c) if c in found.columns else F.lit(None)
    source, after = have("source").cast("string"), have("after").cast("string")
    checks = [F.coalesce(have("in_test").cast("boolean"), F.lit(False)) | F.coalesce(source == "test", F.lit(False)), source == "config", source == "library_api", have("downgraded").cast("boolean"), after == "return", after == "throw"]
    out = F.lit(0.5)
    for engine, kinds in CONFIDENCE.items():
        base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("kind")), F.lit(0.5))
        for check, change in zip(checks, CONFIDENCE_CHANGES[engine], strict=True):
            base = base + F.when(F.coalesce(check, F.lit(False)), change).otherwise(0.0)
        out = F.when(F.col("engine") == engine, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(base, 2)))).otherwise(out)
    return found.withColumn("confidence", out)


def confidence_bands(found: DataFrame) -> DataFrame:
    """Number of findings in each band: high from 0.85, medium from 0.5, low, and unscored."""
    band = F.when(F.col("confidence").isNull(), "unscored").when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    return found.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def decide(nodes: DataFrame, name: str) -> DataFrame:
    """What to do about a name: CREATE if there is none, EXTEND one that is used, ASK about several, LIST_FIRST if all are dead; action, n."""
    g = nodes.where(F.lower("name") == name.lower()).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "active").alias("active"))
    return g.select(F.when(F.col("n") == 0, "CREATE").when(F.col("active") == 0, "LIST_FIRST").when(F.col("n") > 1, "ASK").otherwise("EXTEND").alias("action"), "n")


def start_here(files: DataFrame, top: int = 8) -> DataFrame:
    """Source files (path, lines) to read first: path and score, by name, folder, depth and length; ties by path. Tests, generated files and
    folders of tools are left out."""
    path = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    parts = F.split(path, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, F.lit(1), F.size(parts) - 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    left_out = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in LEFT_OUT_FOLDERS])) | ~F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*SOURCE_ENDINGS)
    for x in LEFT_OUT_NAMES:
        left_out = left_out | name.contains(x)
    by_name = F.lit(0)
    for word, bonus in reversed(FILE_BONUS.items()):
        by_name = F.when((stem == word) | stem.startswith(f"{word}.") | stem.startswith(f"{word}_"), bonus).otherwise(by_name)
    bonuses = F.create_map(*[F.lit(x) for p in FOLDER_BONUS.items() for x in p])
    by_folder = F.aggregate(folders, F.lit(0), lambda acc, x: F.greatest(acc, F.coalesce(F.try_element_at(bonuses, x), F.lit(0))))
    depth, lines = F.size(parts) - 1, F.col("lines")
    by_depth = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in (15, 12, 8, 4)]), depth + 1), F.lit(1))
    by_length = F.when(lines == 0, 0.0).when(lines < 50, lines / 50 * 20).when(lines <= 500, 20.0).otherwise(F.greatest(F.lit(5.0), 20 - F.least(lines - 500, F.lit(2000)) / 2000 * 15))
    scored = files.where(~left_out).select("path", F.bround(by_name + by_folder + by_depth + by_length).cast("long").alias("score"))
    return scored.orderBy(F.desc("score"), "path").limit(top)


#: Declared or literal types: what a line says of a name (patterns of fixed values).
TYPE_HINTS = [
    (r"^\s*(?:const|let|var)?\s*(\w+)\s*:\s*([A-Za-z_][\w.\[\]<>]*)\s*=", None), (r"^\s*(?:const |let |var )?(\w+)\s*=\s*[\"'`]", "str"), (r"^\s*(?:const |let |var )?(\w+)\s*=\s*-?\d+\s*;?\s*$", "int"),
    (r"^\s*(?:const |let |var )?(\w+)\s*=\s*-?\d+\.\d+\s*;?\s*$", "float"), (r"^\s*(?:const |let |var )?(\w+)\s*=\s*(?:[Tt]rue|[Ff]alse)\b", "bool"), (r"^\s*(?:const |let |var )?(\w+)\s*=\s*\[", "list"),
    (r"^\s*(?:const |let |var )?(\w+)\s*=\s*\{", "dict"), (r"^\s*(?:const |let |var )?(\w+)\s*=\s*(?:new\s+)?([A-Z]\w*)\(", None),
]


def types(lines: DataFrame) -> DataFrame:
    """file, line, name and type of assignments that say it: annotations, literals and constructors; the first pattern that fits."""
    hit = F.lit(None).cast("struct<name:string,type:string>")
    for pattern, kind in reversed(TYPE_HINTS):
        said = F.struct(F.regexp_extract("text", pattern, 1).alias("name"), (F.lit(kind) if kind else F.regexp_extract("text", pattern, 2)).alias("type"))
        hit = F.when(F.col("text").rlike(pattern), said).otherwise(hit)
    return lines.select("file", "line", hit.alias("hit")).where("hit IS NOT NULL").select("file", "line", "hit.name", "hit.type")


def tags(lines: DataFrame) -> DataFrame:
    """file, line, tag and value of documentation tags such as ``@FLOW: name`` in comments."""
    at = r"^\s*(?:#|//|\*|--)\s*@([A-Z][A-Z_]+):\s*(.*\S)"
    return lines.where(F.col("text").rlike(at)).select("file", "line", F.regexp_extract("text", at, 1).alias("tag"), F.regexp_extract("text", at, 2).alias("value"))


def tag_audit(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """node_id, name and tagged of each definition: does a tag stand after the definition before it and not below its own line?"""
    marks = tags(lines).select("file", "line", F.lit(None).cast("string").alias("node_id"), F.lit(0).alias("at"))
    both = marks.unionByName(definitions.select("file", "line", "node_id", F.lit(1).alias("at")))
    before = F.lag("node_id").over(Window.partitionBy("file").orderBy("line", "at"))
    first = F.row_number().over(Window.partitionBy("file").orderBy("line", "at"))
    seen = both.withColumn("tagged", before.isNull() & (first > 1)).where("node_id IS NOT NULL")
    return definitions.select("node_id", "name").join(seen.select("node_id", "tagged"), "node_id")


def registry_mismatches(registry: DataFrame, files: DataFrame) -> DataFrame:
    """file and state: ``missing`` from disk though the registry has it, or ``unregistered``."""
    known, there = registry.where("file IS NOT NULL").select("file").distinct(), files.select("file").distinct()
    gone = known.join(there, "file", "left_anti").withColumn("state", F.lit("missing"))
    return gone.unionByName(there.join(known, "file", "left_anti").withColumn("state", F.lit("unregistered")))


def heavy_folders(files: DataFrame, top: int = 10) -> DataFrame:
    """Top folders (the first part of a path) by number of files, as candidates for ignore rules: folder, n; ties by name."""
    folder = F.element_at(F.split("path", "/"), 1)
    return files.where(F.col("path").contains("/")).groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "folder").limit(top)


def matching_paths(df: DataFrame, column: str = "path", contains: str | None = None, glob: str | None = None, regex: str | None = None, exclude: str | None = None) -> DataFrame:
    """Rows whose path holds a text, fits a glob or a regular expression, and doesn't fit the glob ``exclude``; what isn't given doesn't count."""
    path = F.replace(column, F.lit("\\"), F.lit("/"))
    for test in ([path.contains(contains)] if contains else []) + ([path.rlike(glob_pattern(glob))] if glob else []) + ([path.rlike(regex)] if regex else []) + ([~path.rlike(glob_pattern(exclude))] if exclude else []):
        df = df.where(test)
    return df


def in_changed_files(found: DataFrame, changed: DataFrame, root: str = "") -> DataFrame:
    """Findings of changed files (path); those without a file go. Both sides are taken relative to ``root``."""
    name = (lambda c: relative_path(F.col(c), root)) if root else (lambda c: F.replace(c, F.lit("\\"), F.lit("/")))
    asked = changed.select(name("path").alias("_path")).distinct()
    return found.where("file IS NOT NULL").withColumn("_path", name("file")).join(asked, "_path", "left_semi").drop("_path")


def prefilter_counts(files: DataFrame, literals: list[str]) -> DataFrame:
    """seen, passed and skipped files of a prefilter by literals, over (file, content)."""
    hit = F.lit(False)
    for x in literals:
        hit = hit | F.col("content").contains(x)
    return files.agg(F.count(F.lit(1)).alias("seen"), F.count_if(hit).alias("passed"), F.count_if(~hit).alias("skipped"))
