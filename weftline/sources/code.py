"""Source files: discovery, ignoring, language, definitions and calls, imports, manifests.

Files come as (path, content). Definitions and calls of every language are found by line patterns with built-in functions; Python files may
be parsed exactly by ``python_symbols``, in Arrow batches on the executors.
"""

from __future__ import annotations

import ast
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import base_name, extension

MAX_BYTES = 200 * 1024
#: Directories that hold no sources of one's own, and extensions by language (fixed values).
IGNORED = ("node_modules", ".git", "dist", "build", "target", "__pycache__", ".venv", "venv", "vendor", ".next", "coverage", ".cache", ".idea", ".vscode", "out", "bin", "obj")
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".rs": "rust", ".go": "go", ".java": "java", ".kt": "kotlin",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".scala": "scala", ".sh": "shell", ".lua": "lua", ".r": "r", ".dart": "dart",
    ".ex": "elixir", ".exs": "elixir", ".hs": "haskell", ".nim": "nim", ".zig": "zig", ".vim": "vim", ".gd": "gdscript", ".m": "objc", ".html": "html", ".css": "css", ".scss": "css", ".vue": "vue", ".svelte": "svelte",
}
#: Definition patterns by language; group 1 is the name (fixed values).
DEFINITIONS = {
    "python": r"^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class)\s+([A-Za-z_$][\w$]*)",
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum)\s+([A-Za-z_$][\w$]*)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:fn|struct|enum|trait|type|mod)\s+([A-Za-z_]\w*)",
    "go": r"^\s*(?:func(?:\s*\([^)]*\))?|type)\s+([A-Za-z_]\w*)",
    "java": r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?:class|interface|enum|record|[\w<>\[\], ]+?)\s+([A-Za-z_]\w*)\s*(?:\(|\{|extends|implements)",
    "kotlin": r"^\s*(?:(?:public|private|internal|protected|open|data|sealed|suspend|override|inline)\s+)*(?:fun|class|object|interface)\s+(?:<[^>]*>\s*)?(?:\w+\.)?([A-Za-z_]\w*)",
    "c": r"^[A-Za-z_][\w\s\*]*?\b([A-Za-z_]\w*)\s*\([^;]*\)\s*\{",
    "cpp": r"^\s*(?:class|struct|[A-Za-z_][\w:<>\s\*&]*?)\s+(?:\w+::)?([A-Za-z_]\w*)\s*(?:\([^;]*\)[^;]*)?\{",
    "csharp": r"^\s*(?:(?:public|private|protected|internal|static|async|override|virtual|sealed|abstract|partial)\s+)+(?:class|interface|struct|record|[\w<>\[\]?]+)\s+([A-Za-z_]\w*)",
    "ruby": r"^\s*(?:def|class|module)\s+(?:self\.)?([A-Za-z_]\w*[?!]?)",
    "php": r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*(?:function|class|interface|trait)\s+&?([A-Za-z_]\w*)",
    "swift": r"^\s*(?:(?:public|private|internal|open|static|final|override|mutating)\s+)*(?:func|class|struct|enum|protocol|extension)\s+([A-Za-z_]\w*)",
    "scala": r"^\s*(?:(?:private|protected|override|implicit|case|final|sealed|abstract)\s+)*(?:def|class|object|trait)\s+([A-Za-z_]\w*)",
    "shell": r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{?",
    "lua": r"^\s*(?:local\s+)?function\s+(?:\w+[.:])?([A-Za-z_]\w*)",
    "r": r"^\s*([A-Za-z_.][\w.]*)\s*(?:<-|=)\s*function\b",
    "dart": r"^\s*(?:abstract\s+)?(?:class|mixin|enum|extension|[\w<>?]+)\s+([A-Za-z_]\w*)\s*(?:\(|\{|extends|with|implements)",
    "elixir": r"^\s*(?:def|defp|defmacro|defmodule)\s+([A-Za-z_][\w.]*[?!]?)",
    "haskell": r"^([a-z_][\w']*)\s*::",
    "nim": r"^\s*(?:proc|func|method|template|macro|iterator)\s+([A-Za-z_]\w*)",
    "zig": r"^\s*(?:pub\s+)?(?:export\s+)?fn\s+([A-Za-z_]\w*)",
    "vim": r"^\s*fu(?:nction)?!?\s+(?:\w:)?([A-Za-z_]\w*)",
    "gdscript": r"^\s*(?:static\s+)?(?:func|class|class_name)\s+([A-Za-z_]\w*)",
    "objc": r"^\s*(?:[-+]\s*\([^)]*\)\s*|@(?:interface|implementation|protocol)\s+)([A-Za-z_]\w*)",
}


def discover(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, max_files: int | None = None) -> DataFrame:
    """path, content, language, mtime and content_hash of source files below root; ignored folders and large files are left out before
    contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = raw.where((F.col("length") <= max_bytes) & ~F.col("path").rlike(r"/(" + "|".join(map(re.escape, IGNORED)) + r")/"))
    kept = kept.withColumn("language", language(F.col("path"))).where("language IS NOT NULL")
    if max_files is not None:
        kept = kept.orderBy("language", "path").limit(max_files)
    return kept.select("path", F.decode("content", "UTF-8").alias("content"), "language", F.unix_micros("modificationTime").alias("mtime"), F.sha2("content", 256).alias("content_hash"))


#: Interpreters that a first line names, by language (fixed values).
INTERPRETERS = {"python": "python", "python2": "python", "python3": "python", "node": "javascript", "deno": "typescript", "bash": "shell", "sh": "shell", "zsh": "shell", "ruby": "ruby", "php": "php", "lua": "lua", "Rscript": "r"}


def language(path: Column, content: Column | None = None) -> Column:
    """By name, by ending, and, where neither tells and the content is given, by the interpreter in its first line; null: unknown."""
    known = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])
    special = F.when(base_name(path) == "Dockerfile", "docker").when(base_name(path) == "Makefile", "make")
    found = [special, F.try_element_at(known, extension(path))]
    if content is not None:
        interpreters = F.create_map(*[F.lit(x) for p in INTERPRETERS.items() for x in p])
        found.append(F.try_element_at(interpreters, F.regexp_extract(content, r"^#![ \t]*(?:\S*/)?(?:env[ \t]+(?:-\S+[ \t]+)*)?([A-Za-z]+[0-9]?)(?:[.0-9]*)\b", 1)))
    return F.coalesce(*found)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Ignore files' rules over a path: the last pattern that fits decides, '!' takes back."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.lstrip("!")
        body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p.strip("/").replace("**", "\0")).replace(re.escape("\0"), ".*").replace("\0", ".*")
        anchored = p.startswith("/") or "/" in p.strip("/")
        out = F.when(path.rlike(("^" if anchored else "(^|/)") + body + ("/" if p.endswith("/") else "(/|$)")), F.lit(not back)).otherwise(out)
    return out


def ignored_in_tiers(path: Column, builtin: list[str], user: list[str], workspace: list[str]) -> Column:
    """Ignore rules of three sources; of those that fit, the last one of the last source decides."""
    return ignored(path, [*builtin, *user, *workspace])


def generated(path: Column, content: Column) -> Column:
    """Files that a tool wrote: minified, bundled, locked, or marked as generated in their first 500 characters."""
    return path.rlike(r"(?i)(\.min\.(js|css)|\.bundle\.js|[-.]lock(\.json)?|\.generated\.\w+|\.pb\.go|_pb2\.py)$") | F.substring(content, 1, 500).rlike(r"(?i)(@generated|auto-?generated|do not edit)")


def lines(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file"), "language", F.posexplode(F.split("content", "\r?\n")).alias("at", "text")).select("file", "language", (F.col("at") + 1).cast("long").alias("line"), "text")


def definitions(code: DataFrame) -> DataFrame:
    """node_id, node_type, name, file, line of the definitions in lines (file, language, line, text)."""
    name = F.lit("")
    for lang, pattern in DEFINITIONS.items():
        name = F.when(F.col("language") == lang, F.regexp_extract("text", pattern, 1)).otherwise(name)
    kind = F.when(F.col("text").rlike(r"\b(class|struct|object|trait|protocol|defmodule)\b"), "class").when(F.col("text").rlike(r"\b(interface|type|enum)\b"), "type").otherwise("function")
    found = code.withColumn("name", name).where("name != '' AND name NOT IN ('if', 'for', 'while', 'switch', 'return', 'catch', 'else', 'new')")
    return found.select(F.concat_ws(":", "file", F.col("line").cast("string"), "name").alias("node_id"), kind.alias("node_type"), "name", "file", "line")


def calls(code: DataFrame) -> DataFrame:
    """call_id, file, line and to_fn of each call in lines, definitions themselves left out."""
    names = F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$.]*)\s*\("), 1)
    found = code.where(~F.col("text").rlike(r"^\s*(#|//|\*)")).select("file", "line", "text", F.posexplode(names).alias("at", "to_fn"))
    found = found.where(~F.col("to_fn").isin("if", "for", "while", "switch", "return", "catch", "function", "elif", "and", "or", "not", "in", "assert", "def", "fn", "func", "fun"))
    defined = F.col("text").rlike(r"^\s*(?:[\w()]+\s+)*?(?:def|function\*?|fn|func|fun|proc|class)\s") & (F.col("at") == 0)
    return found.where(~defined).select(F.concat_ws(":", "file", F.col("line").cast("string"), F.col("at").cast("string")).alias("call_id"), "file", "line", "to_fn")


def imports(code: DataFrame) -> DataFrame:
    """file, line and module of import statements."""
    patterns = [r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import", r"""(?:import|export)\s[^'"]*?from\s*['"]([^'"]+)['"]""", r"""require\(\s*['"]([^'"]+)['"]\s*\)""", r"^\s*use\s+([\w:]+)", r"""@import\s+(?:url\()?['"]([^'"]+)['"]"""]
    found = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in patterns])
    return code.withColumn("module", found).where("module IS NOT NULL").select("file", "line", "module")


def resolve_imports(found: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, roots: tuple[str, ...] = ("", "src")) -> DataFrame:
    """Edges between files (source_id, target_id) for imports (file, module), as ``imports.resolved`` finds their files."""
    from weftline.sources import imports

    return imports.resolved(found.select("file", "module"), files, aliases, roots).select(F.col("file").alias("source_id"), F.col("target").alias("target_id")).distinct()


def python_symbols(files: DataFrame) -> DataFrame:
    """Exact symbols of Python files: file, line, end_line, kind, name, parameters, cyclomatic, cognitive, nesting. Files that don't parse have none."""

    def run(batches):
        for batch in batches:
            rows = [r for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in symbols_of(path, content)]
            yield pa.RecordBatch.from_pylist(rows, SYMBOL)

    return files.where("language = 'python'").select("path", "content").mapInArrow(run, "file string, line long, end_line long, kind string, name string, parameters long, cyclomatic long, cognitive long, nesting long")


SYMBOL = pa.schema([("file", pa.string()), ("line", pa.int64()), ("end_line", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("parameters", pa.int64()), ("cyclomatic", pa.int64()), ("cognitive", pa.int64()), ("nesting", pa.int64())])
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Match)


def symbols_of(path: str, content: str | None) -> list[dict]:
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            cyclomatic, cognitive, deepest, todo = 1, 0, 0, [(c, 0) for c in ast.iter_child_nodes(node)]
            while todo:
                n, depth = todo.pop()
                inner = depth
                if isinstance(n, _BRANCH):
                    cyclomatic += 1
                    cognitive += 1 + depth
                    inner = depth + 1
                    deepest = max(deepest, inner)
                elif isinstance(n, ast.BoolOp):
                    cyclomatic += len(n.values) - 1
                    cognitive += 1
                elif isinstance(n, ast.comprehension):
                    cyclomatic += 1 + len(n.ifs)
                # an elif stands as deep as its if
                chained = n.orelse if isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) else []
                todo += [(c, depth if c in chained else inner) for c in ast.iter_child_nodes(n)]
            a = getattr(node, "args", None)
            n_args = len(a.args) + len(a.kwonlyargs) + len(a.posonlyargs) if a else 0
            out.append({"file": path, "line": node.lineno, "end_line": node.end_lineno, "kind": "class" if a is None else "function", "name": node.name, "parameters": n_args, "cyclomatic": cyclomatic, "cognitive": cognitive, "nesting": deepest})
    return out


def manifests(files: DataFrame) -> DataFrame:
    """Dependencies from manifest and lock files (path, content): name, version, ecosystem, source_file, transitivity."""

    def run(batches):
        for batch in batches:
            rows = [dict(zip(DEPENDENCY.names, (*d[:3], path, d[3]), strict=True)) for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for d in dependencies_of(path, content or "")]
            yield pa.RecordBatch.from_pylist(rows, DEPENDENCY)

    return files.select("path", "content").mapInArrow(run, "name string, version string, ecosystem string, source_file string, transitivity string")


DEPENDENCY = pa.schema([(c, pa.string()) for c in ("name", "version", "ecosystem", "source_file", "transitivity")])


def dependencies_of(path: str, content: str) -> list[tuple[str, str, str, str]]:
    """(name, version, ecosystem, direct or transitive) of one file; a file that doesn't parse has none."""
    name = path.rsplit("/", 1)[-1]
    try:
        if re.fullmatch(r"requirements[\w.-]*\.txt", name):
            return [(m[1], m[2], "pypi", "direct") for m in re.finditer(r"(?m)^\s*([\w.-]+)(?:\[[^\]]*\])?\s*[=~><!]=\s*([\w.*+!-]+)", content)]
        if name in ("Pipfile.lock", "package-lock.json", "composer.lock", "composer.json", "package.json", "packages.lock.json", "Package.resolved"):
            data = json.loads(content)
            if name == "Pipfile.lock":
                return [(n, str(d.get("version", "")).lstrip("="), "pypi", "transitive") for s in ("default", "develop") for n, d in data.get(s, {}).items()]
            if name == "package.json":
                return [(n, v.lstrip("^~>=v "), "npm", "direct") for s in ("dependencies", "devDependencies") for n, v in data.get(s, {}).items()]
            if name == "package-lock.json":
                return [(p.rsplit("node_modules/", 1)[-1], d.get("version", ""), "npm", "transitive" if p.count("node_modules/") > 1 else "direct") for p, d in data.get("packages", {}).items() if p]
            if name == "composer.json":
                return [(n, v.lstrip("^~>=v "), "packagist", "direct") for s in ("require", "require-dev") for n, v in data.get(s, {}).items() if "/" in n]
            if name == "composer.lock":
                return [(p["name"], p["version"].lstrip("v"), "packagist", "transitive") for s in ("packages", "packages-dev") for p in data.get(s, [])]
            if name == "packages.lock.json":
                return [(n, d.get("resolved", ""), "nuget", "direct" if d.get("type") == "Direct" else "transitive") for t in data.get("dependencies", {}).values() for n, d in t.items()]
            pins = data.get("pins") or data.get("object", {}).get("pins", [])
            return [(p.get("identity") or p.get("package", ""), (p.get("state") or {}).get("version") or "", "swift", "transitive") for p in pins]
        if name in ("Cargo.lock", "poetry.lock"):
            return [(m[1], m[2], "crates" if name[0] == "C" else "pypi", "transitive") for m in re.finditer(r'\[\[package\]\]\s*name\s*=\s*"([^"]+)"\s*version\s*=\s*"([^"]+)"', content)]
        if name == "go.sum":
            return list(dict.fromkeys((m[1], m[2], "go", "transitive") for m in re.finditer(r"(?m)^(\S+)\s+v([^\s/]+)(?:/go\.mod)?\s", content)))
        if name == "go.mod":
            return [(m[1], m[2], "go", "transitive" if m[3] else "direct") for m in re.finditer(r"(?m)^\s*(?:require\s+)?([\w.\-/]+\.[\w.\-/]+)\s+v(\S+)(\s*//\s*indirect)?", content)]
        if name == "yarn.lock":
            return [(m[1], m[2], "npm", "transitive") for m in re.finditer(r'(?m)^"?(@?[^@"\n]+)@[^\n]*:\n\s+version:?\s+"?([^"\n]+)"?', content)]
        if name == "pnpm-lock.yaml":
            return [(m[1], m[2], "npm", "transitive") for m in re.finditer(r"(?m)^\s{2}'?/?(@?[\w.\-/]+?)[@/](\d[\w.\-+]*)[^:\n]*:\s*$", content)]
        if name == "Gemfile.lock":
            return [(m[1], m[2], "rubygems", "transitive") for m in re.finditer(r"(?m)^ {4}([\w.-]+) \(([^)]+)\)", content)]
        if name == "pubspec.lock":
            return [(m[1], m[3], "pub", "direct" if "direct" in m[2] else "transitive") for m in re.finditer(r'(?ms)^  (\w+):\n    dependency: ("?[^\n]+)\n.*?^    version: "([^"]+)"', content)]
        if name == "pom.xml":
            return [(f"{m[1]}:{m[2]}", m[3], "maven", "direct") for m in re.finditer(r"(?s)<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>", content)]
        if name in ("build.gradle", "build.gradle.kts"):
            return [(f"{m[1]}:{m[2]}", m[3], "maven", "direct") for m in re.finditer(r"""(?:implementation|api|compileOnly|runtimeOnly|testImplementation)\s*\(?\s*['"]([^:'"]+):([^:'"]+):([^'"]+)['"]""", content)]
        if name == "gradle.lockfile":
            return [(f"{m[1]}:{m[2]}", m[3], "maven", "transitive") for m in re.finditer(r"(?m)^([^:#\s]+):([^:]+):([^=]+)=", content)]
        if name == "mix.lock":
            return [(m[1], m[2], "hex", "transitive") for m in re.finditer(r'"([\w]+)":\s*\{:hex,\s*:\w+,\s*"([^"]+)"', content)]
        if name in ("pyproject.toml", "Pipfile"):
            import tomllib

            data = tomllib.loads(content)
            if name == "Pipfile":
                return [(n, (v if isinstance(v, str) else v.get("version", "")).lstrip("=~^>< "), "pypi", "direct") for s in ("packages", "dev-packages") for n, v in data.get(s, {}).items()]
            listed = [re.match(r"\s*([\w.-]+)(?:\[[^\]]*\])?\s*(?:[=~><!]=?\s*([\w.*]+))?", d) for d in data.get("project", {}).get("dependencies", [])]
            poetry = data.get("tool", {}).get("poetry", {}).get("dependencies", {})
            return [(m[1], m[2] or "", "pypi", "direct") for m in listed if m] + [(n, (v if isinstance(v, str) else v.get("version", "")).lstrip("=~^>< "), "pypi", "direct") for n, v in poetry.items() if n != "python"]
    except (ValueError, AttributeError, TypeError, KeyError):
        return []
    return []
