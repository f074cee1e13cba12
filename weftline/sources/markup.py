"""Pages as trees of elements, style sheets as rules, and components of several languages as files of one each.

Elements are numbered in the order in which they open (pre), and know the last number below them (post): an element lies in another if its
number lies between the other's, which windows by page can tell. Scanning a page is Python; what follows are relations.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources import lexer

#: Elements without an end, elements whose content is no markup, and elements that end where one of the same kind begins (fixed values).
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style", "textarea", "title")
ONE_OF = {"li": ("li",), "p": ("p",), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
BARRIERS = ("ul", "ol", "table", "select", "dl", "body", "div", "article", "section")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ELEMENT = "pre int, post int, parent int, depth int, tag string, line int, attributes map<string,string>"


def tree_of(html: str) -> list[list]:
    rows, open_, line, seen, at = [], [], 1, 0, 0

    def close(n: int) -> None:
        for pre in open_[n:]:
            rows[pre][1] = len(rows) - 1
        del open_[n:]

    while m := _TAG.search(html, at):
        at = m.end()
        if not m[2]:
            continue
        line += html.count("\n", seen, m.start())
        seen, tag = m.start(), m[2].lower()
        names = [rows[pre][4] for pre in open_]
        if m[1]:
            if tag in names:
                close(len(names) - 1 - names[::-1].index(tag))
            continue
        for k in range(len(names) - 1, -1, -1):
            if names[k] in ONE_OF.get(tag, ()):
                close(k)
            if names[k] in BARRIERS or names[k] in ONE_OF.get(tag, ()):
                break
        values = [(a[1].lower(), a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or "") for a in _ATTRIBUTE.finditer(m[3])]
        rows.append([len(rows), len(rows), open_[-1] if open_ else -1, len(open_), tag, line, list(dict(reversed(values)).items())])
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            open_.append(len(rows) - 1)
    close(0)
    return rows


def elements(pages: DataFrame, key: str = "file", html: str = "content") -> DataFrame:
    """key, pre, post, parent (pre of the parent, -1: none), depth, tag, line and attributes of each element. Comments hold none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"{key} {pages.schema[key].dataType.simpleString()}, {ELEMENT}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows := [(name, *r) for r in tree_of(text or "")]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pages.select(key, html).mapInArrow(run, ddl)


def references(found: DataFrame, key: str = "file") -> DataFrame:
    """key, line, entry_type (id or class) and name of ids and classes; names that a template fills in are left out."""
    ids = found.select(key, "line", F.lit("id").alias("entry_type"), F.trim(F.col("attributes")["id"]).alias("name"))
    classes = found.select(key, "line", F.lit("class").alias("entry_type"), F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace(F.col("attributes")["class"], r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>", " ")), r"\s+"))).alias("name"))
    return ids.unionByName(classes).where("name != '' AND NOT name RLIKE r'[{}<>$%]'")


def id_collisions(found: DataFrame, key: str = "file") -> DataFrame:
    """Ids that a page has more than once: key, name, n, lines."""
    ids = references(found, key).where("entry_type = 'id'")
    return ids.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("line")).alias("lines")).where("n > 1")


def unlabelled(found: DataFrame, key: str = "file") -> DataFrame:
    """Form fields without a label: no label around them or for their id, and no attribute that names them. key, pre, line, tag."""
    a = F.col("attributes")
    fields = found.where(F.col("tag").isin("input", "select", "textarea") & ~F.coalesce(F.lower(a["type"]), F.lit("")).isin("hidden", "submit", "button", "image", "reset"))
    fields = fields.where(a["aria-label"].isNull() & a["aria-labelledby"].isNull() & a["title"].isNull())
    labels = found.where("tag = 'label'")
    named = labels.select(key, a["for"].alias("id")).where("id IS NOT NULL").distinct()
    fields = fields.select(key, "pre", "line", "tag", a["id"].alias("id")).join(named, [key, "id"], "left_anti")
    spans = labels.select(F.col(key).alias("file"), F.col("pre").alias("k"), F.col("post").alias("until"), F.lit("label").alias("scope"))
    # an element's number may be the last of a label: the label ends after it
    spans = spans.withColumn("until", F.col("until") + 1)
    around = lexer.inside(fields.select(F.col(key).alias("file"), F.col("pre").alias("k"), "line", "tag"), spans)
    return around.where("scope IS NULL").select(F.col("file").alias(key), F.col("k").alias("pre"), "line", "tag")


def css_rules(sheets: DataFrame, key: str = "file", css: str = "content") -> DataFrame:
    """key, selector and specificity (ids, classes, types) of each selector of style sheets; at-rules' own heads and keyframes are left out."""
    bare = F.regexp_replace(F.regexp_replace(F.col(css), r"(?s)/\*.*?\*/", " "), r"(?s)@(?:-\w+-)?keyframes[^{]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", " ")
    heads = F.regexp_extract_all(bare, F.lit(r"([^{};]+)\{"), 1)
    one = sheets.select(key, F.explode(heads).alias("head")).where("NOT trim(head) LIKE '@%'")
    one = one.select(key, F.explode(F.split("head", r",(?![^(\[]*[)\]])")).alias("selector")).select(key, F.trim(F.regexp_replace("selector", r"\s+", " ")).alias("selector")).where("selector != ''")
    count = lambda pattern: F.regexp_count(F.regexp_replace("selector", r"""\[[^\]]*\]""", ".a"), F.lit(pattern))
    return one.select(key, "selector", count(r"#[\w-]+").alias("ids"), count(r"\.[\w-]+|(?<!:):(?!:|not\(|is\(|where\()[\w-]+").alias("classes"), count(r"(?:^|[\s>+~(])[A-Za-z][\w-]*|::[\w-]+").alias("types"))


def unused_selectors(rules: DataFrame, refs: DataFrame, key: str = "file") -> DataFrame:
    """Selectors of rules that ask for a class or id that no element of any page has: key, selector."""
    asked = rules.select(key, "selector", F.explode(F.regexp_extract_all(F.regexp_replace("selector", r"\[[^\]]*\]", ""), F.lit(r"([.#][A-Za-z_-][\w-]*)"), 1)).alias("part"))
    asked = asked.select(key, "selector", F.when(F.col("part").startswith("."), "class").otherwise("id").alias("entry_type"), F.substring("part", 2, 1 << 20).alias("name"))
    return asked.join(refs.select("entry_type", "name").distinct(), ["entry_type", "name"], "left_anti").select(key, "selector").distinct()


def component_blocks(files: DataFrame) -> DataFrame:
    """Files (path, content, language) with components of several languages (Vue, Svelte) taken apart: their scripts and styles become contents
    in their own language, with blank lines before them so that lines keep their numbers; their templates become html. A first
    script keeps the component's path, other parts have their tag behind it."""
    several = files.where("language IN ('vue', 'svelte')")
    one = lambda tag: several.select("path", "content", F.lit(tag).alias("tag"), F.posexplode(F.regexp_extract_all("content", F.lit(rf"(?is)(<{tag}\b[^>]*>.*?</{tag}\s*>)"), 1)).alias("n", "whole"))
    found = one("script").unionByName(one("style")).unionByName(one("template"))
    head = F.regexp_extract("whole", r"(?s)^(<[^>]*>)", 1)
    body = F.regexp_replace(F.expr(r"substr(whole, length(regexp_extract(whole, r'(?s)^(<[^>]*>)', 1)) + 1)"), r"(?is)</(?:script|style|template)\s*>$", "")
    before = F.expr("length(regexp_replace(substr(content, 1, instr(content, whole) - 1), r'[^\\n]', ''))")
    language = F.when(F.col("tag") == "style", "css").when(F.col("tag") == "template", "html").when(head.rlike(r"""lang\s*=\s*['"]?tsx?"""), "typescript").otherwise("javascript")
    number = F.when(F.col("n") > 0, F.col("n").cast("string")).otherwise("")
    path = F.when((F.col("tag") == "script") & (F.col("n") == 0), F.col("path")).otherwise(F.concat("path", F.lit("#"), "tag", number))
    parts = found.select(path.alias("path"), F.concat(F.repeat(F.lit("\n"), before.cast("int")), body).alias("content"), language.alias("language"))
    return files.where("language NOT IN ('vue', 'svelte')").select("path", "content", "language").unionByName(parts)
