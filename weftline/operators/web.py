"""Operators over web pages and style sheets: references and their status, headings, links, images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frontend_status(refs: DataFrame) -> DataFrame:
    """name, entry_type, ref_count, files and status of each name. An id on several pages' html is a collision, a name that only css has is
    dead, one that several paths have is duplicate_ref, else active."""
    g = refs.groupBy("name", "entry_type").agg(
        F.count(F.lit(1)).alias("ref_count"), F.count_distinct("path").alias("files"), F.count_if(F.col("category") == "html").alias("html"),
        F.count_if(F.col("category") != "css").alias("uses"), F.count_distinct(F.when(F.col("category") == "html", F.col("path"))).alias("html_files"),
    )
    status = F.when((F.col("entry_type") == "id") & (F.col("html_files") > 1), "collision").when(F.col("uses") == 0, "dead").when(F.col("files") > 1, "duplicate_ref").otherwise("active")
    return g.select("name", "entry_type", "ref_count", "files", status.alias("status"))


def headings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, position (from 0) and level of each heading, in a page's order."""
    levels = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<h([1-6])\b"), 1)
    return pages.select(key, F.posexplode(levels).alias("position", "level")).select(key, F.col("position").cast("long").alias("position"), F.col("level").cast("int").alias("level"))


def heading_skips(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Headings that go down by more than one level: key, position, level, previous. Within a page's own row; nothing is shuffled."""
    levels = F.transform(F.regexp_extract_all(F.col(html), F.lit(r"(?i)<h([1-6])\b"), 1), lambda x: x.cast("int"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("l") - 1)), lambda i: F.struct(i.cast("long").alias("position"), F.get("l", i).alias("level"), F.get("l", i - 1).alias("previous")))
    return pages.select(key, levels.alias("l")).select(key, F.inline(F.filter(pairs, lambda p: F.coalesce(p["level"] - p["previous"] > 1, F.lit(False)))))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, href and text of each link."""
    both = F.regexp_extract_all(F.col(html), F.lit(r'(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), 1)
    found = pages.select(key, F.explode(both).alias("a"))
    return found.select(key, F.regexp_extract("a", r'(?is)href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_replace("a", r"<[^>]*>", "")).alias("text"))


def vague_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Links whose text says little: two characters or fewer, or a stock phrase."""
    return links(pages, key, html).where((F.length("text") <= 2) | F.lower("text").isin("click here", "here", "more", "read more", "link", "this"))


def images(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Images without alt text: key, tag."""
    tags = pages.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<img\b[^>]*>)"), 1)).alias("tag"))
    return tags.where(~F.col("tag").rlike(r"(?i)\balt\s*="))


def missing_refs(refs: DataFrame) -> DataFrame:
    """Names that one side has and the other lacks: name, entry_type, problem (css_without_html, html_without_css, js_without_html)."""
    side = {c: refs.where(F.col("category") == c).select("name", "entry_type").distinct() for c in ("html", "css", "js")}
    keys = ["name", "entry_type"]
    out = side["css"].join(side["html"], keys, "left_anti").withColumn("problem", F.lit("css_without_html"))
    out = out.unionByName(side["html"].where("entry_type = 'class'").join(side["css"], keys, "left_anti").withColumn("problem", F.lit("html_without_css")))
    return out.unionByName(side["js"].where("entry_type = 'id'").join(side["html"], keys, "left_anti").withColumn("problem", F.lit("js_without_html")))


def css_findings(sheets: DataFrame) -> DataFrame:
    """Of style sheets (path, content): custom properties and keyframes that no sheet uses, !important and deep z-indexes: path, category, name."""
    def every(pattern):
        return sheets.select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), 1)).alias("name"))

    out = every(r"(--[\w-]+)\s*:").distinct().join(every(r"var\((--[\w-]+)").select("name").distinct(), "name", "left_anti").select("path", F.lit("unused_variable").alias("category"), "name")
    frames = every(r"@keyframes\s+([\w-]+)").distinct()
    used = sheets.select(F.explode(F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"animation(?:-name)?\s*:\s*([^;}]*)"), 1), lambda v: F.split(v, r"[\s,]+")))).alias("name")).distinct()
    out = out.unionByName(frames.join(used, "name", "left_anti").select("path", F.lit("orphan_keyframes").alias("category"), "name"))
    out = out.unionByName(every(r"([\w-]+)\s*:[^;}]*!important").select("path", F.lit("important").alias("category"), "name"))
    return out.unionByName(every(r"z-index\s*:\s*(\d{4,})").select("path", F.lit("z_index").alias("category"), "name"))


def merge_refs(existing: DataFrame, parsed: DataFrame, changed: DataFrame) -> DataFrame:
    """Status of all names after the references of changed files (path) have been replaced by newly parsed ones."""
    kept = existing.join(changed.select("path").distinct(), "path", "left_anti")
    return frontend_status(kept.unionByName(parsed))


#: Classes of a utility vocabulary: prefixes with a value, and whole words (fixed values).
UTILITIES = (
    r"^(?:(?:sm|md|lg|xl|2xl|hover|focus|active|dark|group-hover|first|last|odd|even|disabled):)*-?(?:(?:[mp][trblxy]?|w|h|min-w|min-h|max-w|max-h|gap|gap-x|gap-y|space-x|space-y|inset|top|right|bottom|left|z|order|"
    r"text|bg|border|rounded|shadow|font|leading|tracking|opacity|flex|grid-cols|grid-rows|col-span|row-span|items|justify|content|self|overflow|object|cursor|ring|divide|transition|duration|ease|scale|rotate|translate-[xy]|"
    r"from|via|to)-[\w./\[\]#%-]+|flex|grid|block|inline|inline-block|inline-flex|hidden|table|contents|static|fixed|absolute|relative|sticky|underline|italic|uppercase|lowercase|capitalize|truncate|border|rounded|shadow|"
    r"container|antialiased|visible|invisible|sr-only)$"
)


def utility_classes(refs: DataFrame) -> DataFrame:
    """path, utilities (distinct class names of the utility vocabulary), others and share of the former, for each path."""
    names = refs.where("entry_type = 'class'").select("path", "name", F.col("name").rlike(UTILITIES).alias("utility")).distinct()
    return names.groupBy("path").agg(F.count_if("utility").alias("utilities"), F.count_if(~F.col("utility")).alias("others"), F.round(F.avg(F.col("utility").cast("int")), 4).alias("share"))
