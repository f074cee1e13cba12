"""Output formats of findings and graphs. Line formats are columns, so that writing is distributed; whole documents (SARIF, JUnit, GraphML)
are put together on the driver from an iterator, one partition at a time."""

from __future__ import annotations

import json
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels by severity, and short keys of the compact format (fixed values).
LEVELS = {"critical": "error", "high": "error", "warning": "warning", "medium": "warning", "info": "note", "low": "note"}
SHORT = {"file": "f", "line": "l", "severity": "s", "category": "c", "rule_id": "r", "message": "m", "name": "n", "status": "st"}


def text_lines(found: DataFrame, style: str = "text") -> DataFrame:
    """One column ``value`` a finding: text, emacs, vim, markdown, json or compact."""
    def col(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in found.columns else F.lit("")

    message = F.when(col("message") == "", col("rule_id")).otherwise(col("message"))
    styles = {
        "text": lambda: F.format_string("%s:%s [%s] %s: %s", col("file"), col("line"), col("severity"), col("rule_id"), message),
        "emacs": lambda: F.format_string("%s:%s:1: %s: %s", col("file"), col("line"), F.when(col("severity").isin("critical", "high"), "error").otherwise("warning"), message),
        "vim": lambda: F.format_string("%s:%s:1:%s:%s", col("file"), col("line"), F.when(col("severity").isin("critical", "high"), "E").otherwise("W"), message),
        "markdown": lambda: F.format_string("| %s | %s | %s | %s |", col("severity"), col("file"), col("line"), message),
        "json": lambda: F.to_json(F.struct(*found.columns)),
        "compact": lambda: F.to_json(F.struct(*[F.when(F.col(c).cast("string") != "", F.col(c)).alias(SHORT.get(c, c)) for c in found.columns])),
    }
    return found.select(styles[style]().alias("value"))


def write_lines(found: DataFrame, path: str, style: str = "json") -> None:
    text_lines(found, style).write.mode("overwrite").text(path)


def rows_of(df: DataFrame) -> Iterable[dict]:
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def sarif(found: Iterable[dict], tool: str = "weftline") -> str:
    """SARIF 2.1.0."""
    results, rules = [], {}
    for f in found:
        rules.setdefault(f["rule_id"], {"id": f["rule_id"], "shortDescription": {"text": f.get("message") or f["rule_id"]}})
        results.append({"ruleId": f["rule_id"], "level": LEVELS.get(f.get("severity", ""), "note"), "message": {"text": f.get("message") or f["rule_id"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f.get("file") or ""}, "region": {"startLine": max(1, f.get("line") or 1)}}}]} | ({"suppressions": [{"kind": "inSource"}]} if f.get("suppressed") else {}))
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": list(rules.values())}}, "results": results}]})


def gitlab(found: Iterable[dict]) -> str:
    names = {"critical": "Critical", "high": "High", "warning": "Medium", "medium": "Medium", "info": "Info", "low": "Low"}
    return json.dumps({"version": "15.0.0", "vulnerabilities": [{"id": f.get("finding_id") or f"{f['rule_id']}|{f.get('file')}|{f.get('line')}", "category": "sast", "name": f["rule_id"], "message": f.get("message") or f["rule_id"], "severity": names.get(f.get("severity", ""), "Unknown"), "location": {"file": f.get("file"), "start_line": f.get("line")}} for f in found]})


def junit(found: Iterable[dict], suite: str = "weftline") -> str:
    cases = [f'<testcase classname={quoteattr(f.get("file") or "")} name={quoteattr(f["rule_id"])}><failure message={quoteattr(f.get("message") or f["rule_id"])} type={quoteattr(f.get("severity") or "")}>{escape(str(f.get("line") or ""))}</failure></testcase>' for f in found]
    return f'<?xml version="1.0" encoding="UTF-8"?><testsuites><testsuite name={quoteattr(suite)} tests="{len(cases)}" failures="{len(cases)}">{"".join(cases)}</testsuite></testsuites>'


def graphml(nodes: Iterable[dict], edges: Iterable[dict]) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="type" for="node" attr.name="type" attr.type="string"/><key id="name" for="node" attr.name="name" attr.type="string"/><key id="kind" for="edge" attr.name="kind" attr.type="string"/><graph edgedefault="directed">']
    out += [f'<node id={quoteattr(n["node_id"])}><data key="type">{escape(n["node_type"] or "")}</data><data key="name">{escape(n["name"] or "")}</data></node>' for n in nodes]
    out += [f'<edge source={quoteattr(e["source_id"])} target={quoteattr(e["target_id"])}><data key="kind">{escape(e.get("edge_type") or "")}</data></edge>' for e in edges if e["target_id"]]
    return "".join(out) + "</graph></graphml>"


def envelope(items: list[dict], command: str, top: int | None = None, max_tokens: int | None = None, lite: list[str] | None = None) -> dict:
    """status, command, stats, items and truncated; ``max_tokens`` counts four characters a token and cuts the list to 10, then to 3, then to
    none."""
    shown = [{k: i[k] for k in lite if k in i} for i in items] if lite else list(items)
    shown = shown[:top] if top else shown
    for most in (10, 3, 0):
        if max_tokens is not None and len(json.dumps(shown, default=str)) // 4 > max_tokens:
            shown = shown[:most]
    return {"status": "ok", "command": command, "stats": {"total": len(items), "shown": len(shown)}, "items": shown, "truncated": len(shown) < len(items)}


def page(items: list[dict], command: str, size: int, offset: int = 0, **options) -> dict:
    """The envelope of ``size`` items from ``offset`` on, with offset, the total of all items, and has_more."""
    out = envelope(items[offset : offset + size], command, **options)
    out["stats"]["total"] = len(items)
    return out | {"offset": offset, "has_more": offset + size < len(items), "truncated": len(out["items"]) < len(items)}


#: Severities from the worst on, as lists are sorted (fixed values).
SEVERITY_ORDER = ("critical", "high", "medium", "warning", "low", "info")


def sorted_items(items: list[dict], key: str, descending: bool = True, least_severe_first: bool = False) -> list[dict]:
    """Items by a field; severities from the worst on, or the other way; items without the field come last."""
    have, lack = [i for i in items if i.get(key) is not None], [i for i in items if i.get(key) is None]
    if key == "severity":
        rank = {s: k for k, s in enumerate(SEVERITY_ORDER)}
        return sorted(have, key=lambda i: rank.get(str(i[key]).lower(), len(rank)), reverse=least_severe_first) + lack
    return sorted(have, key=lambda i: i[key], reverse=descending) + lack


def dashboard(title: str, metrics: dict[str, object], findings: list[dict]) -> str:
    """A page with metrics and a table of findings (as many as the caller passes)."""
    cells = "".join(f"<div><b>{escape(str(v))}</b> {escape(str(k))}</div>" for k, v in metrics.items())
    rows = "".join("<tr>" + "".join(f"<td>{escape(str(f.get(c, '') if f.get(c) is not None else ''))}</td>" for c in ("severity", "rule_id", "file", "line")) + "</tr>" for f in findings)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{cells}<table><tr><th>severity</th><th>rule</th><th>file</th><th>line</th></tr>{rows}</table></body></html>"
