"""Findings: rules over lines, suppression, gates, scores, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Severities from the worst on, other names for them, and weights in the health score (fixed values).
SEVERITIES = ("critical", "high", "medium", "low", "info", "unknown")
RANKS = {s: k for k, s in enumerate(SEVERITIES)} | {"warning": 2}
WEIGHTS = {"critical": 3.0, "high": 1.0, "warning": 1.0, "medium": 1.0, "info": 0.1, "low": 0.1}
#: Health score: density of weighted findings and the score up to it; criticals for each file and the penalty up to it (fixed values).
HEALTH_BANDS = ((0.5, 95), (2, 85), (5, 70), (10, 55), (20, 40), (50, 25), (100, 20))
LOWEST_HEALTH = 8
CRITICAL_BANDS = ((1, 5), (5, 10), (10, 15), (20, 20))

#: Line rules: id, category, severity, pattern, message (fixed values; patterns that Java and RE2 read alike).
LINE_RULES = [
    ("hex-token", "secrets", "critical", r"(?i)(token|secret|api_?key|passw(or)?d)[\"']?\s*[:=]\s*[\"'][0-9a-z_\-]{16,}[\"']", "a secret stands in the text"),
    ("cloud-key", "secrets", "critical", r"\bAKIA[0-9A-Z]{16}\b", "an access key of a cloud"),
    ("private-key", "secrets", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "a private key"),
    ("debug-print", "debug", "warning", r"(\bconsole\.(log|debug|trace)|(^|[^\w.])print)\(", "a debugging call"),
    ("debugger", "debug", "high", r"^\s*(debugger;|import pdb|breakpoint\(\))", "a breakpoint"),
    ("todo", "debug", "info", r"\b(TODO|FIXME|HACK|XXX)\b", "an open task"),
    ("skipped-test", "debug", "info", r"(it\.skip|describe\.skip|@pytest\.mark\.skip|\.only\()", "a test that is left out"),
    ("eval", "injection", "critical", r"(^|[^\w.])(eval|exec)\(", "code from a string"),
    ("sql-concat", "injection", "high", r"(?i)(select|insert|update|delete) .*[\"'] ?\+", "SQL put together from parts"),
    ("inner-html", "injection", "high", r"(\.innerHTML\s*=|dangerouslySetInnerHTML|document\.write\()", "markup from a string"),
    ("sync-io", "performance", "warning", r"(readFileSync|writeFileSync|execSync)\(", "input or output that blocks"),
    ("await-in-loop", "performance", "warning", r"(for|while)\s*\(.*\bawait\b", "waiting within a loop"),
    ("mutable-default", "smell", "warning", r"def \w+\(.*=\s*(\[\]|\{\})", "a mutable default"),
    ("magic-number", "smell", "info", r"[=<>]\s*([0-9]{5,}|[03-9][0-9]{3}|1[0-8][0-9]{2}|2[1-9][0-9]{2})\b", "a number without a name"),
    ("nested-callback", "smell", "warning", r"(function\s*\(.*){3,}", "callbacks within callbacks"),
    ("nested-quantifier", "regex", "high", r"\([^)]*[+*]\)[+*]", "a pattern that may take exponential time"),
    ("connection-string", "secrets", "critical", r"\b(postgres|postgresql|mysql|mongodb|redis|amqp)(\+\w+)?://[^\s:/@'\"]+:[^\s:/@'\"]+@", "a password in a connection string"),
    ("web-token", "secrets", "high", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", "a signed token"),
    ("shell-true", "injection", "high", r"\bshell\s*=\s*True\b", "a command run by a shell"),
    ("unsafe-load", "injection", "high", r"\b(yaml\.load\([^)]*\)|pickle\.loads?\(|marshal\.loads?\()", "data that can run code"),
    ("weak-hash", "crypto", "warning", r"(hashlib\.(md5|sha1)\(|createHash\(['\"](md5|sha1)['\"])", "a weak hash"),
    ("no-certificate-check", "crypto", "high", r"(verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true)", "certificates are not checked"),
    ("alert", "debug", "warning", r"(^|[^\w.])alert\(", "a dialogue for debugging"),
    ("debug-macro", "debug", "warning", r"(\bdbg!\(|\bvar_dump\(|\bprintStackTrace\()", "a debugging aid"),
    ("deep-copy-by-json", "performance", "info", r"JSON\.parse\(\s*JSON\.stringify\(", "a copy by way of text"),
    ("sync-request", "performance", "warning", r"\.open\(\s*['\"](GET|POST)['\"]\s*,[^,)]+,\s*false\s*\)", "a request that blocks"),
    ("select-all", "performance", "info", r"(?i)\bselect\s+\*\s+from\b", "all columns are read"),
    ("bare-except", "smell", "warning", r"^\s*except\s*:", "all errors are caught"),
    ("empty-catch", "smell", "warning", r"catch\s*(\([^)]*\))?\s*\{\s*\}", "an error is dropped"),
    ("loose-equality", "smell", "info", r"[^=!<>]==\s*(null|undefined|true|false)\b", "a comparison that converts types"),
    ("greedy-any", "regex", "info", r"re\.(match|search|compile)\(r?['\"][^'\"]*\.\*[^'\"]*\.\*", "a pattern with several greedy parts"),
    ("positive-tabindex", "accessibility", "warning", r"tabindex=['\"]?[1-9]", "an order of focus by hand"),
    ("frame-title", "accessibility", "warning", r"<iframe(\s+([a-su-zA-SU-Z][\w-]*|t[a-hj-z][\w-]*)(=(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*\s*/?>", "a frame without a title"),
    ("zoom-off", "accessibility", "warning", r"user-scalable\s*=\s*(no|0)\b", "zoom is switched off"),
    ("vague-link", "accessibility", "info", r">\s*(click here|here|more|read more)\s*</a>", "a link without a meaning"),
    ("missing-alt", "accessibility", "warning", r"<img(\s+([b-zB-Z][\w-]*|a[a-km-z][\w-]*|al[a-su-z][\w-]*)(=(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*\s*/?>", "an image without alternative text"),
]


def rule_table(spark: SparkSession, rules=LINE_RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_id string, category string, severity string, pattern string, message string")


def _hits(rules, text, asked=None):
    """Array of the rules that a line's text fits; asked: an array of marks, a rule without one isn't tried."""
    tests = [F.col(text).rlike(p) if asked is None else F.element_at(asked, k + 1) & F.col(text).rlike(p) for k, (_, _, _, p, _) in enumerate(rules)]
    return F.array_compact(F.array(*[F.when(t, F.struct(F.lit(i).alias("rule_id"), F.lit(c).alias("category"), F.lit(s).alias("severity"))) for t, (i, c, s, _, _) in zip(tests, rules, strict=True)]))


def scan(lines: DataFrame, rules=LINE_RULES) -> DataFrame:
    """file, line, rule_id, category, severity of each line and rule that match. The rules are literals in one array, so that lines are
    read once and nothing is joined; only matching lines are exploded."""
    return lines.select("file", "line", _hits(rules, "text").alias("hits")).where(F.size("hits") > 0).select("file", "line", F.inline("hits"))


def scan_files(files: DataFrame, rules=LINE_RULES) -> DataFrame:
    """``scan`` over files (file, content). A rule is tried on the lines of those files only whose whole text has one of the literals that a
    match must have, or, where the rule asks for none, fits the rule; files without any such rule aren't cut into lines."""
    from weftline.operators.search import may_match

    asked = [may_match(F.col("content"), p) for _, _, _, p, _ in rules]
    marked = files.select("file", "content", F.array(*asked).alias("asked")).where(F.array_contains("asked", True))
    lines = marked.select("file", "asked", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    hits = lines.select("file", (F.col("at") + 1).cast("long").alias("line"), _hits(rules, "text", F.col("asked")).alias("hits"))
    return hits.where(F.size("hits") > 0).select("file", "line", F.inline("hits"))


def run_rule_tests(spark: SparkSession, cases: DataFrame | list[tuple[str, str, bool]], rules=LINE_RULES) -> DataFrame:
    """rule_id, text, expected, found and passed of each case (rule_id, line of text, expected: must the rule find it), given as a table or a
    list. Each case is judged in its own row."""
    rows = cases if isinstance(cases, DataFrame) else spark.createDataFrame(cases, "rule_id string, text string, expected boolean")
    found = F.lit(False)
    for rule in rules:
        found = F.when(F.col("rule_id") == rule[0], F.col("text").rlike(rule[3])).otherwise(found)
    out = rows.select("rule_id", "text", "expected", F.coalesce(found, F.lit(False)).alias("found"))
    return out.withColumn("passed", F.col("expected") == F.col("found"))


def suppress(found: DataFrame, lines: DataFrame, keywords: tuple[str, ...] = ("ignore-finding",)) -> DataFrame:
    """found with suppressed and reason: a comment ``keyword[: rule, ...] [-- reason]`` on the line, or ``keyword-next`` on the line before,
    names the rule or names none. Only lines with a keyword take part in the join."""
    at = rf"(?:{'|'.join(keywords)})(-next)?\b(?:\s*:\s*([\w\-.]+(?:\s*,\s*[\w\-.]+)*))?(?:\s+--\s*(.*\S))?"
    has = F.lit(False)
    for k in keywords:
        has = has | F.col("text").contains(k)
    part = lambda k: F.regexp_extract("text", at, k)
    marks = lines.where(has & F.col("text").rlike(at)).select("file", (F.col("line") + F.when(part(1) == "-next", 1).otherwise(0)).alias("line"), F.filter(F.split(part(2), r"\s*,\s*"), lambda r: r != "").alias("_rules"), F.nullif(part(3), F.lit("")).alias("_reason"))
    marks = marks.groupBy("file", "line").agg(F.flatten(F.collect_list("_rules")).alias("_rules"), F.min(F.size("_rules")).alias("_least"), F.min("_reason").alias("_reason"))
    hit = F.coalesce((F.col("_least") == 0) | F.array_contains("_rules", F.col("rule_id")), F.lit(False))
    return found.join(marks, ["file", "line"], "left").withColumn("suppressed", hit).withColumn("reason", F.when(F.col("suppressed"), F.col("_reason"))).drop("_rules", "_least", "_reason")


def severity_rank(column: str = "severity"):
    """0 for critical to 5; what isn't a severity ranks below info."""
    ranks = F.create_map(*[F.lit(x) for p in RANKS.items() for x in p])
    return F.coalesce(F.try_element_at(ranks, F.lower(column)), F.lit(RANKS["unknown"]))


def gate(found: DataFrame, threshold: str = "high", max_findings: int | None = None) -> DataFrame:
    """total, blocking (at the threshold or above) and passed."""
    n = F.count(F.lit(1))
    blocking = F.count_if(severity_rank() <= RANKS[threshold])
    passed = (blocking == 0) if max_findings is None else (blocking == 0) & (n <= max_findings)
    return found.agg(n.alias("total"), blocking.alias("blocking"), passed.alias("passed"))


def rollup(found: DataFrame) -> DataFrame:
    """Findings by category and severity."""
    return found.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


def health(found: DataFrame, n_files: DataFrame) -> DataFrame:
    """files, critical, density and score from 0 to 100. n_files: one row, column files.

    The density of severity-weighted findings for each file gives a score; criticals take off a penalty by their number for each file, at
    least 5; their share of all findings adds 5 below a tenth and takes 5 from three tenths on.
    """
    weights = F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p])
    f = found.agg(F.coalesce(F.sum(F.coalesce(F.try_element_at(weights, F.col("severity")), F.lit(0.1))), F.lit(0.0)).alias("weight"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count(F.lit(1)).alias("n"))
    both = f.crossJoin(F.broadcast(n_files)).withColumn("_files", F.greatest("files", F.lit(1))).withColumn("density", F.col("weight") / F.col("_files"))
    base, per_file = F.lit(LOWEST_HEALTH), F.col("critical") / F.col("_files")
    for bound, score in reversed(HEALTH_BANDS):
        base = F.when(F.col("density") <= bound, score).otherwise(base)
    penalty = F.least(F.lit(35), F.floor(per_file * 0.5))
    for bound, points in reversed(CRITICAL_BANDS):
        penalty = F.when(per_file <= bound, points).otherwise(penalty)
    penalty = F.when(F.col("critical") == 0, 0).otherwise(F.greatest(F.lit(5), penalty))
    ratio = F.col("critical") / F.greatest("n", F.lit(1))
    bonus = F.when(ratio < 0.1, 5).when(ratio < 0.3, 0).otherwise(-5)
    return both.select("files", "critical", F.round("density", 4).alias("density"), F.greatest(F.lit(0), F.least(F.lit(100), base - penalty + bonus)).cast("long").alias("score"))


def overall_risk(found: DataFrame, by: str | None = None) -> DataFrame:
    """risk: the worst severity there is, 'none' without findings; for each value of ``by``, if given."""
    ranks = F.array(*[F.lit(s) for s in SEVERITIES])
    risk = F.coalesce(F.try_element_at(ranks, F.min(severity_rank()) + 1), F.lit("none")).alias("risk")
    return found.groupBy(by).agg(risk) if by else found.agg(risk)


def deduplicated(found: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row by ``order`` of each combination of keys. The best row is kept while rows are gathered, so that no key's rows are
    sorted in one task."""
    cols = found.columns
    best = F.min_by(F.struct(*cols), F.struct(*order)).alias("row")
    return found.groupBy(*keys).agg(best).select("row.*")


def accuracy(pairs: DataFrame) -> DataFrame:
    """precision, recall, f1 and fpr (4 places) from booleans predicted and truth; 0 where a share has no base."""
    c = pairs.agg(F.count_if(F.col("predicted") & F.col("truth")).alias("tp"), F.count_if(F.col("predicted") & ~F.col("truth")).alias("fp"), F.count_if(~F.col("predicted") & F.col("truth")).alias("fn"), F.count_if(~F.col("predicted") & ~F.col("truth")).alias("tn"))
    share = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 4)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(fp, fp + tn).alias("fpr"))


def top_by_priority(found: DataFrame, most: int = 20, categories: list[str] | None = None) -> DataFrame:
    """All critical findings, then others by rank, category (in the order of ``categories``, others last), file and line until there are
    ``most``. The sort is a top-k; findings are written out once, since a scan costs more than its findings."""
    from weftline.operators.graph import saved

    rank, place = severity_rank(), []
    if categories:
        place = [F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category")), F.lit(0)), F.lit(len(categories) + 1))]
    found = saved(found)
    # critical ones rank first, so that of the first ``most`` those that aren't critical are what is left for others
    rest = found.orderBy(rank, *place, "file", "line", "rule_id").limit(most).where(rank > 0)
    return found.where(rank == 0).unionByName(rest)


def ownership(blame: DataFrame) -> DataFrame:
    """author, lines, share (percent, 2 places), first and last date, from rows (file, line, author, date)."""
    per = blame.groupBy("author").agg(F.count(F.lit(1)).alias("lines"), F.min("date").alias("first"), F.max("date").alias("last"))
    total = per.agg(F.sum("lines").alias("total"))
    return per.join(F.broadcast(total)).select("author", "lines", F.round(100.0 * F.col("lines") / F.col("total"), 2).alias("share"), "first", "last")


def primary_owner(blame: DataFrame) -> DataFrame:
    """file, owner (most lines; ties by name) and share of its lines in percent."""
    per = blame.groupBy("file", "author").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", F.negative(F.ascii("author")).alias("_a"))).alias("best")
    top = per.groupBy("file").agg(best, F.sum("n").alias("total"))
    owner = per.join(top, "file").where(F.col("n") == F.col("best.n")).groupBy("file").agg(F.min("author").alias("owner"), F.round(100.0 * F.first("n") / F.first("total"), 2).alias("share"))
    return owner.select("file", "owner", "share")


def stale_lines(blame: DataFrame, today: str, months: int = 6) -> DataFrame:
    """Lines last changed more than ``months`` times 30 days before today, with their age in days."""
    age = F.datediff(F.lit(today).cast("date"), F.col("date"))
    return blame.withColumn("age_days", age).where(F.col("age_days") > months * 30)


def ages(blame: DataFrame, today: str) -> DataFrame:
    """mean, upper median, least and greatest age in days of all lines, and how many are fresh (to 60 days), aging (to 180) and stale."""
    aged = blame.select(F.datediff(F.lit(today).cast("date"), F.col("date")).alias("age")).where("age IS NOT NULL")
    counted = aged.agg(F.round(F.avg("age"), 2).alias("mean"), F.min("age").alias("least"), F.max("age").alias("greatest"), F.count_if(F.col("age") <= 60).alias("fresh"), F.count_if((F.col("age") > 60) & (F.col("age") <= 180)).alias("aging"), F.count_if(F.col("age") > 180).alias("stale"))
    return counted.crossJoin(F.broadcast(upper_median(aged, "age")))


def author_chunks(blame: DataFrame, size: int = 10) -> DataFrame:
    """Stretches of ``size`` lines with three or more authors: file, chunk, authors, level (high from five on)."""
    per = blame.groupBy("file", F.floor((F.col("line") - 1) / size).alias("chunk")).agg(F.count_distinct("author").alias("authors"))
    return per.where("authors >= 3").withColumn("level", F.when(F.col("authors") >= 5, "high").otherwise("medium"))


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """The middle value, of an even number the upper one: median. Values are range-partitioned; the counts of partitions, one row each,
    say which one holds it and at what place, and only that partition's values are numbered."""
    from weftline.operators.graph import saved

    ordered = saved(values.where(F.col(column).isNotNull()).select(F.col(column).alias("median")).repartitionByRange("median").select("median", F.spark_partition_id().alias("_part")))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", "n", F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    place = F.floor(F.col("total") / 2) - F.coalesce("before", F.lit(0))
    asked = before.where((place >= 0) & (place < F.col("n"))).select("_part", (place + 1).alias("place"))
    inside = ordered.join(F.broadcast(asked), "_part").groupBy("_part", "place", "median").agg(F.count(F.lit(1)).alias("n"))
    upto = inside.select("median", "place", F.sum("n").over(Window.partitionBy("_part").orderBy("median")).alias("upto"))
    return upto.where("upto >= place").agg(F.min("median").alias("median"))


def convention(names: DataFrame, group: str, name: str = "name") -> DataFrame:
    """The commonest naming style of each group with its share; ties by style."""
    style = F.when(F.col(name).rlike(r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"), "UPPER_SNAKE").when(F.col(name).rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), "snake_case").when(F.col(name).rlike(r"^[a-z]+[a-z0-9]*([A-Z][a-z0-9]*)+$"), "camelCase").when(F.col(name).rlike(r"^([A-Z][a-z0-9]+)+$"), "PascalCase").otherwise("other")
    n = names.groupBy(group, style.alias("style")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(group).agg(F.max_by("style", F.struct("n", F.expr("-ascii(style)"))).alias("style"), F.round(F.max("n") / F.sum("n"), 4).alias("share"))


def match_pairs(found: DataFrame, truth: DataFrame, near: int = 3) -> DataFrame:
    """Greedy one-to-one matching of findings (id, file, line, name) with known truths (id, file, line, name): found_id, truth_id. Candidates
    stand in the same file within ``near`` lines (a truth without a line fits any); equal names come first, then short distances, then ids.
    Rounds accept pairs that are the best of both sides, which is what taking the best pair again and again gives."""
    from weftline.operators.graph import saved

    f = found.select(F.col("id").alias("found_id"), "file", F.coalesce("line", F.lit(0)).alias("_line"), F.col("name").alias("_name"))
    t = truth.select(F.col("id").alias("truth_id"), "file", F.col("line").alias("_at"), F.col("name").alias("_called"))
    # lines of a file are dealt to stretches, so that a file's findings aren't paired with all its truths
    size = 2 * near + 1
    cells = F.when(F.col("_at").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.array_distinct(F.array(F.floor((F.col("_at") - near) / size), F.floor((F.col("_at") + near) / size))))
    placed = t.withColumn("_cell", F.explode(cells))
    asked = f.withColumn("_cell", F.explode(F.array(F.floor(F.col("_line") / size), F.lit(-1).cast("long"))))
    both = asked.join(placed, ["file", "_cell"]).withColumn("_gap", F.when(F.col("_at").isNull(), 0).otherwise(F.abs(F.col("_line") - F.col("_at")))).where(F.col("_gap") <= near)
    rank = F.struct((~F.coalesce(F.col("_name") == F.col("_called"), F.lit(False))).alias("other"), F.col("_gap").alias("gap"), "found_id", "truth_id").alias("rank")
    left, out = saved(both.select("found_id", "truth_id", rank).distinct()), None
    while not left.isEmpty():
        mine = left.groupBy("found_id").agg(F.min("rank").alias("rank"))
        best = left.groupBy("truth_id").agg(F.min("rank").alias("rank"))
        taken = saved(mine.join(best.select("rank"), "rank", "left_semi").select("found_id", F.col("rank.truth_id").alias("truth_id")))
        out = taken if out is None else out.unionByName(taken)
        left = saved(left.join(taken.select("found_id"), "found_id", "left_anti").join(taken.select("truth_id"), "truth_id", "left_anti"))
    return found.sparkSession.createDataFrame([], left.select("found_id", "truth_id").schema) if out is None else out


def match_truth(found: DataFrame, truth: DataFrame, near: int = 3) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 (4 places) of findings against known truths, as ``match_pairs`` matches them."""
    one = match_pairs(found, truth, near).agg(F.count(F.lit(1)).alias("tp"))
    counts = one.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("_f")))).crossJoin(F.broadcast(truth.agg(F.count(F.lit(1)).alias("_t"))))
    share = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 4)
    tp, f, t = (F.col(x) for x in ("tp", "_f", "_t"))
    return counts.select("tp", (f - tp).alias("fp"), (t - tp).alias("fn"), share(tp, f).alias("precision"), share(tp, t).alias("recall"), share(2 * tp, f + t).alias("f1"))


#: What a planned fix does with a rule's line: take it out, or take out this pattern (fixed values).
FIXES = {"debug-print": None, "debugger": None, "skipped-test": r"\.(skip|only)\b"}


def fix_plan(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Edits that would fix findings of FIXES: file, line, rule_id, before and after (null: the line goes). Nothing is applied."""
    kinds = F.create_map(*[F.lit(x) for p in FIXES.items() for x in (p[0], p[1] or "")])
    asked = found.where(F.col("rule_id").isin(*FIXES)).select("file", "line", "rule_id").withColumn("_cut", F.try_element_at(kinds, F.col("rule_id")))
    both = asked.join(lines.select("file", "line", "text"), ["file", "line"])
    return both.select("file", "line", "rule_id", F.col("text").alias("before"), F.when(F.col("_cut") != "", F.expr("regexp_replace(text, _cut, '')")).alias("after"))


def cvss_severity(vector: str) -> str | None:
    """Severity of a CVSS 3 base vector; None where it can't be read. Weights and steps are the standard's (fixed values)."""
    weights = {"AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62}, "C": {"H": 0.56, "L": 0.22, "N": 0.0}}
    try:
        m = dict(p.split(":") for p in vector.split("/") if ":" in p)
        changed = m["S"] == "C"
        pr = {"N": 0.85, "L": 0.68 if changed else 0.62, "H": 0.5 if changed else 0.27}[m["PR"]]
        iss = 1 - (1 - weights["C"][m["C"]]) * (1 - weights["C"][m["I"]]) * (1 - weights["C"][m["A"]])
        impact = 7.52 * (iss - 0.029) - 3.25 * (iss - 0.02) ** 15 if changed else 6.42 * iss
        ease = 8.22 * weights["AV"][m["AV"]] * weights["AC"][m["AC"]] * pr * weights["UI"][m["UI"]]
    except (KeyError, ValueError, AttributeError):
        return None
    score = 0.0 if impact <= 0 else min(10.0, (1.08 if changed else 1.0) * (impact + ease))
    score = -(-round(score * 100_000) // 10_000) / 10
    return "none" if score == 0 else "low" if score < 4 else "medium" if score < 7 else "high" if score < 9 else "critical"
