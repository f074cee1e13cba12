from weftline import plugins
from weftline.operators import findings, formats, graph
from weftline.sources import artifacts


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_error_trace(spark):
    edges = frame(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("x", "a")], "source_id string, target_id string")
    got = graph.error_trace(edges, frame(spark, [("a",)], "node_id string"), frame(spark, [("c",)], "node_id string"))
    assert {(r.node_id, r.depth, r.handled) for r in got.collect()} == {("b", 1, False), ("x", 1, False), ("c", 2, True)}


def test_cycles_and_members(spark):
    got = graph.cycle_severity(frame(spark, [(1, "a"), (2, "a -> b"), (2, "tests/x -> tests/y")], "length int, cycle string"))
    assert [r.severity for r in got.collect()] == ["info", "warning", "info"]
    edges = frame(spark, [("a", "b"), ("b", "c")], "source_id string, target_id string")
    assert [tuple(r)[:2] for r in graph.within(edges, frame(spark, [("a",), ("b",)], "node_id string")).collect()] in ([("a", "b")], [("b", "a")])


def test_receivers_and_messages(spark):
    calls = frame(spark, [(1, "f", "x.run"), (2, "f", "y.run")], "call_id int, file string, to_fn string")
    types = frame(spark, [("f", "x", "T")], "file string, variable string, type string")
    methods = frame(spark, [("T", "run", "n9", 9), ("T", "run", "n3", 3)], "type string, name string, node_id string, line int")
    assert [tuple(r) for r in graph.receivers(calls, types, methods).collect()] == [(1, "n3")]
    got = graph.message_calls(frame(spark, [("js", "getUser")], "source_id string, command string"), frame(spark, [("get_user", "rs")], "name string, node_id string"))
    assert [tuple(r) for r in got.collect()] == [("js", "rs", 0.9)]


def test_artifacts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.wasm").write_bytes(b"\0asm\1\0\0\0")
    (tmp_path / "a" / "t.txt").write_text("hello")
    assert [r.kind for r in artifacts.binaries(spark, str(tmp_path / "a")).collect()] == ["wasm"]
    report = frame(spark, [("p", "SF:a.py\nDA:1,2\nDA:2,0\nend_of_record\nSF:b.py\nDA:1,1\nend_of_record\n")], "path string, content string")
    assert {(r.file, r.percent) for r in artifacts.coverage_percent(artifacts.coverage_lines(report)).collect()} == {("a.py", 50.0), ("b.py", 100.0)}
    table = frame(spark, [("k", 1)], "k string, v long")
    artifacts.export_snapshot({"t": table}, str(tmp_path / "s"))
    back = artifacts.import_snapshot(spark, str(tmp_path / "s"), "t", "k string, v long", frame(spark, [("k", 2), ("m", 3)], "k string, v long"), ["k"])
    assert sorted(tuple(r) for r in back.collect()) == [("k", 2), ("m", 3)]


def test_truth_and_cvss(spark):
    schema = "id long, file string, line long, name string"
    found = frame(spark, [(0, "a", 10, "x"), (1, "a", 11, "y"), (2, "b", 1, "z")], schema)
    truth = frame(spark, [(0, "a", 11, "x"), (1, "a", None, "q"), (2, "c", 1, "w")], schema)
    assert tuple(findings.match_truth(found, truth).first()) == (2, 1, 1, 0.6667, 0.6667, 0.6667)
    assert tuple(findings.match_truth(found.where("false"), truth).first()) == (0, 0, 3, 0.0, 0.0, 0.0)
    assert findings.cvss_severity("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H") == "critical"
    assert findings.cvss_severity("CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N") == "low" and findings.cvss_severity("x") is None


def test_matching_is_greedy(spark):
    import random

    rnd = random.Random(5)
    row = lambda k: (k, rnd.choice("ab"), rnd.choice([None, *range(1, 30)]), rnd.choice("xyz"))
    found, truth = [row(k) for k in range(40)], [row(k) for k in range(35)]
    pairs = sorted((f[3] != t[3], 0 if t[2] is None else abs((f[2] or 0) - t[2]), f[0], t[0]) for f in found for t in truth if f[1] == t[1] and (t[2] is None or abs((f[2] or 0) - t[2]) <= 3))
    want, used_f, used_t = set(), set(), set()
    for _, _, f, t in pairs:
        if f not in used_f and t not in used_t:
            used_f.add(f)
            used_t.add(t)
            want.add((f, t))
    schema = "id long, file string, line long, name string"
    assert {tuple(r) for r in findings.match_pairs(frame(spark, found, schema), frame(spark, truth, schema)).collect()} == want


def test_envelope_pages_and_budgets():
    items = [{"k": k, "severity": s} for k, s in enumerate(["low", "critical", None, "high"] * 10)]
    page = formats.page(items, "x", 5, 38)
    assert [i["k"] for i in page["items"]] == [38, 39] and not page["has_more"] and page["stats"] == {"total": 40, "shown": 2} and formats.page(items, "x", 5)["has_more"]
    assert [len(formats.envelope(items, "x", max_tokens=n)["items"]) for n in (10_000, 120, 40, 1)] == [40, 10, 3, 0]
    order = [i["severity"] for i in formats.sorted_items(items[:4], "severity")]
    assert order == ["critical", "high", "low", None] and [i["severity"] for i in formats.sorted_items(items[:4], "severity", least_severe_first=True)] == ["low", "high", "critical", None]
    assert "<td>a&lt;b</td>" in formats.dashboard("t", {"score": 1}, [{"severity": "low", "file": "a<b", "line": None}])


def test_results_are_kept_for_a_time(spark):
    now, made = [0.0], []
    cache = plugins.ResultCache(spark, seconds=10, clock=lambda: now[0])
    ask = lambda key: cache.get(key, lambda: made.append(key) or frame(spark, [(len(made),)], "n int")).first().n
    assert [ask("scan:a"), ask("scan:a"), ask("list:b")] == [1, 1, 2]
    now[0] = 10
    assert ask("scan:a") == 3 and cache.drop("scan:") == 1 and ask("scan:a") == 4 and set(cache.entries) == {"scan:a", "list:b"}


def test_engine_and_hook(spark):
    engine = plugins.Engine("long", analyse=lambda files: files.where("n > 1"), select=lambda files: files.where("n < 5"), build=lambda found: found.selectExpr("count(*) AS n"))
    assert engine.run(frame(spark, [(k,) for k in range(9)], "n int")).first().n == 3
    seen = []
    hook = plugins.EditHook(seen.append)
    for path in "abc":
        hook.edited(path)
    hook.close()
    assert sorted(seen) == ["a", "b", "c"]


def test_planned_fixes(spark):
    lines = frame(spark, [("f", 1, "x"), ("f", 2, "print(x)"), ("f", 3, "describe.skip('a', f)")], "file string, line long, text string")
    assert {(r.line, r.rule_id, r.after) for r in findings.fix_plan(findings.scan(lines), lines).collect()} == {(2, "debug-print", None), (3, "skipped-test", "describe('a', f)")}
