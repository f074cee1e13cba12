"""The methods against plain versions."""

import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from weftline.llm import contain, gbt, neardup, packing, quality, records, shared, suffixes, textscan, tokens, warc


def test_statistics_equal_plain_ones():
    rnd = random.Random(1)
    texts = ["", None, "a b c d e a b c d e", "x\n\nx\nx y\n x\ny x\n"] + ["".join(rnd.choice("ab \n#é") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    for limit in (1 << 20, 100):
        got = np.concatenate([textscan.statistics(b, o) for _, _, b, o in textscan.chunks(pa.array(texts, pa.string()), limit)])
        assert [tuple(g[:5]) for g in got] == [brute.base(t) for t in texts]


def test_trees_learn_and_keep_signs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.7)).astype(float)
    assert ((gbt.fit(x, y).score(x) > 0.5) == y).mean() > 0.97
    y = (x[:, 0] + rng.normal(0, 0.3, 3000) > 0.5).astype(float)
    model = gbt.fit(x, y, signs=[1, 0, 0])
    grid = np.repeat(x[:50], 40, 0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(model.margin(grid).reshape(50, 40), axis=1) >= -1e-12).all()
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]


def test_trees_score_as_a_walk_does():
    rng = np.random.default_rng(1)
    x, y = rng.random((500, 4)), rng.integers(0, 2, 500).astype(float)
    m = gbt.fit(x, y, trees=5)

    def walk(row):
        total = m.base
        for node in m.roots:
            while m.feature[node] >= 0:
                node = m.right[node] if row[m.feature[node]] > m.threshold[node] else m.left[node]
            total += m.value[node]
        return total

    assert np.allclose(m.margin(x), [walk(r) for r in x])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = __spark_entry__.queries()["op2_quality_classifier"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert rows.select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.97


def test_boundaries_are_the_best():
    from itertools import combinations

    rnd = random.Random(3)
    for _ in range(30):
        lengths = sorted(rnd.sample(range(50), rnd.randint(1, 8)))
        counts = [rnd.randint(1, 9) for _ in lengths]
        sums = [a * b for a, b in zip(lengths, counts, strict=True)]
        k = rnd.randint(1, 4)
        cost = lambda tops: sum(next(t for t in tops if t >= x) * n for x, n in zip(lengths, counts, strict=True))
        best = min(cost((*c, lengths[-1])) for r in range(min(k, len(lengths))) for c in combinations(lengths[:-1], r))
        assert cost(packing.boundaries(*map(np.array, (lengths, counts, sums)), k)) == best


def test_boundaries_break_ties_downwards():
    def plain(m, counts, k):
        c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(np.array(counts) * m)])
        best, back = [0] + [1 << 60] * len(m), []
        for _ in range(min(k, len(m))):
            steps = [min((best[i] + m[j - 1] * (c[j] - c[i]) - (s[j] - s[i]), i) for i in range(j)) for j in range(1, len(m) + 1)]
            best, came = [1 << 60, *(x for x, _ in steps)], [0, *(i for _, i in steps)]
            back.append(came)
        out, j = [], len(m)
        for came in reversed(back):
            out.append(m[j - 1])
            j = came[j]
        return out[::-1]

    rnd = random.Random(4)
    for _ in range(300):
        m = sorted(rnd.sample(range(rnd.choice((12, 60, 100_000))), rnd.randint(1, 12)))
        counts, k = [rnd.randint(1, rnd.choice((1, 3, 50))) for _ in m], rnd.randint(1, 6)
        assert packing.boundaries(np.array(m), np.array(counts), np.array(m) * np.array(counts), k) == plain(m, counts, k)


def test_long_texts_get_boundaries_of_their_own(spark):
    lengths = [5000, 5001, 5002, 9000, 9001]
    rows = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long"), buckets=5).collect()
    assert sorted((r.length, r.bucket_length) for r in rows) == [(n, n) for n in lengths]


def test_token_lengths(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, docs = Tokenizer.from_file(path), shared.table(spark, sf_dir, "documents").limit(40)
    got = {r.doc_id: r.length for r in packing.token_lengths(docs, path).collect()}
    assert got == {r.doc_id: len(whole.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}


def test_crc32c_and_frames():
    def crc(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert crc(b"123456789") == 0xE3069283
    rnd = random.Random(0)
    payloads = [bytes(rnd.randrange(256) for _ in range(n)) for n in (4, 9, 63, 64, 65, 128, 200, 1000, 5000)]
    for p in payloads:
        c = crc(p)
        assert int(records.masked_crc32c(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0]) == (((c >> 15) | (c << 17 & 0xFFFFFFFF)) + 0xA282EAD8) & 0xFFFFFFFF
    assert records.unframe(records.frame(payloads)[0]) == payloads


def test_encoder_equals_library(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, own = Tokenizer.from_file(path), tokens.encoder(path)
    rnd = random.Random(2)
    parts = ["a", "b", " ", " ", "\n", "'", "'", "s", "t", "m", "r", "e", "l", "v", "1", "é", "#", "ll", "\t", "日本", "\u00a0", "²", "ß", "<|endoftext|>", "<|", "don't", "\x1c", "\x85", "\u2003", "\u3000", "\u2019", "\U0001f600", "e\u0301", "\u200b", "\u180e"]
    texts = ["", *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(4000))]
    for chars in (tokens.CHUNK_CHARS, 50):
        monkeypatch.setattr(tokens, "CHUNK_CHARS", chars)
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert ids == np.array(whole.encode(text, add_special_tokens=False).ids, own.dtype).tobytes(), text
    long = " ".join(rnd.choice(("word", "it's", "日本", "\n\n", "42")) for _ in range(20_000))
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 8192)
    assert len(list(tokens.pieces(long))) > 5
    assert own.encode([long]) == [np.array(whole.encode(long, add_special_tokens=False).ids, own.dtype).tobytes()]


def test_pretokens_of_equal_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr(tokens, "mix", lambda x: x * 0)
    cp = np.frombuffer("ab abc ab xy abc".encode("utf-32-le"), np.uint32)
    starts = np.array([0, 2, 6, 9, 12])
    one, group = tokens.groups(cp, starts, np.append(starts[1:], len(cp)))
    text = [cp[s:e].tobytes() for s, e in zip(starts, [*starts[1:], len(cp)], strict=True)]
    assert [text[one[g]] for g in group] == text


def test_deep_shallow_sort():
    rnd, rng = random.Random(2), np.random.default_rng(0)
    buf = np.frombuffer(("".join(rnd.choice("ab") for _ in range(300)) * 4 + "c" * 500).encode(), np.uint8)
    at = np.arange(0, len(buf) - 200)
    group = rng.integers(0, 3, len(at))
    order, same = suffixes.deep_shallow(buf, at, group)
    text = lambda i: (group[i], buf[at[i] : at[i] + 200].tobytes())
    assert [text(i) for i in order] == sorted(text(i) for i in range(len(at)))
    assert all(bool(same[j]) == (j > 0 and text(order[j]) == text(order[j - 1])) for j in range(len(order)))


def test_removal_equals_plain_one(spark):
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    base = [noise(400) for _ in range(6)]
    texts = [*base, base[0][100:390] + "zz" + base[1][:250], "ab" * 300, "ab" * 150, "q" * 199, "q" * 199, "q" * 200, "x" + "q" * 200] + [noise(rnd.randint(0, 150)) + base[4][:230] + noise(rnd.randint(0, 150)) for _ in range(30)]
    got = suffixes.removal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute.removal(texts)


@pytest.mark.parametrize(("hot", "places"), [(0, 8), (1, 8), (3, 16), (3, 1), (8, 137)])
def test_removal_with_hot_anchors_equals_plain_one(spark, monkeypatch, hot, places):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "PLACES", places)
    monkeypatch.setattr(suffixes, "HELD", 50 * hot)
    rnd = random.Random(hot * 100 + places)
    noise = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    passage, other = noise(260), noise(230)
    texts = [noise(rnd.randint(0, 250)) + passage + noise(rnd.randint(0, 250)) for _ in range(20)] + [noise(60) + other[:210] + noise(60) for _ in range(6)]
    texts += [passage[:225] + "z" + noise(200), passage[30:], "q" * 450, "ab" * 200, texts[0], texts[0][5:], noise(300)]
    schema = "doc_id long, text string"
    got = suffixes.removal(spark.createDataFrame(list(enumerate(texts)), schema).repartition(3)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute.removal(texts)


def test_hot_anchors_move_texts_no_second_time(spark, monkeypatch):
    rnd = random.Random(3)
    noise = lambda n: "".join(chr(rnd.randint(35, 126)) for _ in range(n))
    passage = noise(230)
    texts = [noise(4000) + (passage if i % 4 == 0 else "") + noise(4000) for i in range(40)]
    plain = sorted(brute.removal(texts))
    docs = shared.stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)

    def written():
        found = stages()
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = []
        for hot in (1000, 3):
            monkeypatch.setattr(suffixes, "HOT", hot)
            before = max(written())
            got = suffixes.removal(docs).collect()
            assert sorted(tuple(r)[1:] for r in got) == plain
            moved.append(sum(size for stage, size in written().items() if stage > before))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved[1] - moved[0] < sum(map(len, texts)) / 3


def test_periodic_text_is_few_runs(spark):
    rnd = random.Random(9)
    for word in ("a", "ab", "abcdefghi" * 9):
        text = word * (1_000_000 // len(word))
        docs = spark.createDataFrame([(1, text), (2, "x" + word * (4000 // len(word)) + "y"), (3, "".join(rnd.choice("abc ") for _ in range(900)))], "doc_id long, text string")
        assert suffixes._run_rows(suffixes._keyed(docs)).count() < 1000
        got = suffixes.removal(docs).orderBy("doc_id").collect()
        assert [tuple(r)[1:] for r in got[1:]] == brute.removal([text[:8000], *(r.text for r in docs.orderBy("doc_id").collect()[1:])])[1:]
        assert (got[0].n_removed, got[0].n_spans) == (len(text), 1)


def test_hot_keys_are_joined_in_shares(spark):
    keys = [7] * 5000 + list(range(3000))
    rows = spark.createDataFrame([(a, i, i % 50) for i, a in enumerate(keys)], "anchor long, k long, s int")
    table = shared.stored(rows.groupBy("anchor").count().withColumnRenamed("count", "found").where("found > 1 or anchor < 1500").withColumn("extra", F.col("anchor") * 2))
    got = suffixes._joined(rows, table, ["anchor"])
    assert sorted(map(tuple, got.collect())) == sorted((a, i, i % 50, 2 * a) for i, a in enumerate(keys) if a < 1500)
    assert suffixes._joined(rows, table, ["anchor"], "left_semi").count() == got.count()
    assert suffixes._joined(rows, table.where("false"), ["anchor"]).count() == 0


def test_marks_find_every_hot_anchor(spark):
    rng = np.random.default_rng(4)
    hot, other = (rng.integers(-(1 << 63), (1 << 63) - 1, n) for n in (3000, 20000))
    words = suffixes._marks(spark.createDataFrame([(int(x),) for x in hot], "anchor long"))
    assert suffixes._is_marked(words, hot.view(np.uint64)).all() and suffixes._is_marked(words, other.view(np.uint64)).mean() < 0.1
    assert not suffixes._is_marked(suffixes._marks(spark.createDataFrame([], "anchor long")), other.view(np.uint64)).any()


def test_posterior_bounds():
    from math import comb

    for n, m in neardup.least_matches(0.8, 1e-4):
        grid = np.linspace(0, 1, 20001)[1:-1]
        tail = lambda k: (d := grid**k * (1 - grid) ** (n - k))[grid >= 0.8].sum() / d.sum()  # noqa: B023,E731
        assert tail(m) >= 0.9e-4 and tail(m - 1) < 1.1e-4 and comb(n, m)


def plain_classes(rows):
    sets, parent = [brute.shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = {}
    for i, s in enumerate(sets):
        for g in s:
            having.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in having[g] if j < i).items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_join_equals_plain_one(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(words) for _ in range(150)]

    def edited(n):
        b = list(base)
        for _ in range(n):
            b[rnd.randrange(len(b))] = rnd.choice(words)
        return " ".join(b)

    rows = [(i, edited(rnd.randint(0, 8))) for i in range(200)] + [(1000 + i, " ".join(rnd.choice(words) for _ in range(30))) for i in range(20)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == plain_classes(rows)


def test_warc_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>text {i}</p>") for i in range(20)], "page_id long, url string, html string")
    source = warc.derive(warc.responses(pages)).repartition(2)
    files = warc.write(source, str(tmp_path)).collect()
    read = [r for f in files for r in warc.parse(open(f.path, "rb").read())]
    assert Counter((r["warc-type"], r["block"]) for r in read) == Counter((r.type, r.block) for r in source.collect())


def test_pipeline_equals_plain_stages(spark, sf_dir):
    docs = shared.table(spark, sf_dir, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    judged = {r.doc_id for r in quality.judge(docs, quality.train(docs, shared.table(spark, sf_dir, "labels"), signs=quality.RULE_SIGNS)).collect() if r.kept}
    rows = {d: t for d, t in rows.items() if d in judged}
    cls = plain_classes(sorted(rows.items()))
    rows = {d: t for d, t in rows.items() if cls[d] == d}
    ids = sorted(rows)
    raw = [rows[d].encode() for d in ids]
    count = Counter(r[i : i + 200] for r in raw for i in range(len(r) - 199))
    left = {}
    for d, r in zip(ids, raw, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if count[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        left[d] = bytes(b for b, g in zip(r, gone, strict=True) if not g).decode(errors="ignore")
    items = [brute.shingles(r.text) for r in shared.table(spark, sf_dir, "benchmark").collect()]
    clean = {d: t for d, t in left.items() if t and not any(len(i & s) / len(i) >= 0.8 for s in [brute.shingles(t)] for i in items if i)}
    got = {r.doc_id: r.length for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {d: len(brute.words(t)) for d, t in clean.items()}


@pytest.mark.parametrize("name", sorted(__spark_entry__.llm_entries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    result = c.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(tuple(map(str, (r[names.index(n)] for n in sorted(names)))) for r in result.fetchall())
    df = __spark_entry__.queries()[name](spark, sf_dir)
    assert sorted(tuple(map(str, (r[n] for n in sorted(names)))) for r in df.collect()) == want


def test_executors_need_no_copy_of_the_package(tmp_path, sf_dir):
    """Every query over workers whose path lacks the repository."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
def away(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_pydict({{"found": [importlib.util.find_spec("weftline") is not None]}})
assert not spark.range(1).mapInArrow(away, "found boolean").first().found
import __spark_entry__
docs = spark.read.parquet({sf_dir!r} + "/documents.parquet").count()
for name in ("op2_quality_classifier", "op5_benchmark_leaks", "op6_binary_records", "op7_quality_rules"):
    assert __spark_entry__.queries()[name](spark, {sf_dir!r}).count() in range(1, docs + 1), name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    session = lambda master, named: SimpleNamespace(conf={"spark.checkpoint.dir": named} if named else {}, sparkContext=SimpleNamespace(master=master))
    assert shared.shared_dir(session("spark://a", "hdfs://b")) == "hdfs://b" and shared.shared_dir(session("local[4]", None))
    for master in ("spark://a", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError):
            shared.shared_dir(session(master, None))
