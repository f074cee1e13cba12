"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns through every operator and stage."""

import hashlib
import struct
import zlib

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import contain, licences, neardup, packing, pagetext, quality, records, suffixes, warc

LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
TEXTS = [None, "", " ", "one", "a b c d", "a b c d", "the same text of six words", "the same text of six words", "x\n" * 50, LONG, LONG + " tail", "é ß 日本 語 , . " * 40, "Released under the MIT License.", "a\tb\x0bc\x1fd e f g h i j k"]
IDS = [1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, None, 12, None]
#: Names that operators use inside.
CLASHING = "k long, tk int, v string, node string, spans string, repeated_spans string, key_id string, key_text string, anchor long, score double, kept boolean, bucket int, length long, position long, held_out boolean, sig binary, Root string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
NONE = (None,) * len(CLASHING.split(","))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None, None, *NONE) for i, t in zip(IDS, TEXTS, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (9, 1), (12, 0)], "doc_id long, quality int")


def key(x):
    return tuple((v is not None, str(v)) for v in x)


def test_quality(docs, none, labels):
    model = quality.train(docs, labels)
    got = quality.classify(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in IDS if i is not None}
    assert quality.classify(none, quality.train(none, labels.limit(0))).count() == 0
    rules = quality.judge(docs, model).collect()
    want = sorted(((i, *brute.base(t)) for i, t in zip(IDS, TEXTS, strict=True)), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules), key=key) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in rules)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rules)


def test_near_duplicates(docs, none):
    got = neardup.classes(docs).collect()
    assert len(got) == len(TEXTS)
    cls = {r.doc_id: (r.class_id, r.n_links) for r in got if r.doc_id is not None}
    assert cls[5] == cls[6] == (5, 1) and cls[7] == (7, 1) and cls[9][0] == cls[10][0] == 9 and cls[1] == (1, 0) and cls[2] == (2, 0) and cls[3] == (3, 0)
    assert neardup.classes(none).count() == 0
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "9", "None", "12", "None"])


def test_page_text(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 2), (3, "u", "<p>a  b&amp;c<p>d", 3), (3, "u", "<p>a  b&amp;c<p>d", 3), (5, "u", "no tags", 4), (6, "u", "<div><" + "p>x" * 5000, 5)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in pagetext.extract(pages).collect()), key=key)
    assert [g for g in got if g[0] != 6] == sorted([(1, "", 0), (None, "", 0), (3, "a b&c\nd", 7), (3, "a b&c\nd", 7), (5, "no tags", 7)], key=key)
    assert pagetext.extract(pages.limit(0)).count() == 0


def test_benchmark(spark, docs, none):
    bench = spark.createDataFrame([(1, "the same text of six words", 0), (None, "a b c d", 0), (2, None, 0), (3, "", 0), (4, " ".join(LONG.split()[20_000:20_040]), 0), (4, " ".join(LONG.split()[20_000:20_040]), 0)], "item_id long, text string, doc_id int")
    want = {(7, 1), (5, None), (6, None), (9, 4), (10, 4)}
    got = contain.find(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == 6
    assert {(r.doc_id, r.item_id) for r in contain.find(docs, bench, block_bytes=200).collect()} == want
    assert contain.find(docs, bench.limit(0)).count() == 0 and contain.find(none, bench).count() == 0
    assert contain.clean(docs, bench).count() == len(TEXTS) - 6


def test_records(spark, docs, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    shards = records.write(docs, str(tmp_path / "r"), path, partitions=3)
    got = []
    for s in shards:
        for k in range(s["n_docs"]):
            doc, ids = records.read_one(str(tmp_path / "r"), s["shard"], k)
            got.append((doc, ids.tolist()))
    want = sorted(zip(IDS, TEXTS, strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert got == [(i, [*coder.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in want]
    data = (tmp_path / "r" / f"{shards[0]['shard']}.rec").read_bytes()
    with pytest.raises(ValueError):
        records.unframe(data[:-5] + bytes([data[-5] ^ 1]) + data[-4:])
    assert struct.unpack_from("<Q", data)[0] + 16 <= len(data)
    assert records.write(none, str(tmp_path / "e"), path) == []


def test_licences(docs, none):
    got = licences.scan(docs).collect()
    assert len(got) == len(TEXTS) and {r.doc_id: r.licence for r in got if r.licence} == {12: "MIT"}
    assert licences.scan(none).count() == 0


def test_suffixes(docs, none):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal(docs).collect()), key=key)
    assert got == sorted(((i, *b) for i, b in zip(IDS, brute.removal(TEXTS), strict=True)), key=key)
    assert suffixes.removal(none).count() == 0
    left = suffixes.without_repeats(docs)
    assert left.columns == docs.columns and "tail" in left.where("doc_id = 10").first().text and left.where("doc_id = 9").count() == 0


def test_packing(docs, none):
    got = packing.pack(packing.word_lengths(docs), buckets=3, budget=64).collect()
    assert len(got) == len(TEXTS)
    assert all(r.length <= r.bucket_length for r in got) and len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)
    assert packing.pack(packing.word_lengths(none)).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (3, "http://a/b", "<title>t</title>a&amp;b<script>no</script><br>c")], "page_id long, url string, html string")
    rows = [r.asDict() for r in warc.derive(warc.responses(pages)).collect()]
    assert len(rows) == 8 and {r["block"] for r in rows if r["type"] == "conversion"} == {"", "x", "a&b\nc"}
    for r in rows:
        back = warc.parse(warc.encode(r))[0]
        assert back["warc-refers-to"] == r["refers_to"] and back["block"] == r["block"] and back["warc-block-digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_stages(spark, docs, none, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf_dir)
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert stage(spark, docs, sf_dir).columns == docs.columns
