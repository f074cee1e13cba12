"""Ties, repeated rows, clashing column names, and what the join finds on whole tables."""

from collections import Counter

import brute
import pytest
from test_methods import plain_classes

from weftline.llm import contain, licences, neardup, packing, pagetext, suffixes, warc


def test_packing_of_ties(spark):
    rows = [(k % 3 if k % 4 else None, 7) for k in range(40)] + [(5, 7)] * 10 + [(5, 9)] * 3
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long").repartition(3), buckets=2, budget=21).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter(rows)
    places = {(r.bucket, r.batch, r.slot) for r in got}
    assert len(places) == len(rows)
    for bucket, n, fit in ((0, 50, 3), (1, 3, 2)):
        assert {(b, s) for k, b, s in places if k == bucket} == {(i // fit, i % fit) for i in range(n)}
    inside = [[r.doc_id for r in sorted(got, key=lambda r: (r.batch, r.slot)) if r.bucket == b] for b in (0, 1)]
    assert all(ids == sorted(ids, key=lambda x: (x is not None, x or 0)) for ids in inside)


def test_links_do_not_depend_on_pivots(spark):
    """The same texts under other ids, in other partitions: the same classes and numbers of links."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:k] + ["x"] + words[k + 1 :]) for k in range(0, 60, 2)] + [" ".join(words)] * 3 + ["apart from all others in every word"]
    one = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    turned = [(len(texts) - 1 - i, t) for i, t in enumerate(texts)]
    two = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(spark.createDataFrame(turned, "doc_id long, text string").repartition(5)).collect()}
    assert [one[i][1] for i in range(len(texts))] == [two[len(texts) - 1 - i][1] for i in range(len(texts))]
    groups = lambda got: Counter(c for c, _ in got.values()).values()
    assert sorted(groups(one)) == sorted(groups(two))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_no_link_of_the_tables_is_lost(spark, sf):
    """Recall 1.0 of pairs at 0.8 or more, over all documents: classes and links are those of comparing all pairs."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.op3_ngram_jaccard_join(spark, f"/root/testdata/{sf}").collect()}
    copies = Counter(t for _, t in rows)
    sets, having, near_texts = {t: brute.shingles(t) for t in copies}, {}, Counter()
    for t, s in sets.items():
        near = Counter(j for g in s for j in having.get(g, ()))
        for j, n in near.items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8:
                near_texts[t] += 1
                near_texts[j] += 1
        for g in s:
            having.setdefault(g, []).append(t)
    classes = plain_classes(rows)
    assert got == {d: (classes[d], near_texts[t] + copies[t] - 1) for d, t in rows} and sum(near_texts.values()) > 0


def test_chance_of_sharing_no_bucket():
    assert (1 - 0.8**neardup.ROWS) ** neardup.BANDS < 1 / 300_000


CLASHING = "record_id int, refers_to int, block int, body int, type int, date int, _text int, _payload int, content int, n_chars int, path int, h int, w int"


def test_clashing_columns(spark):
    n = len(CLASHING.split(","))
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", *range(n))], f"page_id long, url string, html string, {CLASHING}")
    assert {r.block for r in warc.derive(warc.responses(pages)).where("type = 'conversion'").collect()} == {"x"}
    assert tuple(pagetext.extract(pages).first()) == (1, "u", "x", 1)
    docs = spark.createDataFrame([(1, "Released under the MIT License.", *range(n))], f"doc_id long, text string, {CLASHING}")
    assert licences.scan(docs).first().licence == "MIT"
    names = "id long, x1 long, x2 long, k long, copies long, size long, root long, hash_one long, hash_two long, whole_row long, wanted long, s long, n long, anchor long, band long"
    twice = spark.createDataFrame([(i, "one two three four five six", *range(15)) for i in (1, 2)], f"doc_id long, text string, {names}")
    kept = neardup.one_of_each(twice)
    assert kept.columns == twice.columns and [tuple(r) for r in kept.collect()] == [(1, "one two three four five six", *range(15))]
    assert neardup.classes(twice).count() == 2 and suffixes.removal(twice).count() == 2
    bench = spark.createDataFrame([(9, "one two three four five six", 3)], "item_id long, text string, doc_id int")
    assert contain.find(twice, bench).count() == 2 and contain.clean(twice, bench).count() == 0
