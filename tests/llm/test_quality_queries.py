"""The quality queries against plain measures, plain training rows and a walk down the trees."""

import zlib

import brute
import numpy as np
import pytest

from weftline.llm import gbt, quality


@pytest.fixture(scope="module")
def plain(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            labels[r.doc_id] = min(r.quality, labels.get(r.doc_id, 1))
    rows = {d: brute.features(t) for d, t in docs.items()}
    known = sorted(set(labels) & set(rows))
    x, y = np.array([rows[d] for d in known]), np.array([labels[d] for d in known], float)
    models = {name: gbt.fit(x, y, [signs.get(f, 0) for f in quality.RATIOS]) for name, signs in (("op2", {}), ("op7", quality.RULE_SIGNS))}
    return sf, docs, {name: {d: brute.walk(m, r) for d, r in rows.items()} for name, m in models.items()}


def test_classifier(spark, plain):
    sf, docs, scores = plain
    got = {r.doc_id: r for r in quality.op2_quality_classifier(spark, sf).collect()}
    assert set(got) == set(docs)
    for d, r in got.items():
        assert r.score == pytest.approx(scores["op2"][d], abs=1e-9) and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1), d


def test_rules(spark, plain):
    sf, docs, scores = plain
    got = {r.doc_id: r for r in quality.op7_quality_rules(spark, sf).collect()}
    assert set(got) == set(docs)
    for d, r in got.items():
        base = brute.base(docs[d])
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base and r.base_failed == failed, d
        assert r.kept == (not failed and scores["op7"][d] >= 0.5), d
    assert 0 < sum(r.kept for r in got.values()) < len(got)


def test_scores_follow_the_signs(spark, plain):
    """Of a feature with a sign -1 more never raises the verdict of the rules, whatever the other features are."""
    sf = plain[0]
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), signs=quality.RULE_SIGNS)
    rows = np.array([brute.features(t) for t in list(plain[1].values())[:40]])
    for name, sign in quality.RULE_SIGNS.items():
        f = quality.RATIOS.index(name)
        grid = np.repeat(rows, 30, 0)
        grid[:, f] = np.tile(np.linspace(0, 1, 30), len(rows))
        assert (sign * np.diff(model.margin(grid).reshape(len(rows), 30), axis=1) >= -1e-12).all(), name
