"""Quality classifier (op2) and quality rules (op7): gradient-boosted trees over document statistics.

Both learn from a bounded sample of labelled documents, at most ``MAX_TRAINING_ROWS``, those whose hashed id is smallest; every
document is scored over its whole text. Scoring is one map over the documents: nothing is shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import gbt, shared, textscan

#: Bound of the training sample; its ids are broadcast and its statistics (17 numbers a row) are collected.
MAX_TRAINING_ROWS = 20_000

RATIOS = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_word_share", "digit_share", "upper_share", "punctuation_share", "beyond_ascii_share", "same_word_share", "distinct_word_share", "short_word_share", "repeat_line_share", "shout_share", "line_words"]

#: Signs for the quality rules: more of these is never better.
RULE_SIGNS = {"symbol_share": -1, "dup_line_share": -1, "repeat_word_share": -1, "same_word_share": -1, "shout_share": -1, "short_word_share": -1}


def features(stats: np.ndarray) -> np.ndarray:
    """Shares and means from textscan.STATS; an empty text has zeros."""
    s = dict(zip(textscan.STATS, stats.T.astype(float), strict=True))
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_digits"] / chars, s["n_upper"] / chars, s["n_punct"] / chars,
        s["n_beyond_ascii"] / chars, s["n_same_word"] / words, s["n_distinct_words"] / words, s["n_short_words"] / words, s["n_repeat_lines"] / lines, s["n_shout"] / words, s["n_words"] / lines,
    ], 1)


def _stats_of(texts: pa.Array):
    for first, rows, buf, offs in textscan.chunks(texts):
        yield first, rows, textscan.statistics(buf, offs)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", signs: dict[str, int] | None = None, max_rows: int = MAX_TRAINING_ROWS, **options) -> gbt.Trees:
    """Fit trees on labelled documents whose crc32(doc_id as text) mod 3 is not 1.

    Rows with a null id or label are left out; an id with several labels counts with the smallest; repeated rows of a document
    count as one. With no labelled rows the model gives a constant.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (shared.crc_mod3() != 1))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(chosen), "_id")

    def work(batch):
        y = np.asarray(batch.column(2).cast(pa.int32()))
        ids = batch.column(0)
        for first, rows, stats in _stats_of(batch.column(1)):
            yield {"id": ids.slice(first, rows), "y": y[first : first + rows], "stats": pa.array(list(stats), pa.list_(pa.int64()))}

    got = shared.by_batch(texts.select("_id", "_text", "_y"), work, f"id {dict(texts.dtypes)['_id']}, y int, stats array<bigint>").toArrow()
    stats = np.asarray(pc.list_flatten(got.column("stats").combine_chunks())).reshape(-1, len(textscan.STATS))
    # in an order of its own, whatever the partitions; repeated rows of a document once
    rows = np.unique(np.column_stack([np.array([zlib.crc32(str(i).encode()) for i in got.column("id").to_pylist()], np.int64), np.asarray(got.column("y"), np.int64), stats]), axis=0)
    y, stats = rows[:, 1], rows[:, 2:]
    return gbt.fit(features(stats), y.astype(float), [(signs or {}).get(f, 0) for f in RATIOS], **options)


def classify(docs: DataFrame, model: gbt.Trees) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (a null or empty text is scored as an empty one)."""
    model_b = shared.sent(docs.sparkSession, model)

    def work(batch):
        for first, rows, stats in _stats_of(batch.column(1)):
            score = model_b().score(features(stats))
            yield {"doc_id": batch.column(0).slice(first, rows), "held_out": batch.column(2).slice(first, rows), "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    rows = docs.select("doc_id", "text", (shared.crc_mod3() == 1).alias("held_out"))
    return shared.by_batch(rows, work, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def judge(docs: DataFrame, model: gbt.Trees, at: float = 0.5) -> DataFrame:
    """Rule statistics, base_failed and kept of every row of docs; a null text has no words, so that it fails the base rules."""
    model_b = shared.sent(docs.sparkSession, model)

    def work(batch):
        for first, rows, stats in _stats_of(batch.column(1)):
            failed, kept = verdict(stats, model_b(), at)
            yield {"doc_id": batch.column(0).slice(first, rows)} | {c: stats[:, textscan.STATS.index(c)] for c in BASE} | {"base_failed": failed, "kept": kept}

    rows = docs.select("doc_id", "text")
    return shared.by_batch(rows, work, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def verdict(stats: np.ndarray, model: gbt.Trees, at: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    failed = (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])
    return failed, ~failed & (model.score(features(stats)) >= at)


def keep_good(docs: DataFrame, model: gbt.Trees, at: float = 0.5) -> DataFrame:
    """The rows of docs that the quality rules keep, with all their columns. The text is judged where it stands, without a join."""
    model_b = shared.sent(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.names.index("text"))
            kept = [verdict(stats, model_b(), at)[1] for _, _, stats in _stats_of(text)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return classify(docs, train(docs, shared.table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return judge(docs, train(docs, shared.table(spark, sf_dir, "labels"), signs=RULE_SIGNS))
