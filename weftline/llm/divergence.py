"""Source divergence audit: how far the terms of a language's sources lie from each other and from the language.

Terms are runs of ASCII letters and characters beyond ASCII, A to Z lower-cased. Every task adds what it sees to a count-min sketch of document
frequencies; the sketches are merged, and terms whose merged estimate, which is never too low, stays below the least frequency are left out
before anything is shuffled. What survives is counted exactly, term by term. Shares are whole billionths with add-five smoothing:
1 + floor(10**9 (count + 5) / (N + 5 V)), found by long division, exact below nine million billion terms.

Distances between sources are summed by blocks of terms and of sources: a task holds a sparse block as a small matrix, in which a source
without a term has its smoothed share, and gives one number for each pair of its sources.

Null text, lang and source count as empty strings; a source whose texts have no terms is a group of its own, with count 0 for every term; equal
rows count each; an empty table gives no rows. A text of any length is read in pieces that end between terms.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import shared, textscan

#: Documents of its language that a kept term stands in, at least; ranks of the terms listed; smoothing; shares count in such parts.
LEAST_DOCS, RANKS, SMOOTH, WHOLE = 30, 50, 5, 1_000_000_000
#: Rows of the sketch; cells of a row for a document, and their bounds as powers of two: the map that is broadcast takes DEPTH * 2**22 bytes at most.
DEPTH, CELLS_PER_DOC, LEAST_BITS, MOST_BITS = 2, 16, 12, 25
#: Terms and sources of a block, and rows that a task keeps before it hands counts on.
TERMS, SOURCES, HELD_ROWS = 1024, 256, 200_000
U = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By byte: is it part of a term; the byte with A to Z lower-cased."""
    state = textscan.process_state()
    if "term_bytes" not in state:
        part, low = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
        part[65:91] = part[97:123] = part[128:] = True
        low[65:91] += 32
        state["term_bytes"] = part, low
    return state["term_bytes"]


def terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The text (its number) and term of each finding in a buffer of texts."""
    part, low = _tables()
    inside = part[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    data = low[buf[inside]]
    rank = np.cumsum(inside)  # of a term's first byte among the bytes of terms
    ends = np.append(rank[starts] - 1, len(data)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data.tobytes()))
    return np.searchsorted(offs, starts, "right") - 1, found.dictionary_encode()


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys, and the sum of each value over a key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


def by_text(texts: pa.Array, limit: int = textscan.CHUNK_BYTES):
    """(texts' numbers, codes, terms by code, counts) in parts; each text's counts are complete and each of its terms comes once."""
    for row, rows, buf, offs in textscan.chunks(texts, limit):
        if rows > 1 or len(buf) <= 2 * limit:
            text, coded = terms(buf, offs)
            size = max(len(coded.dictionary), 1)
            key, n = summed(text * size + coded.indices.to_numpy(zero_copy_only=False), np.ones(len(text), np.int64))
            yield row + key // size, key % size, coded.dictionary, n
            continue
        held, at = [], 0  # a long text, cut between terms
        part, _ = _tables()
        while at < len(buf):
            end = min(at + limit, len(buf))
            while end < len(buf) and part[buf[end - 1]] and part[buf[end]]:
                gap = np.flatnonzero(~part[buf[end : end + limit]])
                end = end + (int(gap[0]) if len(gap) else min(limit, len(buf) - end))
            _, coded = terms(buf[at:end], np.array([0, end - at]))
            code, n = summed(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.ones(len(coded), np.int64))
            held.append(pa.table({"term": coded.dictionary.take(pa.array(code)), "n": n}))
            if len(held) > 16:
                held = [_merged(held, ["term"], ["n"])]
            at = end
        whole = _merged(held, ["term"], ["n"])
        yield np.full(len(whole), row), np.arange(len(whole)), whole["term"].combine_chunks(), whole["n"].to_numpy()


def _merged(tables: list[pa.Table], by: list[str], values: list[str]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(by).aggregate([(v, "sum") for v in values])
    return t.select([*by, *(f"{v}_sum" for v in values)]).rename_columns([*by, *values])


def term_hashes(found: pa.Array) -> np.ndarray:
    found = found.cast(pa.large_binary())
    if not len(found):
        return np.zeros(0, U)
    offs = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
    buf = np.frombuffer(found.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return textscan.span_hashes(textscan.prefix_hashes(buf), offs[:-1] - offs[0], offs[1:] - offs[0])


def lang_codes(langs: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Each row's code, a seed for each code, the codes' languages."""
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    seeds = [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in names]
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.array(seeds, U), names


def cells(h: np.ndarray, bits: int) -> np.ndarray:
    """A cell in each row of the sketch for each hash of (lang, term): numbers below DEPTH * 2**bits."""
    odd = [U((d + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for d in range(DEPTH)]
    return np.stack([(textscan.mix(h + c) >> U(64 - bits)) + U(d << bits) for d, c in enumerate(odd)]).astype(np.int64)


def sketch_bits(docs: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(docs, 1) * CELLS_PER_DOC))))


def _cleaned(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def sketch(docs: DataFrame, bits: int, least: int = LEAST_DOCS) -> np.ndarray:
    """One bit for each cell of the merged sketch: do least or more (document, term) pairs fall into it."""

    def run(batches):
        counts = np.zeros(DEPTH << bits, np.uint8)
        for batch in batches:
            lang, seeds, _ = lang_codes(batch.column(0))
            for text, code, found, _ in by_text(batch.column(1)):
                # documents by (lang, term) first, then by cell
                key, n = summed(lang[text] * len(found) + code, np.ones(len(text), np.int64))
                if len(key):
                    at = cells(term_hashes(found)[key % len(found)] ^ seeds[key // len(found)], bits)
                    for row in at:
                        u, more = summed(row, n)
                        counts[u] = np.minimum(counts[u] + more, 255)  # 255 is as good as more
        u = np.flatnonzero(counts)
        for k in range(0, len(u), 100_000):
            part = u[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part].astype(np.int32))], ["cell", "n"])

    part = docs.select("lang", "text").mapInArrow(run, "cell int, n int")
    full = part.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = full.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cell & 63)")).alias("bits"))
    out = np.zeros(max(DEPTH << bits >> 6, 1), np.int64)
    for r in words.toLocalIterator():  # of DEPTH * 2**bits / 64 words at most
        out[r.word] = r.bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def counted(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n and docs of terms that the sketch doesn't rule out: exact counts, and documents that hold the term."""
    bits = sketch_bits(docs.count())
    may = shared.sent(docs.sparkSession, np.packbits(sketch(docs, bits, least)))
    by, values = ["lang", "source", "term"], ["n", "docs"]

    def run(batches):
        full, held, rows = np.unpackbits(may()).astype(bool), [], 0
        for batch in batches:
            lang, seeds, langs = lang_codes(batch.column(0))
            coded = batch.column(1).dictionary_encode()
            sources, source = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for text, code, found, n in by_text(batch.column(2)):
                if not len(text):
                    continue
                width = len(found)
                group = lang[text] * len(sources) + source[text]
                key, n, docs_of = summed(group * width + code, n, np.ones(len(n), np.int64))
                group, code = key // width, key % width
                keep = full[cells(term_hashes(found)[code] ^ seeds[group // len(sources)], bits)].all(0)
                group, code, n, docs_of = group[keep], code[keep], n[keep], docs_of[keep]
                names = pa.array(langs, pa.string()).take(pa.array(group // len(sources)))
                held.append(pa.table({"lang": names, "source": sources.take(pa.array(group % len(sources))), "term": found.take(pa.array(code)), "n": n, "docs": docs_of}))
                rows += len(held[-1])
                if rows > HELD_ROWS:
                    held = [_merged(held, by, values)]
                    if (rows := len(held[0])) > HELD_ROWS // 2:
                        yield from held[0].combine_chunks().to_batches(max_chunksize=50_000)
                        held, rows = [], 0
        if held:
            yield from _merged(held, by, values).combine_chunks().to_batches(max_chunksize=50_000)

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (count + SMOOTH) / (total + SMOOTH * kept)), three digits at a time, so that nothing overflows."""
    out, rest, by = F.lit(1).cast("long"), count + SMOOTH, total + SMOOTH * kept
    for scale in (1_000_000, 1000, 1):
        out, rest = out + F.call_function("div", rest * 1000, by) * scale, (rest * 1000) % by
    return out


def _distances(rows: DataFrame) -> DataFrame:
    """lang, a, b (numbers of sources, a < b), value and seen over the rows (lang, tb, lo, hi, at, term, p) of each (lang, tb, lo, hi).
    A row without a term has the share of a source's missing terms, and is there for every source of the two blocks."""

    def work(key, table):
        lang, _, lo, hi = (k.as_py() for k in key)
        at, p = table["at"].to_numpy(), table["p"].to_numpy()
        coded = table["term"].combine_chunks().dictionary_encode()
        none = np.asarray(pc.is_null(table["term"]))
        base = np.zeros(2 * SOURCES, np.int64)
        there = np.zeros(2 * SOURCES, bool)
        local = at - lo * SOURCES if lo == hi else np.where(at // SOURCES == lo, at - lo * SOURCES, at - hi * SOURCES + SOURCES)
        base[local[none]], there[local[none]] = p[none], True
        m = np.repeat(base[:, None], max(len(coded.dictionary), 1), 1)
        if len(coded.dictionary):
            m[local[~none], coded.indices.filter(pa.array(~none)).to_numpy(zero_copy_only=False)] = p[~none]
        else:
            m[:] = 0
        left = np.flatnonzero(there[:SOURCES])
        right = left if lo == hi else SOURCES + np.flatnonzero(there[SOURCES:])
        number = np.where(np.arange(2 * SOURCES) < SOURCES, lo * SOURCES, (hi - 1) * SOURCES) + np.arange(2 * SOURCES)
        a, b, v = [], [], []
        for x in left:
            to = right[right > x] if lo == hi else right
            a.append(np.full(len(to), number[x]))
            b.append(number[to])
            v.append(np.abs(m[to] - m[x]).sum(1))
        a, b, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, v))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(v, pa.int64()), "seen": pa.array(np.full(len(a), len(coded.dictionary)), pa.int64())})

    return rows.groupBy("lang", "tb", "lo", "hi").applyInArrow(work, "lang string, a long, b long, value long, seen long")


def audit(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank, as the contract has them."""
    docs = _cleaned(docs)
    counts = shared.stored(counted(docs, least))
    kept = shared.stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_n"))
    held = shared.stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "in_lang"))
    groups = docs.select("lang", "source").distinct().join(held.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left")
    groups = groups.join(sizes, "lang", "left").na.fill(0, ["group_n", "v", "lang_n"])
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = shared.stored(groups.withColumn("blocks", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / SOURCES).cast("int")).withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("int")))
    named = held.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))

    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    above = named.withColumn("value", F.col("p") - share(F.col("in_lang"), F.col("lang_n"), F.col("v"))).where("value > 0")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= ranks)

    base = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("group_n"), F.col("v"))).otherwise(0).cast("long")
    alone = groups.select("lang", "at", "blocks", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("tb"), F.lit(None).cast("string").alias("term"), base.alias("p"))
    rows = named.select("lang", "at", "blocks", F.pmod(F.xxhash64("term"), "term_blocks").cast("int").alias("tb"), "term", "p").unionByName(alone)
    own = (F.col("at") / SOURCES).cast("int")
    rows = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("lang", "tb", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "at", "term", "p")
    far = _distances(rows).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one, two = (groups.select("lang", F.col("at").alias(k), F.col("source").alias(f"source_{k}"), base.alias(f"p_{k}"), *extra) for k, extra in (("a", ["v"]), ("b", [])))
    far = far.join(one, ["lang", "a"]).join(two, ["lang", "b"])
    far = shared.stored(far.select("lang", "source_a", "source_b", (F.col("value") + F.abs(F.col("p_a") - F.col("p_b")) * (F.col("v") - F.col("seen"))).alias("value")))
    both = far.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").unionByName(far.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), "value"))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by)).unionByName(above)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(shared.table(spark, sf_dir, "documents"))


OP12_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS in_lang FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= {LEAST_DOCS}),
s AS (SELECT lang, count(*) AS v, sum(in_lang) AS lang_n FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {WHOLE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH}) // (group_n + {SMOOTH} * v) AS p, 1 + {WHOLE}::HUGEINT * (in_lang + {SMOOTH}) // (lang_n + {SMOOTH} * v) AS q FROM g JOIN s USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g JOIN g AS h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN (SELECT a.lang, a.source AS a, b.source AS b, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term GROUP BY 1, 2, 3) AS x ON x.lang = g.lang AND x.a = g.source AND x.b = h.source
UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM f QUALIFY part = 'pair' OR rank <= {RANKS}"""
