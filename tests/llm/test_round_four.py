"""Conversation repair, source divergence and near-duplicate vectors against plain versions, with nulls, ties, repeated rows, long and empty
inputs and clashing names."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import conversations, divergence, vectors

# --- conversations ------------------------------------------------------------------------------------------------------------------------


def plain_repair(rows):
    """Rows (conv_id, turn, role, text) to {conv_id: result}, by the least of all (cost, audit) from the end."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        convs[conv] += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return {conv: plain_one(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for conv, own in convs.items()}


def plain_one(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("", "s"): "s"}

    best = {q: (0, "", ()) if q in ("", "a") else (math.inf, "", ()) for q in ("", "s", "u", "a")}

    def with_inserts(found):
        for _ in range(4):
            for q in found:
                for name in ("user", "assistant"):
                    if (to := after.get((q, name[0]))) is not None:
                        c, audit, lines = found[to]
                        found[q] = min(found[q], (c + 3, "I" + audit, (f"{name}:", lines)))
        return found

    best = with_inserts(best)
    for (_, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        found = {}
        for q in best:
            c, audit, lines = best[q]
            own = [(c + 4, "D" + audit, lines)]
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if (to := after.get((q, role[:1]))) is not None:
                    c, audit, lines = best[to]
                    own.append((c + more, "K" + audit, (f"{role}:{text}", lines)))
                for name in ("user", "assistant"):
                    if (to := after.get((q, name[0]))) is not None:
                        c, audit, lines = best[to]
                        own.append((c + 3 + more, "R" + audit, (f"{name}:{text}", lines)))
            found[q] = min(own)
        best = with_inserts(found)
    cost, audit, lines = best[""]
    whole = []
    while lines:
        line, lines = lines
        whole.append(line)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256("\n".join(whole).encode()).hexdigest())


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations_of(seed):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", None, "é ß?", "a. \x0b", "b\xa0", "Why?"]
    rows = []
    for conv in [*range(40), None]:
        for turn in r.sample(range(12), r.randint(1, 9)):
            rows.append((conv, None if r.random() < 0.1 else turn, r.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "u"]), r.choice(texts) if r.random() < 0.6 else f"text {r.random()}."))
    return rows + r.sample(rows, 20)  # repeated rows


@pytest.mark.parametrize("pieces", [(3, 1 << 20), (4096, 4), (4096, 4 << 20)])
def test_conversations_are_repaired_as_cheaply_as_can_be(spark, pieces):
    rows = conversations_of(7)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, harm string, there int").repartition(3)
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in conversations.repaired(conversations.damaged(df), *pieces).collect()}
    assert got == plain_repair(rows)


def test_one_conversation_over_many_partitions(spark):
    r = random.Random(1)
    # a third of its turns say the same, some turns are shared by several rows
    rows = [(5, t // 2 if t % 7 == 0 else t, r.choice(["user", "assistant"]), "ok." if t % 3 == 0 else f"line {t}" + ("." if t % 5 else "")) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    (got,) = conversations.repaired(conversations.damaged(df), 64).collect()
    assert tuple(got[n] for n in NAMES) == plain_repair(rows)[5]


def test_conversations_without_rows(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert conversations.repaired(conversations.damaged(spark.createDataFrame([], schema))).count() == 0
    dropped = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    (got,) = conversations.repaired(conversations.damaged(spark.createDataFrame([(str(dropped), 0, "user", "Hi.")], schema))).collect()
    assert tuple(got) == (str(dropped), 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_text_in_a_conversation(spark):
    rows = [(1, t, "user", "word " * 400_000 + f"{t}.") for t in range(4)]
    (got,) = conversations.repaired(conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert tuple(got[n] for n in NAMES) == plain_repair(rows)[1]


# --- source divergence --------------------------------------------------------------------------------------------------------------------


def plain_audit(rows, least, ranks):
    """(lang, source, part, item) to (value, rank) of rows (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = functools.partial(re.sub, "[A-Z]", lambda m: m[0].lower())
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = [lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = {}
    for lang in docs.keys() | {r[0] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = {s: Counter({t: c[t] for t in kept}) for (one, s), c in counts.items() if one == lang}
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q, p = shares(sum(mine.values(), Counter())), {s: shares(c) for s, c in mine.items()}
        for s in p:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if mine[s][t] and p[s][t] > q[t])[:ranks]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode()): (-v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def documents_of(seed):
    r = random.Random(seed)
    words = [f"w{'abcdefgh'[k % 8]}{'xyz'[k % 3]}é{chr(97 + k % 26)}" for k in range(60)] + ["Ünder", "THE", "the", "日本"]
    rows = [(r.choice(["en", "de", None]), r.choice(["a", "b", "c", "d", "", None]) if r.random() < 0.7 else "hot", " ".join(r.choices(words, k=r.randint(0, 30))) + "1 a_b [C]") for _ in range(300)]
    return [*rows, ("en", "empty", ""), ("en", "none", None), ("xx", "one", "alone"), ("xx", "two", "alone again"), *rows[:20], ("en", "a", "Far " * 200_000)]


def test_divergence_of_sources(spark, monkeypatch):
    rows = documents_of(3)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, n int, docs int").repartition(5)
    want = plain_audit(rows, 4, 6)
    got = {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in divergence.audit(df, 4, 6).collect()}
    assert got == want
    monkeypatch.setattr(divergence, "SOURCES", 2)  # several blocks of sources and of terms, and counts handed on early
    monkeypatch.setattr(divergence, "TERMS", 5)
    monkeypatch.setattr(divergence, "HELD_ROWS", 20)
    assert {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in divergence.audit(df, 4, 6).collect()} == want


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_terms_of_a_text_in_pieces():
    texts = pa.array(["Aé b1b " * 400 + "x" * 300 + " end", None, "", "one ONE"])
    whole, cut = ({(int(t), found[int(c)].as_py()): int(n) for text, code, found, ns in divergence.by_text(texts, limit) for t, c, n in zip(text, code, ns, strict=True)} for limit in (1 << 20, 64))
    assert whole == cut and whole[0, "b"] == 800 and whole[0, "aé"] == 400 and whole[3, "one"] == 2


def test_the_sketch_never_rules_out_a_frequent_term(spark):
    rows = documents_of(5)
    df = divergence._cleaned(spark.createDataFrame(rows, "lang string, source string, text string"))
    full = divergence.sketch(df, 6, 4)  # 64 cells a row: crowded
    found = divergence.counted(df, 4)
    many = {(r.lang, r.term) for r in found.groupBy("lang", "term").sum("docs").where("`sum(docs)` >= 4").collect()}
    assert many and full.any()
    for lang, term in many:
        _, seeds, _ = divergence.lang_codes(pa.array([lang]))
        assert full[divergence.cells(divergence.term_hashes(pa.array([term])) ^ seeds, 6)].all()


# --- near-duplicate vectors ---------------------------------------------------------------------------------------------------------------


def plain_links(rows, threshold=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, links, up = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) / max(abs(x) for x in rows[k][1]) for k in (i, j))
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k in range(n):
        least.setdefault(root(k), []).append(rows[k][0])
    out = []
    for k in range(n):
        ids = [i for i in least[root(k)] if i is not None]
        component = min(ids) if ids else None
        out.append((rows[k][0], links[k], component, rows[k][0] == component))
    return sorted(out, key=str)


def vectors_of(seed, dims, n=300):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, dims))
    rows = [(int(k), (centres[k % 6] * (k % 3 + 1) + r.standard_normal(dims) * (0.3 + 0.15 * (k % 4))).tolist()) for k in range(n // 2)]
    rows += [(int(n + k), r.standard_normal(dims).tolist()) for k in range(n // 2)]
    odd = [None, [], [0.0] * dims, [1.0] * (dims - 1) + [float("nan")], [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [1e300] * dims, [-1e-300] * dims, [1e-300] * dims, [1.0, 2.0], [2.0, 4.0]]
    return rows + [(-int(k), v) for k, v in enumerate(odd, 1)] + rows[:9] + [(None, rows[3][1]), (None, [0.0, 1.0, 0.0])]


@pytest.mark.parametrize(("dims", "tile"), [(64, 32768), (40, 32), (3, 50)])
def test_links_of_vectors(spark, dims, tile):
    rows = vectors_of(dims, dims)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, h1 string").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept if r.vec_id is not None else r.component_id is None) for r in vectors.near_duplicates(df, tile=tile).collect()), key=str)
    assert got == plain_links(rows)


def test_links_of_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_within_reach_share_a_block_and_a_slab():
    r = np.random.default_rng(2)
    x = vectors.units(r.standard_normal((400, 64)))
    y = vectors.units(x + r.standard_normal((400, 64)) * 0.055)
    near = (x * y).sum(1) >= 0.9
    assert 50 < near.sum() < 400
    turn, radius = vectors.rotation(64), math.sqrt(0.2)
    d = ((x - y) @ turn) ** 2
    parts = vectors.blocks_of(64)
    block = np.argmin([d[:, p].sum(1) for p in parts], 0)
    met = np.zeros(400, bool)
    for (k, a), (_, b) in zip(vectors._slabs(x, turn, radius), vectors._slabs(y, turn, radius), strict=True):
        met |= (block == k) & (abs(a - b) <= 1) & (d[:, parts[k]].sum(1) <= 0.2 / len(parts))
    assert met[near].all()
