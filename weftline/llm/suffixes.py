"""Exact substring deduplication (op9): every byte covered by a 200-byte string that starts anywhere else too is removed.

Candidates. A window is a 200-byte string of a text. Its anchor is its least SEED-byte substring by hash, the first of equals: a function
of the window's bytes alone, so that equal windows have equal anchors at equal places. Successive windows of a text that share their
anchor form a run, about 70 windows. What moves is a row for each run: hash of the anchor, 128 bits of hash of the run's whole bytes, place.
Runs of the same hash are one string with a multiplicity, as copies of a text are in other operators.

In text that repeats itself with a short period successive runs are the same string; they are one row with a number of times.

- An anchor found once: its windows are found nowhere else.
- All runs of an anchor are one string, found several times: there is nothing to order, and all its windows are repeated.
- An anchor stands in different strings: one of each goes to the suffix sort. Windows of strings found several times are repeated; the sort
  finds out which windows of the others are.

Hot anchors. An anchor with more than HOT strings is dealt out further. Its strings are cut into pieces of the windows in which it stands at
PLACES successive places; what all windows of such places share, the core, is hashed, and pieces meet only others with their places and
core, where equal ones become one again. The windows of a group that still has more than HOT pieces are dealt out by ranges of their bytes, so
that one group's sort runs in many tasks, and equal ones within a task are one before they move. The bytes of these strings come from
another scan of the texts, one of each in a task: the texts themselves move once, whether anchors are hot or not.

Rows that say where strings stand are joined with what is known of a string, or an anchor, by that key. A key with more than 1/SHARES of all
rows is cut into shares of about that size by the rows' places; there are fewer than SHARES such keys, and fewer than 2 SHARES shares.

Suffix sort. Windows are sorted within their anchor by deep-shallow sorting: multikey quicksort on 8-byte words to SHALLOW bytes, all groups
in one vectorised pass for each word, then blind tries order what still agrees. Windows next to each other that agree in 200 bytes are
repeated.

Strings are compared as UTF-8 bytes and never cross texts; a null text is empty; texts under 200 bytes are left as they are. Repeated rows
are texts of their own, so that both lose what they share; their spans are the same and are gathered once. Spans are gathered by document,
whose length bounds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import shared, textscan
from weftline.llm.textscan import U

WINDOW, SEED, SHALLOW = 200, 64, 64
HOT, PLACES = 2048, 8
SHARES = 1024
#: Bits for each hot anchor in the marks that say where the scan for hot anchors looks (a join tells which of these are hot), and the most
#: bits there are: 8 MB; beyond four million hot anchors the scan passes on more runs than it must, and results are the same.
BITS_EACH, MOST_BITS = 16, 1 << 26
NO_ID = -(1 << 63)


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value, the first of equals, in each window of ``width`` values."""
    m, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        right = m[step:] < m[:-step]
        m, at = np.where(right, m[step:], m[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    return at


def seed_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each SEED-byte substring, and the running sums and inverse powers that it comes from. Where two different substrings
    share a hash, the sort tells them apart."""
    state = textscan.process_state()
    if len(state.get("seed_powers", ((),))[0]) <= len(buf):
        both = []
        for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
            power = np.full(max(len(buf), textscan.CHUNK_BYTES) + 1, base, U)
            power[0] = 1
            both.append(np.multiply.accumulate(power))
        state["seed_powers"] = tuple(both)
    power, inverse = state["seed_powers"]
    letters = textscan.mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
    p = np.zeros(len(buf) + 1, U)
    np.cumsum(letters[buf] * power[: len(buf)], out=p[1:])
    h = (p[SEED:] - p[:-SEED]) * inverse[: len(p) - SEED]
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29)), p, inverse


def runs(buf: np.ndarray, offs: np.ndarray):
    """Runs of a chunk of texts: (text, start within it, number of windows, anchor's offset in the run, anchor's hash, run's two hashes, times
    that the run follows on itself)."""
    empty = np.zeros(0, np.int64)
    none = empty, empty, empty, empty, empty.astype(U), empty.astype(U), empty.astype(U), empty
    if len(buf) < WINDOW:
        return none
    p, (h, sums, inverse) = textscan.prefix_hashes(buf), seed_hashes(buf)
    anchor = least_in_windows(h, WINDOW - SEED + 1)
    mark = np.zeros(len(buf) + 1, np.int8)
    long = np.diff(offs) >= WINDOW
    mark[offs[:-1][long]] += 1
    mark[offs[1:][long] - WINDOW + 1] -= 1
    at = np.flatnonzero(np.cumsum(mark, dtype=np.int8)[: len(anchor)])
    if not len(at):
        return none
    a = anchor[at]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]))
    n = np.diff(np.append(first, len(at)))
    s, a = at[first], a[first].astype(np.int64)
    text = np.searchsorted(offs, s, "right") - 1
    run = textscan.mix(textscan.span_hashes(p, s, s + n - 1 + WINDOW) + (a - s).astype(U) * U(0x9E3779B97F4A7C15))
    other = textscan.mix((sums[s + n - 1 + WINDOW] - sums[s]) * inverse[s] + n.astype(U))
    again = (text[1:] == text[:-1]) & (run[1:] == run[:-1]) & (other[1:] == other[:-1]) & (n[1:] == n[:-1]) & (h[a[1:]] == h[a[:-1]]) & (s[1:] == s[:-1] + n[:-1])
    one = np.flatnonzero(np.concatenate([[True], ~again]))
    times = np.diff(np.append(one, len(s)))
    return tuple(c[one] for c in (text, s - offs[text], n, a - s, h[a], run, other)) + (times,)


class BlindTrie:
    """Strings of one length by branching places only: a string goes down by single bytes, is compared once with the leaf it reaches,
    and is hung in where the two part. Equal strings share a leaf."""

    __slots__ = ("rows", "root", "size")

    def __init__(self, rows: list[bytes]):
        self.rows, self.size, self.root = rows, len(rows[0]), None

    def insert(self, x: int) -> None:
        row, node = self.rows[x], self.root
        if node is None:
            self.root = [x]
            return
        while isinstance(node, tuple):
            depth, kids = node
            node = kids.get(row[depth]) or next(iter(kids.values()))
        other = self.rows[node[0]]
        differ = int.from_bytes(row, "big") ^ int.from_bytes(other, "big")
        if not differ:
            node.append(x)
            return
        common = (8 * self.size - differ.bit_length()) // 8
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < common:
            above, node = node, node[1][row[node[0]]]
        if isinstance(node, tuple) and node[0] == common:
            node[1][row[common]] = [x]
            return
        branch = (common, {other[common]: node, row[common]: [x]})
        if above is None:
            self.root = branch
        else:
            above[1][row[above[0]]] = branch

    def leaves(self):
        """Lists of equal strings, in ascending order."""
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node


def deep_shallow(buf: np.ndarray, at: np.ndarray, group: np.ndarray, size: int = WINDOW, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings buf[at:at + size] within their groups: (order, whether each equals the one before it in its group)."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    same = np.concatenate([[False], g[1:] == g[:-1]])
    for depth in range(0, shallow, 8):
        inside = same.copy()
        inside[:-1] |= same[1:]
        where = np.flatnonzero(inside)  # places of groups of two or more
        if not len(where):
            break
        members, number = order[where], np.cumsum(~same)[where]
        word = np.ascontiguousarray(buf[at[members][:, None] + np.arange(depth, depth + 8)]).view(">u8").ravel().astype(U)
        by = np.lexsort((word, number))
        order[where] = members[by]
        word, number = word[by], number[by]
        part = np.concatenate([[True], (word[1:] != word[:-1]) | (number[1:] != number[:-1])])
        same[where] = ~part
    edges = np.flatnonzero(~same)
    ends = np.append(edges[1:], len(order))
    wide = np.flatnonzero(ends - edges > 1)
    rest = np.arange(shallow, size)
    if len(wide):
        pairs = wide[ends[wide] - edges[wide] == 2]
        if len(pairs):
            a, b = buf[at[order[edges[pairs]]][:, None] + rest], buf[at[order[edges[pairs] + 1]][:, None] + rest]
            differ = a != b
            equal = ~differ.any(1)
            k = np.argmax(differ, 1)
            swap = ~equal & (a[np.arange(len(k)), k] > b[np.arange(len(k)), k])
            i = edges[pairs][swap]
            order[i], order[i + 1] = order[i + 1], order[i]
            same[edges[pairs] + 1] = equal
        for k in wide[ends[wide] - edges[wide] > 2]:
            lo, hi = edges[k], ends[k]
            members = order[lo:hi].copy()
            table = buf[at[members][:, None] + rest]
            trie = BlindTrie([r.tobytes() for r in table])
            for x in range(len(members)):
                trie.insert(x)
            place = lo
            for leaf in trie.leaves():
                order[place : place + len(leaf)] = members[leaf]
                same[place] = False
                same[place + 1 : place + len(leaf)] = True
                place += len(leaf)
    return order, same


def repeated(buf: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of each window: does another one of its group equal it?"""
    order, same = deep_shallow(buf, at, group)
    out = np.zeros(len(at), bool)
    out[order[same]] = True
    out[order[:-1][same[1:]]] = True
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key (k, t1, t2) of a row: its id, and 128 bits of the text's hash that tell rows with the same id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), *shared.text_key(text, F.col("doc_id").isNull()))


RUN = "anchor long, run long, run2 long, k long, t1 long, t2 long, s int, n int, off int, times int"


def _marks(hot: DataFrame) -> np.ndarray:
    """Words of 64 marks by the low bits of hot anchors, as many as their number asks for."""
    bits = min(MOST_BITS, 1 << max(12, (BITS_EACH * hot.count() - 1).bit_length()))
    mark = hot.select(F.col("anchor").bitwiseAND(F.lit(bits - 1)).alias("mark")).select(F.expr("mark div 64").alias("word"), F.expr("shiftleft(1L, cast(mark % 64 as int))").alias("bit"))
    words = mark.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(U)


def _is_marked(words: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    mark = anchor & U(64 * len(words) - 1)
    return (words[(mark >> U(6)).astype(np.int64)] >> (mark & U(63))) & U(1) == 1


def _run_rows(keyed: DataFrame, marked: Callable[[], np.ndarray] | None = None) -> DataFrame:
    """The runs of all texts; of marked anchors only, and with their bytes, if marks are given."""

    def work(batch):
        k, t1, t2 = (np.asarray(batch.column(i)) for i in (1, 2, 3))
        for first, _, buf, offs in textscan.chunks(batch.column(0)):
            text, s, n, off, anchor, run, run2, times = found = runs(buf, offs)
            if marked is not None:
                x = np.flatnonzero(_is_marked(marked(), anchor))
                text, s, n, off, anchor, run, run2, times = (c[x] for c in found)
            if len(text):
                columns = {"anchor": anchor.view(np.int64), "run": run.view(np.int64), "run2": run2.view(np.int64), "k": k[first + text], "t1": t1[first + text], "t2": t2[first + text], "s": s, "n": n, "off": off, "times": times}
                if marked is not None:
                    begin = offs[text] + s
                    columns["bytes"] = [buf[i:j].tobytes() for i, j in zip(begin, begin + n + WINDOW - 1, strict=True)]
                yield columns

    return shared.by_batch(keyed.where(F.octet_length("text") >= WINDOW).select("text", "k", "t1", "t2"), work, RUN if marked is None else f"{RUN}, bytes binary")


def _joined(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows (with k and s) joined with table, which has one row for each combination of keys and their number ``found``. A key with more than
    1 / SHARES of all that table counts is cut into shares of about that size; fewer than SHARES keys can have so many."""
    total = F.broadcast(table.agg(F.sum("found").alias("_total")))
    hot = table.select(*keys, "found").crossJoin(total).where(F.col("found") * SHARES > F.col("_total"))
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("found") * SHARES / F.col("_total")).cast("long").alias("_shares")))
    left = rows.join(hot, keys, "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64("k", "s"), F.col("_shares")), F.lit(0).cast("long"))).drop("_shares")
    right = table.drop("found").join(hot, keys, "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_shares", F.lit(1).cast("long")) - 1))).drop("_shares")
    return left.join(right, [*keys, "_share"], how).drop("_share")


#: Bytes of runs that are sorted at once; a single anchor's runs may be more.
SORT_BYTES = 1 << 20


def _sort_runs(rows: DataFrame) -> DataFrame:
    """Windows of single strings that are repeated: k, t1, t2, s, n of each stretch. rows: PIECE, in order of anchor and part."""

    def solve(anchor, part, k, t1, t2, s, n, off, single, data):
        size = n + WINDOW - 1
        begin = np.cumsum(size) - size
        buf = np.frombuffer(b"".join(data), np.uint8)
        which = np.repeat(np.arange(len(n)), n)
        i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        number = np.cumsum(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]))
        found = repeated(buf, begin[which] + i, number[which] * (2 * WINDOW) + (i - off[which] + WINDOW)) & single[which]
        x = np.flatnonzero(found)
        if len(x):
            first = np.concatenate([[True], (x[1:] != x[:-1] + 1) | (which[x[1:]] != which[x[:-1]])])
            b = np.flatnonzero(first)
            m = np.diff(np.append(b, len(x)))
            w = which[x[b]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((k[w], pa.int64()), (t1[w], pa.int64()), (t2[w], pa.int64()), (s[w] + i[x[b]], pa.int32()), (m, pa.int32()))], names=["k", "t1", "t2", "s", "n"])

    def run(batches):
        held: list[tuple] = []
        bytes_held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and bytes_held > SORT_BYTES and row[:2] != held[-1][:2]:
                    yield from solve(*(np.array(c) for c in list(zip(*held, strict=True))[:9]), [r[9] for r in held])
                    held, bytes_held = [], 0
                if held and row[:6] == held[-1][:6]:
                    continue  # a repeated row of the table
                held.append(row)
                bytes_held += len(row[9])
        if held:
            yield from solve(*(np.array(c) for c in list(zip(*held, strict=True))[:9]), [r[9] for r in held])

    return rows.select(*PIECE).repartition("anchor", "part").sortWithinPartitions("anchor", "part", "k", "t1", "t2", "s").mapInArrow(run, SPAN)


SPAN = "k long, t1 long, t2 long, s int, n int"
PIECE = ["anchor", "part", "k", "t1", "t2", "s", "n", "off", "single", "bytes"]


def pieces(raw: bytes, s: int, n: int, off: int, places: int | None = None):
    """(start, windows, anchor's offset, part) of the pieces of a run of n windows from s whose anchor stands at off: windows in which the
    anchor stands at ``places`` successive places. part: a hash of these places and of the bytes that all windows of such places share."""
    places = places or PLACES
    for block in range((off - n + 1) // places, off // places + 1):
        first, last = max(0, off - (block + 1) * places + 1), min(n - 1, off - block * places)
        core = raw[s + off - block * places : s + off - (block + 1) * places + 1 + WINDOW]
        part = int.from_bytes(hashlib.blake2b(block.to_bytes(4, "big") + core, digest_size=8).digest(), "big", signed=True)
        yield s + first, last - first + 1, off - first, part


def _in_rows(pieces_of: Callable, rows: DataFrame) -> DataFrame:
    """PIECE of what ``pieces_of`` gives for each batch."""

    def grouped(batch):
        out = []
        for row in pieces_of(batch):
            out.append(row)
            if len(out) >= 4000:
                yield dict(zip(PIECE, zip(*out, strict=True), strict=True))
                out = []
        if out:
            yield dict(zip(PIECE, zip(*out, strict=True), strict=True))

    return shared.by_batch(rows, grouped, "anchor long, part long, k long, t1 long, t2 long, s int, n int, off int, single boolean, bytes binary")


def _cut_runs(rows: DataFrame) -> DataFrame:
    """PIECE of the strings that rows (text and the array ``wanted`` of (anchor, s, n, off, single)) ask for, whole and with part 0."""

    def work(batch):
        for text, k, t1, t2, wanted in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
            raw = text.encode()
            for w in wanted:
                yield w["anchor"], 0, k, t1, t2, w["s"], w["n"], w["off"], w["single"], raw[w["s"] : w["s"] + w["n"] + WINDOW - 1]

    # with doc_id, so that the texts' exchange is the one that removal() has, and runs once
    return _in_rows(work, rows.select("doc_id", "text", "k", "t1", "t2", "wanted"))


def _cut_hot(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """PIECE of the different strings of hot anchors, in pieces. Equal strings are counted where they are read, before any bytes move."""
    one = F.min(F.struct("k", "t1", "t2", "s", "n", "off")).alias("one")
    kinds = _run_rows(keyed, shared.sent(keyed.sparkSession, _marks(hot))).groupBy("anchor", "run", "run2").agg(F.sum("times").alias("found"), one, F.first("bytes").alias("bytes"))

    def work(batch):
        for anchor, k, t1, t2, s, n, off, single, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for begin, m, at, part in pieces(data, 0, n, off):
                yield anchor, part, k, t1, t2, s + begin, m, at, single, data[begin : begin + m + WINDOW - 1]

    return _in_rows(work, kinds.join(hot, "anchor", "left_semi").select("anchor", "one.*", (F.col("found") == 1).alias("single"), "bytes"))


#: Different windows that a task holds before it passes them on.
HELD = 50_000
#: Bytes of windows that a task of a crowded group's sort is to have.
RANGE_BYTES = 1 << 25
OWNED = "anchor long, part long, place int, window binary, k long, t1 long, t2 long, s int, single boolean"


def _owned_windows(rows: DataFrame) -> DataFrame:
    """The different windows of PIECE rows and one owner of each, which is single if its string is found once and a task has seen no other
    window like it. Owners of windows that a task sees twice come by themselves, without a window."""

    def run(batches):
        def table(owners):
            columns = list(zip(*owners, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        held: dict[tuple, tuple] = {}
        for batch in batches:
            seen = []
            for anchor, part, k, t1, t2, s, n, off, single, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range(n):
                    key, mine = (anchor, part, off - i, data[i : i + WINDOW]), (k, t1, t2, s + i, single)
                    other = held.setdefault(key, mine)
                    if other is mine:
                        continue
                    seen += [(None, None, None, None, *x) for x in (other, mine) if x[4]]
                    held[key] = (*other[:4], False)
            if seen:
                yield table(seen)
            if len(held) > HELD:
                yield table([(*w, *x) for w, x in held.items()])
                held = {}
        if held:
            yield table([(*w, *x) for w, x in held.items()])

    names = [c.split()[0] for c in OWNED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    return rows.select(*PIECE).mapInArrow(run, OWNED)


def _sort_windows(windows: DataFrame) -> DataFrame:
    """SPAN of single owners of windows that another row has too. windows: OWNED, stored. Ranges of (anchor, part, place, window) are sorted
    each by itself, so that a group of any size lies over several tasks and equal windows over one."""

    def solve(held):
        anchor, part, place, window, k, t1, t2, s, single = zip(*held, strict=True)
        key = list(zip(anchor, part, place, strict=True))
        group = np.cumsum([True] + [a != b for a, b in zip(key[1:], key[:-1], strict=True)])
        found = repeated(np.frombuffer(b"".join(window), np.uint8), np.arange(len(held)) * WINDOW, group) & np.array(single)
        x = np.flatnonzero(found)
        if len(x):
            columns = [np.array(c)[x] for c in (k, t1, t2, s)] + [np.ones(len(x))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.int32(),) * 2, strict=True)], names=["k", "t1", "t2", "s", "n"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) * WINDOW > SORT_BYTES and row[:3] != held[-1][:3]:
                    yield from solve(held)
                    held = []
                held.append(row)
        if held:
            yield from solve(held)

    place = ["anchor", "part", "place"]
    tasks = max(windows.sparkSession.sparkContext.defaultParallelism, -(-windows.count() * WINDOW // RANGE_BYTES))
    return windows.repartitionByRange(tasks, *place, "window").sortWithinPartitions(*place).mapInArrow(run, SPAN)


def _spans_of_hot(cut: DataFrame) -> DataFrame:
    """SPAN of the repeated windows of hot anchors' single strings. cut: PIECE, stored."""
    same = ["anchor", "part", "off", "n", "h1", "h2"]
    all_pieces = cut.withColumns({"h1": F.xxhash64("bytes"), "h2": F.xxhash64(F.lit(1), "bytes")})
    first = F.min(F.struct("k", "t1", "t2", "s")).alias("one")
    kinds = shared.stored(all_pieces.groupBy(*same).agg(F.count(F.lit(1)).alias("found"), first, F.bool_and("single").alias("alone"), F.first("bytes").alias("bytes")))
    span = ["k", "t1", "t2", "s", "n"]
    whole = _joined(all_pieces.where("single").select(*same, "k", "t1", "t2", "s"), kinds.where("found > 1").select(*same, "found"), same, "left_semi").select(*span)
    crowded = shared.stored(kinds.groupBy("anchor", "part").agg(F.count(F.lit(1)).alias("strings")).where(F.col("strings") > HOT).select("anchor", "part"))
    one_each = kinds.select("anchor", "part", "one.*", "n", "off", (F.col("alone") & (F.col("found") == 1)).alias("single"), "bytes")
    found = whole.unionByName(_sort_runs(one_each.join(crowded, ["anchor", "part"], "left_anti")))
    if crowded.isEmpty():
        return found
    windows = shared.stored(_owned_windows(one_each.join(crowded, ["anchor", "part"], "left_semi")))
    seen = windows.where("window is null").select("k", "t1", "t2", "s", F.lit(1).alias("n"))
    return found.unionByName(seen).unionByName(_sort_windows(windows.where("window is not null")))


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyed rows of docs; k, t1, t2, spans) with the repeated windows of each document that has any, as an array of (s, n): n windows from s."""
    keyed = _keyed(docs)
    rows = _run_rows(keyed)
    # counts are written out before they are joined: a join between two plain exchanges is one whose hot keys Spark can split
    anchors = shared.stored(rows.groupBy("anchor").agg(F.sum("times").alias("found"), F.min("run").alias("lo"), F.max("run").alias("hi"), F.min("run2").alias("lo2"), F.max("run2").alias("hi2")).where("found > 1"))
    many = shared.stored(_joined(rows, anchors, ["anchor"]).select("anchor", "run", "run2", "k", "t1", "t2", "s", "n", "off", "times", ((F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2"))).alias("alike")))
    unlike = many.where(~F.col("alike"))
    string, stretch = ["anchor", "run", "run2"], (F.col("n") * F.col("times")).alias("n")
    kinds = shared.stored(unlike.groupBy(*string).agg(F.sum("times").alias("found"), F.min(F.struct("k", "t1", "t2", "s", "n", "off")).alias("one")))
    whole = _joined(unlike, kinds.where("found > 1").select(*string, "found"), string, "left_semi").select("k", "t1", "t2", "s", stretch)
    hot = shared.stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("strings")).where(F.col("strings") > HOT).select("anchor"))
    asked = kinds.join(hot, "anchor", "left_anti").select("one.k", "one.t1", "one.t2", F.struct("anchor", "one.s", "one.n", "one.off", (F.col("found") == 1).alias("single")).alias("w"))
    cut = _cut_runs(keyed.join(asked.groupBy("k", "t1", "t2").agg(F.collect_list("w").alias("wanted")), ["k", "t1", "t2"]).select("doc_id", "text", "k", "t1", "t2", "wanted"))
    found = many.where("alike").select("k", "t1", "t2", "s", stretch).unionByName(whole).unionByName(_sort_runs(cut))
    if not hot.isEmpty():
        found = found.unionByName(_spans_of_hot(shared.stored(_cut_hot(keyed, hot))))
    return keyed, found.groupBy("k", "t1", "t2").agg(F.collect_set(F.struct("s", "n")).alias("spans"))


def removed_bytes(size: int, found: list[dict] | None) -> np.ndarray:
    """Mark of each byte that a repeated window covers."""
    change = np.zeros(size + 1, np.int32)
    if found:
        s = np.array([x["s"] for x in found])
        np.add.at(change, s, 1)
        np.add.at(change, s + np.array([x["n"] for x in found]) + WINDOW - 1, -1)
    return np.cumsum(change[:-1]) > 0


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs."""
    keyed, found = spans(docs)

    def work(batch):
        ids, texts, where = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        out = []
        for text, w in zip(texts, where, strict=True):
            raw = text.encode()
            if not w:
                out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            gone = removed_bytes(len(raw), w)
            n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((len(raw), int(gone.sum()), n_spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
        size, n, k, sha = zip(*out, strict=True)
        yield {"doc_id": ids, "n_bytes": size, "n_removed": n, "n_spans": k, "kept_sha256": sha}

    rows = keyed.join(found, ["k", "t1", "t2"], "left").select("doc_id", "text", "spans")
    return shared.by_batch(rows, work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text and n_chars, if there is one, counted anew; other columns stay.

    Bytes of a character that is cut in two go with the rest of it. Rows that lose their whole text are left out.
    """
    _, found = spans(docs)
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    k, t1, t2, where = (shared.fresh(docs, n) for n in ("key_id", "key_text", "key_text2", "repeated_spans"))
    rows = docs.withColumns({k: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), **dict(zip((t1, t2), shared.text_key(text, F.col("doc_id").isNull()), strict=True))})
    rows = rows.join(found.select(F.col("k").alias(k), F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("spans").alias(where)), [k, t1, t2], "left").select(*names, where)
    at = names.index("text")
    count = next((i for i, n in enumerate(names) if n == "n_chars"), None)

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = part.column(at).to_pylist()
                keep = np.ones(len(texts), bool)
                for i, w in enumerate(part.column(len(names)).to_pylist()):
                    if w:
                        raw = texts[i].encode()
                        texts[i] = np.frombuffer(raw, np.uint8)[~removed_bytes(len(raw), w)].tobytes().decode(errors="ignore")
                        keep[i] = bool(texts[i])
                columns = [part.column(i) for i in range(len(names))]
                columns[at] = pa.array(texts, columns[at].type)
                if count is not None:
                    columns[count] = pa.array([None if t is None else len(t) for t in texts], columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return rows.mapInArrow(run, docs.schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(shared.table(spark, sf_dir, "documents"))
