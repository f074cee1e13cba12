"""Vectorised scans over many texts at once: a chunk of texts is one byte buffer, words and shingles are arrays.

Words are runs of bytes other than space and \\t..\\r, that is ``[^\\x20\\x09-\\x0D]+``. The hash of a span joins two polynomials of its
bytes modulo the prime 2**31 - 1, with different bases and tables of random values; unlike a polynomial modulo 2**64 it has no strings
that collide for every base.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U = np.uint64
#: The modulus of the hashes, and a base for each of the two polynomials.
PRIME = (1 << 31) - 1
BASES = (0x2545F491, 0x5BD1E995)


def process_state() -> dict:
    """What a worker process keeps between tasks; functions that travel by value have new globals in each task."""
    return sys.modules.setdefault("weftline_process_state", types.ModuleType("weftline_process_state")).__dict__


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a common 64-bit hash; a bijection."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x = x * U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def fold(x: np.ndarray) -> np.ndarray:
    """A number of the same remainder modulo PRIME, below 2**34 for any 64-bit x."""
    return (x & U(PRIME)) + (x >> U(31))


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers modulo PRIME of each base and of its inverse, at least n of each."""
    state = process_state()
    if len(state["hash_powers"][0][0] if "hash_powers" in state else ()) < n:
        m = max(n, CHUNK_BYTES + 1)

        def powers(base):
            p, done = np.ones(m, U), 1
            while done < m:
                more = min(done, m - done)
                p[done : done + more] = p[:more] * U(pow(base, done, PRIME)) % U(PRIME)
                done += more
            return p

        state["hash_powers"] = [(powers(base % PRIME), powers(pow(base, -1, PRIME))) for base in BASES]
    return state["hash_powers"]


def _tables() -> list[np.ndarray]:
    state = process_state()
    if "hash_tables" not in state:
        state["hash_tables"] = [mix(np.arange(1, 257, dtype=U) * U(odd)) % U(PRIME) for odd in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)]
    return state["hash_tables"]


def _classes() -> np.ndarray:
    """Bits by byte: 1 white space, 2 continuation byte, 4 one of #*$%&|<>, 8 digit, 16 upper case, 32 ASCII punctuation, 64 not ASCII."""
    state = process_state()
    if "byte_classes" not in state:
        c = np.zeros(256, np.uint8)
        c[[0x20, *range(9, 14)]] |= 1
        c[0x80:0xC0] |= 2
        c[list(b"#*$%&|<>")] |= 4
        c[list(b"0123456789")] |= 8
        c[list(range(65, 91))] |= 16
        c[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] |= 32
        c[0x80:] |= 64
        state["byte_classes"] = c
    return state["byte_classes"]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, rows, buffer, offsets) over an Arrow string column in pieces of about ``limit`` bytes; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, last - row, data[offs[row] : offs[last]], offs[row : last + 1] - offs[row]
        row = last


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of words of each text)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    word = (_classes()[buf] & 1) == 0
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def prefix_hashes(buf: np.ndarray) -> list[np.ndarray]:
    """For each base p with p[e] - p[s] = hash of buf[s:e] times the base to the power s, not yet reduced."""
    out = []
    for (power, _), table in zip(_powers(len(buf) + 1), _tables(), strict=True):
        p = np.zeros(len(buf) + 1, U)
        np.cumsum(fold(table[buf] * power[: len(buf)]), out=p[1:])  # below 2**33 each: sums hold for texts up to 2 GB
        out.append(p)
    return out


def span_hashes(p: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each buf[start:end], alike wherever the bytes stand."""
    halves = []
    for one, (_, inverse) in zip(p, _powers(len(p[0])), strict=True):
        halves.append(fold(fold(one[ends] - one[starts])) % U(PRIME) * inverse[starts] % U(PRIME))
    return mix((halves[0] << U(32) | halves[1]) + mix((ends - starts).astype(U)))


_STEP = U(0xA0761D6478BD642F)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k successive words of one text, number for each text); a text of 1 to k-1 words has one, of all its words."""
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if not len(words):
        return np.zeros(0, U), n
    begin = np.cumsum(counts) - counts
    # positions of the shingles' first words
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    length = np.minimum(np.repeat(counts, n), k)
    h = np.zeros(len(at), U)
    for i in range(k):
        inside = length > i
        v = words[np.minimum(at + i, len(words) - 1)]
        h = np.where(inside, (h ^ v) * _STEP, h)
        h ^= h >> U(32)
    return mix(h + length.astype(U)), n


def repeats(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key, within its text: is it found twice or more; is it one of those beyond the first (which one isn't fixed)."""
    many, spare = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys):
        own = keys ^ (np.repeat(np.arange(len(counts), dtype=U), counts) * U(0x9FB21C651E98DF25))
        order = np.argsort(own)
        k = own[order]
        same = k[1:] == k[:-1]
        spare[order[1:]] = same
        many[order[1:]] = same
        many[order[:-1]] |= same
    return many, spare


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of flags over each text's span."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), offs))


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_digits", "n_upper", "n_punct", "n_beyond_ascii", "n_same_word", "n_distinct_words", "n_short_words", "n_repeat_lines", "n_shout"]


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whole numbers about each text, a row for each, columns as in STATS; all are 0 for an empty text.

    n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words within 5-word windows found twice or more in
    the text, the first finding included.
    """
    out = np.zeros((len(offs) - 1, len(STATS)), np.int64)
    if not len(buf):
        return out
    starts, ends, n = word_bounds(buf, offs)
    woffs = np.concatenate([[0], np.cumsum(n)])
    p = prefix_hashes(buf)
    words = span_hashes(p, starts, ends)
    kinds = _classes()[buf]
    out[:, 0] = n
    out[:, 5] = np.diff(offs) - per_text((kinds & 2) != 0, offs)
    out[:, 1] = out[:, 5] - per_text((kinds & 1) != 0, offs)
    for i, bit in ((2, 4), (7, 8), (8, 16), (9, 32)):
        out[:, i] = per_text((kinds & bit) != 0, offs)
    out[:, 10] = per_text((kinds & 66) == 64, offs)

    # lines
    newline = np.flatnonzero(buf == 10)
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    cut[newline + 1] = True
    ls = np.flatnonzero(cut[:-1])
    le = np.append(ls[1:], len(buf))
    le = le - ((le > ls) & (buf[np.maximum(le - 1, 0)] == 10))
    wordy = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le = ls[wordy], le[wordy]
    lines = np.diff(np.searchsorted(ls, offs))
    many, spare = repeats(span_hashes(p, ls, le), lines)
    loffs = np.concatenate([[0], np.cumsum(lines)])
    out[:, 6], out[:, 3], out[:, 14] = lines, per_text(spare, loffs), per_text(many, loffs)

    # windows of five words
    five = np.maximum(n - 4, 0)
    if five.sum():
        long = n >= 5
        keep = np.repeat(long, n)
        h, m = shingles(words[keep], n[long], 5)
        many, _ = repeats(h, m)
        begin = np.repeat((woffs[:-1][long]) - (np.cumsum(m) - m), m) + np.arange(len(h))
        inside = np.zeros(len(words), bool)
        for k in range(5):
            inside[begin[many] + k] = True
        out[:, 4] = per_text(inside, woffs)

    if len(words):
        doc = np.repeat(np.arange(len(n)), n)
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        out[:, 11] = per_text(same, woffs)
        _, spare = repeats(words, n)
        out[:, 12] = n - per_text(spare, woffs)
        out[:, 13] = per_text(ends - starts <= 1, woffs)
        out[:, 15] = per_text((buf[ends - 1] == 33) & ((kinds[starts] & 16) != 0), woffs)
    return out
