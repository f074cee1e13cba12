"""Token ids of many texts at once, equal to those of the tokenizers library for byte-level vocabularies.

The texts of a chunk are one array of code points. Where pre-tokens begin follows from the classes of neighbouring characters, for all
texts in one pass. Pre-tokens are grouped by hash and compared with their group's first one character by character, so that a group
holds equal ones only. The library's own model encodes each different pre-token once; a worker remembers the latest of them between
tasks. Texts with what may be a special token take the library's whole path.
"""

from __future__ import annotations

import array
import re

import numpy as np

from weftline.llm.textscan import U, mix, process_state

#: Pre-tokens that a worker remembers: between this many and twice as many.
MAX_REMEMBERED = 1 << 19
CHUNK_CHARS = 1 << 20
SIGN, LETTER, DIGIT, SPACE = range(4)
_BASE = 0x9E3779B97F4A7C15
#: What follows an apostrophe that begins a pre-token of its own, with one letter or with two (fixed values of such vocabularies).
ONE, TWO = "stmd", ("re", "ve", "ll")


def classes() -> np.ndarray:
    """Class of each code point."""
    state = process_state()
    if "character_classes" not in state:
        import regex

        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "?" for c in range(0x110000))
        table = np.full(0x110000, SIGN, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        state["character_classes"] = table
    return state["character_classes"]


def pretoken_starts(cp: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mark of each code point at which a pre-token begins; offs: where the texts begin, and the end."""
    kind = classes()[cp]
    n = len(cp)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    begin = first[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # a run takes the blank before it
    taken = np.zeros(n, bool)
    taken[1:] = (cp[:-1] == 32) & ~space[1:] & ~first[1:-1]
    begin &= ~taken
    # of white space before something else the last character stands for itself, or with what follows
    begin[:-1] |= space[:-1] & ~space[1:] & ~first[1:-1]
    quotes = np.flatnonzero((cp == 39) & begin)
    if len(quotes):
        padded = np.append(cp, np.zeros(3, np.uint32)).astype(U)
        inside = np.append(~first[:-1], [False, False, False])
        a, b = padded[quotes + 1], padded[quotes + 2]
        short = inside[quotes + 1] & np.isin(a, [ord(c) for c in ONE])
        long = inside[quotes + 1] & inside[quotes + 2] & np.isin(a << U(32) | b, np.array([ord(c) << 32 | ord(d) for c, d in TWO], U))
        begin[quotes[short | long] + 1] = False
        ends = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        begin[ends[ends < n]] = True
    return begin


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    state = process_state()
    if len(state.get("token_powers", ((),))[0]) < n:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, CHUNK_CHARS * 2), base, U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        state["token_powers"] = tuple(both)
    return state["token_powers"]


def groups(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a pre-token of each group, the group of each pre-token); pre-tokens of a group are equal."""
    powers, inverse = _powers(len(cp) + 1)
    p = np.zeros(len(cp) + 1, U)
    np.cumsum(mix((cp + np.uint32(1)).astype(U) * U(0xD1B54A32D192ED03)) * powers[: len(cp)], out=p[1:])
    size = ends - starts
    h = mix((p[ends] - p[starts]) * inverse[starts] + size.astype(U))
    order = np.argsort(h)
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    one = order[new]
    group = np.empty(len(starts), np.int64)
    group[order] = np.cumsum(new) - 1
    like = one[group]
    odd = size != size[like]
    like[odd] = np.flatnonzero(odd)
    other = np.repeat(starts[like] - starts, size) + np.arange(starts[0], ends[-1])
    wrong = np.flatnonzero(cp[other] != cp[starts[0] : ends[-1]])
    alone = np.union1d(np.flatnonzero(odd), np.searchsorted(starts, wrong + starts[0], "right") - 1).astype(np.int64)
    group[alone] = len(one) + np.arange(len(alone))  # a pre-token whose hash is another one's
    return np.concatenate([one, alone]), group


class Encoder:
    """Ids of texts by the vocabulary at ``path``; dtype is the narrowest that holds them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # bytes stand for themselves or for letters beyond 255, as the byte-level alphabet has them
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        assert set(self.letters.values()) == set(pre_tokenizers.ByteLevel.alphabet())

    def _ids(self, several: list[str]) -> list[bytes]:
        """Ids of each of different pre-tokens."""
        ids = list(map(self.young.get, several))
        for k in [k for k, x in enumerate(ids) if x is None]:
            token = several[k]
            if (found := self.old.get(token)) is None:
                found = array.array(self.kind, [t.id for t in self.whole.model.tokenize(token.encode().decode("latin-1").translate(self.letters))]).tobytes()
            if len(self.young) >= MAX_REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[token] = ids[k] = found
        return ids

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts = np.flatnonzero(pretoken_starts(cp, offs))
        ends = np.append(starts[1:], len(cp))
        one, group = groups(cp, starts, ends)
        ids = self._ids([joined[s:e] for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
        size = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
        flat, first = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(size) - size
        n = size[group]
        done = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(first[group] - done[:-1], n) + np.arange(done[-1])]
        return out, np.diff(done[np.searchsorted(starts, offs)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian. Texts are taken together up to CHUNK_CHARS; longer ones are cut where white space begins,
        which is where a pre-token does."""
        out: list[bytes] = [b""] * len(texts)
        held: list[tuple[int, str]] = []
        chars = 0

        def flush():
            ids, counts = self._chunk([t for _, t in held])
            ends = np.cumsum(counts)
            for (k, _), a, b in zip(held, (ends - counts).tolist(), ends.tolist(), strict=True):
                out[k] += ids[a:b].tobytes()
            held.clear()

        for k, text in enumerate(texts):
            if "<|" in text:
                out[k] = np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
                continue
            for piece in pieces(text):
                if held and chars + len(piece) > CHUNK_CHARS:
                    flush()
                    chars = 0
                held.append((k, piece))
                chars += len(piece)
        if held:
            flush()
        return out


def pieces(text: str):
    """Parts of a text of about CHUNK_CHARS, each but the first beginning with white space after something else."""
    cut, at = re.compile(r"(?<=[^\s\x1c-\x1f])[ \n]"), 0
    while len(text) - at > CHUNK_CHARS and (m := cut.search(text, at + CHUNK_CHARS - 4096)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encoder(path: str) -> Encoder:
    state = process_state()
    if ("encoder", path) not in state:
        state["encoder", path] = Encoder(path)
    return state["encoder", path]
