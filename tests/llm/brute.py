"""Plain versions of the text measures, one text at a time."""

import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def base(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    inside = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def removal(texts, size=200):
    """(bytes, removed, spans, sha256 of the rest) of each text."""
    import hashlib

    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + size] for r in raw for i in range(len(r) - size + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if count[r[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def statistics(text):
    """All measures of a text, in the order of textscan.STATS."""
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    count = Counter(lines)
    return (
        *base(text), len(text), len(lines), sum(c in "0123456789" for c in text), sum("A" <= c <= "Z" for c in text), sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text), sum(ord(c) > 127 for c in text),
        sum(a == b for a, b in zip(w, w[1:], strict=False)), len(set(w)), sum(len(x.encode()) <= 1 for x in w), sum(n for n in count.values() if n > 1), sum(x[-1] == "!" and "A" <= x[0] <= "Z" for x in w),
    )


def features(text):
    """Shares and means of them, in the order of quality.RATIOS."""
    import math

    n_words, chars, symbols, dup, repeat, n_chars, n_lines, digits, upper, punctuation, beyond, same, distinct, short, repeat_lines, shout = statistics(text)
    w, c, n = max(n_words, 1), max(n_chars, 1), max(n_lines, 1)
    return [math.log(1 + n_words), chars / w, symbols / c, dup / n, repeat / w, digits / c, upper / c, punctuation / c, beyond / c, same / w, distinct / w, short / w, repeat_lines / n, shout / w, n_words / n]


def walk(model, row):
    """Probability by going down each tree node by node."""
    import math

    total = model.base
    for node in model.roots:
        while model.feature[node] >= 0:
            node = model.right[node] if row[model.feature[node]] > model.threshold[node] else model.left[node]
        total += model.value[node]
    return 1 / (1 + math.exp(-total))
