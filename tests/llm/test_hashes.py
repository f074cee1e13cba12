"""Hashes on strings that collide under a polynomial modulo 2**64."""

import brute
import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import textscan


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("size", [256, 1024, 2048, 4096])
def test_lines_and_words_that_differ_stay_apart(size):
    one, other = thue_morse(size), thue_morse(size, "b", "a")
    texts = [f"{one}\n{other}", f"{one}\n{other}\n{one}", " ".join([one, other] * 3)]
    got = [tuple(g[:5]) for _, _, b, o in textscan.chunks(pa.array(texts, pa.string())) for g in textscan.statistics(b, o)]
    assert got == [brute.base(t) for t in texts]


def test_hash_is_of_the_bytes_alone():
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3990, 3000)
    ends = starts + rng.integers(0, 10, 3000)
    h = textscan.span_hashes(textscan.prefix_hashes(buf), starts, ends)
    seen = {}
    for s, e, x in zip(starts, ends, h.tolist(), strict=True):
        assert seen.setdefault(buf[s:e].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)
