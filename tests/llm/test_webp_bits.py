"""Numbers written as bits: equal to plain ones, in memory that grows with the numbers and not with their bits."""

import tracemalloc

import numpy as np

from plumbline.llm import webp


def test_packed_equals_plain_bits():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 31, 500):
        widths = rng.integers(0, 25, n)
        values = rng.integers(0, 1 << 26, n)
        bits = "".join(format(int(v) & ((1 << int(w)) - 1), f"0{int(w)}b")[::-1] if w else "" for v, w in zip(values, widths, strict=True))
        plain = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
        assert webp._packed(values, widths) == plain
    widths, values = np.full(100_000, 20), rng.integers(0, 1 << 20, 100_000)
    tracemalloc.start()
    webp._packed(values, widths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * int(widths.sum())
