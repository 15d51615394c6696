"""Randomised checks of the parts that need no cluster."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from terrapoint.llm import byte_bpe, segments, sharding
from terrapoint.llm.bcr import repeated_windows
from terrapoint.llm.repeats import covered, runs

TEXT = st.lists(st.sampled_from([b"ab", b"ba", b"abc", b"c", b"aaaa"]), max_size=40).map(b"".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.integers(4, 12))
def test_later_windows(texts, window):
    texts = [t for t in texts if len(t) >= window][:6] or [b"x" * window]
    length = np.array([min(len(t), 200) for t in texts])
    texts = [t[:200] for t in texts]
    string, offset = repeated_windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length, np.arange(len(texts)), np.zeros(len(texts), np.int64), window)
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for o in range(len(t) - window + 1):
            if t[o : o + window] in seen:
                want.add((i, o))
            seen.add(t[o : o + window])
    assert set(zip(string.tolist(), offset.tolist(), strict=True)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.sampled_from([(8, 3), (12, 4), (16, 8)]))
def test_partners_lose_nothing(texts, sizes):
    """Strings that share a window, under one minimizer, are never narrowed away, and pieces of one kind meet."""
    window, gram = sizes
    sym = np.concatenate([segments.byte_symbols(t) for t in texts])
    if len(sym) < window:
        return
    s = segments.segments(sym, np.cumsum([len(t) for t in texts]), window, gram)
    data = b"".join(texts)
    strings = sorted({(int(m), data[a : a + n + window - 1]) for a, n, m in zip(s.start, s.n, s.m, strict=True)})
    if not strings:
        return
    length = np.array([len(x) for _, x in strings])
    m = np.array([k for k, _ in strings], np.uint64)
    flat = segments.byte_symbols(b"".join(x for _, x in strings))
    first, last = segments.partners(flat, np.cumsum(length) - length, length, m, window, gram)
    windows = [[(k, x[o : o + window]) for o in range(len(x) - window + 1)] for k, x in strings]
    count = Counter(w for ws in windows for w in ws)
    for ws, a, b in zip(windows, first, last, strict=True):
        assert all(count[w] == 1 or a <= i <= b for i, w in enumerate(ws))
    shared: dict = {}
    for (k, x), ws in zip(strings, windows, strict=True):
        for width in (6, 1):
            for o, n, b, e in zip(*segments.pieces(segments.byte_symbols(x), len(ws), k, window, gram, width), strict=True):
                assert 0 <= b <= e <= len(x)
                for i in range(o, o + n):
                    key = (k, x[i : i + window], width)
                    assert shared.setdefault(key, x[b:e]) == x[b:e]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.booleans(), max_size=12), max_size=6))
def test_runs(masks):
    sizes = np.array([len(m) for m in masks], np.int64)
    got = runs(np.array([x for m in masks for x in m], bool), sizes).to_pylist() if masks else []
    for m, spans in zip(masks, got, strict=True):
        mask = np.zeros(len(m), bool)
        for s in spans:
            mask[s["begin"] : s["end"]] = True
        assert mask.tolist() == m and len(spans) == sum(x and not (i and m[i - 1]) for i, x in enumerate(m))


def test_covered():
    import pyarrow as pa

    spans = pa.array([[2 << 9 | 1], None, [0 << 9 | 2, 5 << 9 | 1]], pa.list_(pa.int64()))
    got = covered(spans, np.array([6, 3, 9]), 3)
    assert np.flatnonzero(got).tolist() == [2, 3, 4, 9, 10, 11, 12, 14, 15, 16]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200), st.integers(1, 20))
def test_pieces_cut_between_matches(text, size):
    before, byte_bpe.PIECE = byte_bpe.PIECE, size
    try:
        parts = byte_bpe.pieces(text)
    finally:
        byte_bpe.PIECE = before
    assert "".join(parts) == text
    assert [m for p in parts for m in byte_bpe.PATTERN.findall(p)] == byte_bpe.PATTERN.findall(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 50)), min_size=1, max_size=120), st.integers(1, 6))
def test_fill_is_even(sizes, n):
    blocks = [(old, k, size) for k, (old, size) in enumerate(sizes)]
    total = sum(b[2] for b in blocks)
    capacity = [total // n + (j < total % n) for j in range(n)]
    supply = [sum(b[2] for b in blocks if b[0] == i) for i in range(4)]
    flow = sharding.min_cost_flow(supply, capacity, [[int(i != j) for j in range(n)] for i in range(4)])
    place = sharding.fill(blocks, flow, capacity)
    got = Counter({j: 0 for j in range(n)})
    for old, k, size in blocks:
        got[place[(old, k)]] += size
    assert max(got.values()) - min(got.values()) <= max(b[2] for b in blocks)
