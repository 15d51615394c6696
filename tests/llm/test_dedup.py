"""String, passage, text and vector duplicates, each held against brute force on small tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from terrapoint.llm import components, lattice, segments, simhash, substring_dedup, suffix_dedup
from terrapoint.llm.automaton import SuffixAutomaton
from terrapoint.llm.bcr import Collection

SCHEMA = "doc_id long, text string, rid string, spans string, ids string"


def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "a", None, "b") for r in rows], SCHEMA)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeäß😀", k=r.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(r.choices(words, k=60)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [" ".join(r.choices(words, k=r.randint(0, 50))) for _ in range(r.randint(1, 3))]
        if r.random() < 0.6:
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        out.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    out += [(n, None), (n + 1, ""), (n + 2, "short"), (n + 3, "x" * 700), (n + 4, "ab " * 300), (n + 5, out[0][1]), (n + 6, " \n "), (n + 7, (passages[0] + " ") * 30)]
    r.shuffle(out)
    return out


def brute_strings(rows, window=100):
    seen, out = set(), {}
    for d, text in sorted(rows):
        b = (text or "").encode()
        mask = [False] * len(b)
        for i in range(len(b) - window + 1):
            if b[i : i + window] in seen:
                mask[i : i + window] = [True] * window
            seen.add(b[i : i + window])
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        spans = sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask))
        out[d] = (len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [1000, 2])
def test_strings(spark, crowd):
    rows = corpus(1)
    got = suffix_dedup.digest(suffix_dedup.remove_repeated_strings(docs(spark, rows), crowd=crowd)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_strings(rows)


def test_strings_of_equal_and_null_ids(spark):
    text = "".join(random.Random(2).choices("abcdef", k=400))
    rows = [(None, text), (5, text), (5, text), (7, text[:150] + "!"), (7, None)]
    got = suffix_dedup.remove_repeated_strings(docs(spark, rows), carry=True).collect()
    assert len(got) == 5 and got[0]["rest"]["rid"] == "a"
    assert Counter((r["id"], len(r["kept"])) for r in got) == Counter([(None, 400), (5, 0), (5, 0), (7, 1), (7, 0)])


def test_whole_characters_go(spark):
    a = "é" * 80
    got = suffix_dedup.remove_repeated_strings(docs(spark, [(1, a + "1"), (2, "x" + a)]), characters=True).collect()
    for r in got:
        r["kept"].decode()


def brute_passages(rows, window=35):
    words = {d: (t or "").encode().split() for d, t in rows}
    count = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        mask = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                mask[i : i + window] = [True] * window
        kept = b" ".join(x for x, m in zip(w, mask, strict=True) if not m)
        out[d] = (len(w), sum(mask), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [1000, 2])
def test_passages(spark, crowd):
    rows = corpus(3)
    got = substring_dedup.digest(substring_dedup.remove_repeated_passages(docs(spark, rows), crowd=crowd)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_passages(rows)


def _thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n)), "".join("ba"[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("crowd", [1000, 1])
def test_words_of_equal_polynomials_differ(spark, crowd):
    """Words that every polynomial hash modulo a power of two takes for one."""
    a, b = _thue_morse(4096)
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*w[:20], a, *w[20:34]])), (2, " ".join([*w[:20], b, *w[20:34]])), (3, " ".join([*w[:30], a, *w[30:]])), (4, " ".join(["x", *w[:30], a, *w[30:]]))]
    got = substring_dedup.digest(substring_dedup.remove_repeated_passages(docs(spark, rows), crowd=crowd)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_passages(rows)


def test_texts_over_a_chunk(monkeypatch):
    """Long documents come in overlapping chunks, and slices end at bytes."""
    r = random.Random(8)
    monkeypatch.setattr(segments, "CHUNK", 1000)
    from terrapoint.llm import repeats

    text = " ".join("".join(r.choices("abcde", k=r.randint(1, 6))) for _ in range(2000))
    data = text.encode()
    parts = list(segments.chunks([segments.byte_symbols(data)], 100))
    assert len(parts) > 5
    starts = [int(x) + int(shift[0]) for sym, ends, _, shift in parts for x, n in zip(*(lambda s: (s.start, s.n))(segments.segments(sym, ends, 100, 24)), strict=True) for x in range(x, x + n)]
    assert sorted(starts) == list(range(len(data) - 99))
    assert segments.word_symbols(data).tolist() == [int.from_bytes(xxhash.xxh3_64_digest(w), "little") for w in data.split()]
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array([text, None, "", "a", text])})
    assert [b.num_rows for b in repeats.slices([batch], 2, most=10)] == [1, 2, 1, 1]


def test_long_documents(spark):
    """Over CHUNK symbols, in bytes and in words, like brute force."""
    r = random.Random(9)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(3000)]
    long = [" ".join(r.choices(words, k=60_000)) for _ in range(2)]
    rows = [(1, long[0]), (2, long[1] + " " + long[0][100_000:140_000] + " " + long[1][5_000:9_000]), (3, long[0][-500:])]
    got = suffix_dedup.digest(suffix_dedup.remove_repeated_strings(docs(spark, rows))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_strings(rows)
    rows = [(1, " ".join(r.choices(words, k=140_000))), (3, " ".join(r.choices(words, k=50)))]
    w = rows[0][1].split()
    rows.append((2, " ".join(w[131_000:131_300] + ["x"] + w[:40] + ["y"] + w[-36:])))
    got = substring_dedup.digest(substring_dedup.remove_repeated_passages(docs(spark, rows))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_passages(rows)


def test_empty_tables(spark):
    none = docs(spark, [(1, "a")]).limit(0)
    assert suffix_dedup.remove_repeated_strings(none).count() == 0
    assert substring_dedup.remove_repeated_passages(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_collection(seed):
    """Transform and common prefixes against sorted suffixes."""
    r = np.random.default_rng(seed)
    length = r.integers(0, 25, r.integers(1, 8))
    strings = [bytes(r.integers(97, 97 + r.integers(1, 4), n).astype(np.uint8)) for n in length]
    found = Collection(np.frombuffer(b"".join(strings) + b"z", np.uint8), np.cumsum(length) - length, length)
    want = sorted(([c + 1000 for c in s[k:]] + [i], i, len(s) - k) for i, s in enumerate(strings) for k in range(len(s) + 1))
    assert found.string.tolist() == [w[1] for w in want] and found.length.tolist() == [w[2] for w in want]
    lcp = [0]
    for (a, *_), (b, *_) in zip(want, want[1:], strict=False):
        lcp.append(next(k for k in range(len(a)) if a[k] != b[k]))
    assert found.lcp.tolist() == lcp


def test_automaton():
    r = random.Random(4)
    strings = [r.choices("ab", k=r.randint(0, 12)) for _ in range(6)]
    a = SuffixAutomaton(strings)
    count = Counter("".join(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    for text in (*strings, list("abbaabab")):
        for end, (n, places) in enumerate(a.matching(text, 4), 1):
            longest = max((k for k in range(min(4, end) + 1) if k == 0 or count["".join(text[end - k : end])]), default=0)
            assert n == longest
            if n:
                assert places == count["".join(text[end - n : end])]


def test_segments_meet():
    """Equal windows lie in segments of one minimizer, every window lies in one segment, and names tell contents apart."""
    r = np.random.default_rng(5)
    texts = [r.integers(97, 100, n).astype(np.uint8).tobytes() for n in (0, 50, 99, 100, 400, 3000)] + [b"a" * 1000]
    sym = np.concatenate([segments.byte_symbols(t) for t in texts])
    ends = np.cumsum([len(t) for t in texts])
    s = segments.segments(sym, ends, 100, 24)
    data, owner, names = b"".join(texts), {}, {}
    for start, n, m, h in zip(s.start, s.n, s.m, s.h, strict=True):
        assert names.setdefault((m, h), data[start : start + n + 99]) == data[start : start + n + 99]
        for i in range(start, start + n):
            assert i not in owner
            owner[i] = m
    want = [i for b, e in zip([0, *ends[:-1]], ends, strict=True) for i in range(b, e - 99)]
    assert sorted(owner) == want
    by = defaultdict(set)
    for i in want:
        by[data[i : i + 100]].add(owner[i])
    assert all(len(x) == 1 for x in by.values())


def fingerprint(text):
    import re

    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    n = len(ids)
    label = list(ids)
    while True:
        new = [min([label[i], *(label[j] for j in range(n) if linked(i, j))]) for i in range(n)]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize(("block", "small"), [(4, 64), (4, 2), (4096, 64), (4096, 8)])
def test_simhash(spark, monkeypatch, block, small):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL", small)
    r = random.Random(6)
    rows = corpus(7, 40)
    base = r.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=300)
    for k in range(25):
        words = list(base)
        words[r.randrange(300)] = f"W{k}"
        rows.append((200 + k, " ".join(words)))
    got = {x[0]: tuple(x[1:]) for x in simhash.digest(simhash.near_duplicates(docs(spark, rows))).collect()}
    prints = [fingerprint(t) for _, t in rows]
    want = brute_components([d for d, _ in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert got == {d: (f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, want, strict=True)}
    assert len({c for d, (_, c) in got.items() if d >= 200}) < 25


def test_anchors_cover():
    lists = simhash._errors(simhash.RADIUS + 1)
    assert len(lists) == 2048 and sum(map(len, lists)) == 10903
    assert all(np.bitwise_count(x[0]) <= simhash.RADIUS for x in lists)


def test_fingerprints_within_four_bits_meet():
    """All patterns of bits by parts, at random places: some anchor is shared, and the home anchor is among a fingerprint's own."""
    r = np.random.default_rng(11)
    parts = [np.arange(41, 64), np.arange(18, 41), np.arange(18)]
    for da in range(5):
        for db in range(5 - da):
            for dc in range(5 - da - db):
                x = r.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 300, dtype=np.uint64)
                y = x.copy()
                for i in range(300):
                    for bits, n in zip(parts, (da, db, dc), strict=True):
                        for b in r.choice(bits, n, replace=False):
                            y[i] ^= np.uint64(1) << np.uint64(b)
                names, whose = simhash.anchors(x)
                others, of = simhash.anchors(y)
                mine = set(zip(whose.tolist(), names.tolist(), strict=True))
                met = {i for i, name in zip(of.tolist(), others.tolist(), strict=True) if (i, name) in mine}
                assert len(met) == 300, (da, db, dc)
    assert 34 < len(names) / 300 < 36


def test_null_ids_in_components(spark):
    got = simhash.near_duplicates(docs(spark, [(None, "a b c d e"), (None, "a b c d e"), (3, "q r s"), (2, "q r s")]), carry=True).collect()
    assert Counter((r["id"], r["component_id"]) for r in got) == Counter([(None, None), (None, None), (3, 2), (2, 2)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (150, 200), (150, 300), (7, 7)] + [(1000, 1000 + k) for k in range(1, 60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | dict.fromkeys((100, 150, 200, 300), 100) | {1000 + k: 1000 for k in range(60)}


VECTORS = "vec_id long, embedding array<float>, label int, cid string, weight int"


def vectors(seed=8):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(12):
        center = r.standard_normal(64)
        for _ in range(12):
            rows.append((len(rows), (center + 0.12 * r.standard_normal(64)).astype(np.float32).tolist(), k % 3))
    rows += [(len(rows) + i, r.standard_normal(64).astype(np.float32).tolist(), i % 3) for i in range(60)]
    one = rows[0][1]
    odd = [one, one, [2 * x for x in one], None, [], [0.0] * 64, [float("nan")] * 64, [None, *one[1:]], [float("inf"), *one[1:]], one[:32], one]
    labels = [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, None]
    return rows + [(1000 + i, v, l) for i, (v, l) in enumerate(zip(odd, labels, strict=True))]


def sound(v, label):
    return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors(spark, monkeypatch, kind):
    rows = vectors()
    monkeypatch.setattr(components, "BLOCK", 8)
    got = {r[0]: tuple(r[1:]) for r in lattice.digest(lattice.near_duplicates(spark.createDataFrame([(*r, "a", 1) for r in rows], VECTORS.replace("float", kind)))).collect()}

    def linked(i, j):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        if i == j or la != lb or not sound(a, la) or not sound(b, lb) or len(a) != len(b):
            return False
        a, b = np.array(a, np.float64), np.array(b, np.float64)
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98

    roots = brute_components([r[0] for r in rows], linked)
    links = [sum(linked(i, j) for j in range(len(rows))) for i in range(len(rows))]
    assert got == {r[0]: (n, c, r[0] == c) for r, n, c in zip(rows, links, roots, strict=True)}
    assert sum(links) > 100


@pytest.mark.parametrize("dim", [8, 64, 256, 768, 1536])
def test_recall_of_lattice(dim):
    """Pairs at the threshold meet; few of those that are unrelated do, whatever the dimension."""
    r = np.random.default_rng(9)
    n = 2000
    a = r.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((n, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    o = lattice.Tables()
    x, y = lattice.cells(a, np.zeros(n), o), lattice.cells(b, np.zeros(n), o)
    meet = lambda x, y: np.any([(x[:, t, :1] == y[:, t]).any(axis=1) | (y[:, t, :1] == x[:, t]).any(axis=1) for t in range(o.tables)], axis=0)
    assert meet(x, y).mean() > 0.99
    if dim > 8:
        assert np.mean([meet(x, np.roll(x, k, axis=0)).mean() for k in range(1, 20)]) < 0.01


def test_e8_decoding():
    """Nothing nearer among the neighbours; points are of the lattice."""
    x = np.random.default_rng(10).standard_normal((500, 8)) * 3
    p = lattice.decode_e8(x)
    assert ((2 * p) % 1 == 0).all() and (p.sum(axis=1) % 2 == 0).all()
    own = ((x - p) ** 2).sum(axis=1)
    others = (((x - p)[:, None] - lattice.ROOTS) ** 2).sum(axis=2).min(axis=1)
    assert (own <= others + 1e-9).all() and own.max() <= 1 + 1e-9
