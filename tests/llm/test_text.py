"""Quality rules, mixing, encoding, scores, shards and hosts, and the pipeline, on small tables."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from compare import check, connect
from conftest import DATA
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrapoint.llm import byte_bpe, lm_scoring, mixing, quality, segments, sharding, url_filter
from terrapoint.llm.queries import QUERIES, SQL

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORD = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    check(spark, connect(folder), QUERIES[name], SQL[name], folder)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_whole_tables(spark, name):
    """One row for each document, also where SQL can't say more."""
    folder = f"{DATA}/sf0.001"
    rows = QUERIES[name](spark, folder).select("doc_id").collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect())


TEXTS = [None, "", " \t\n", "one", "a b c d e a b c d e a b c d e", "# $ x\n# $ x\n\n \n# $ x", "the cat and the dog of the house " * 30, "ÄÖ ü\x0b\x0cß 😀\x85x", "x " * 500, "$$$ &&& *** " * 80]


def base_counts(t):
    t = t or ""
    w = re.findall(WORD, t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    mask = [0] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            mask[i : i + 5] = [1] * 5
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    failed = len(w) < 10 or 100 * sum(mask) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(mask), failed


def test_quality(spark):
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, n_words int, words string")
    found = quality.judged(df)
    for r in found.select("row.text", *[c for c in found.columns if c != "row"]).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_counts(r["text"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judged(df.limit(0)).count() == 0


def test_quality_tells_junk_from_prose(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id")
    rows = quality.judged(docs).filter("not base_failed").select("row.quality", "kept").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.15


def test_mixing(spark):
    r = random.Random(1)
    sources = [None, "b", "a", "c", "Z", "é", "tiny", "empty"]
    rows = [(i, " ".join(["w"] * r.randint(1, 30)), r.choice(sources[:6]), 1, "k") for i in range(600)]
    rows += [(600, "w w", "tiny", 1, "k"), (601, None, "empty", 1, "k"), (602, "", "empty", 1, "k"), (None, "w", "a", 1, "k"), (5, rows[5][1], rows[5][2], 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, key string")
    got = mixing.mixed(df).select("row.source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times").collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s, *_ in rows:
        size[s] += len((t or "").split())
    total, order = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, total, set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        stop = {s for s in open_ if 3 * size[s] <= share * weight[s]}
        target |= {s: 3.0 * size[s] for s in stop} if stop else {s: share * weight[s] for s in open_}
        left -= sum(target[s] for s in stop)
        open_ = open_ - stop if stop else set()
    taken = Counter()
    for x in got:
        assert x["target"] == pytest.approx(target[x["source"]]) and x["source_size"] == size[x["source"]] and x["times"] <= 3
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - target[s]) <= 31 for s in order) and sum(taken.values()) <= total
    again = mixing.mixed(df.orderBy(F.desc("doc_id"))).select("row.doc_id", "times").collect()
    assert Counter(again) == Counter(mixing.mixed(df).select("row.doc_id", "times").collect())
    assert mixing.mixed(df.limit(0)).count() == 0


def test_bpe(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE", 50)
    texts = [None, "", "<|endoftext|> it's  \n\n a\u3000b 😀😀 ÀÉ 123 4½", "a b " * 200, "word" * 300, " " * 120 + "x", "'S 'll\r\n\tI'LL"]
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids string, other array<int>")
    for offsets in (False, True):
        rows = byte_bpe.decoded(byte_bpe.encoded(df, BPE, offsets=offsets), BPE).orderBy("doc_id").collect()
        for r, t in zip(rows, texts, strict=True):
            assert r["ids"] == TIKTOKEN.encode_ordinary(t or "") and r["decoded"] == (t or "").encode() and r["other"] == [1]
            if offsets:
                assert len(r["offsets"]) == len(r["ids"])
                assert not t or (r["offsets"][0]["begin"] == 0 and r["offsets"][-1]["end"] == len(t))
    assert byte_bpe.encoded(df.limit(0), BPE).count() == 0


def test_split_characters():
    data = "aé😀b".encode()
    for cut in range(len(data) + 1):
        parts = byte_bpe.characters([data[:cut], data[cut:]])
        assert "".join(parts) == "aé😀b"
    assert byte_bpe.characters([b"a\xf0\x9f"]) == ["a\ufffd"]


def plain_scores(texts, order):
    """Stupid backoff over exact words, as it is defined."""
    seqs = [tuple((t or "").encode().split()) for t in texts]
    count = Counter(s[i : i + n] for s in seqs for n in range(1, order + 1) for i in range(len(s) - n + 1))
    total = sum(map(len, seqs))

    def share(gram):
        if len(gram) == 1:
            return count[gram] / total
        return count[gram] / count[gram[:-1]] if count[gram] >= 2 else 0.4 * share(gram[1:])

    return [(len(s), sum(math.log10(share(s[max(0, i - order + 1) : i + 1])) for i in range(len(s)))) for s in seqs]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("frequent", [1 << 22, 50])
def test_scores(spark, monkeypatch, order, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    r = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choices(words, weights=range(30, 0, -1), k=r.randint(0, 40))) for _ in range(80)] + [None, "", " \n", "only", "hot hot " * 2000, texts_twice := " ".join(words), texts_twice]
    a, b = ("".join("ab"[(i.bit_count() + k) % 2] for i in range(1024)) for k in (0, 1))
    texts += [f"{a} x", f"{b} x", f"{b} y"]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, rid string")
    got = {x["id"]: x for x in lm_scoring.scored(df, order).collect()}
    for i, (n, score) in enumerate(plain_scores(texts, order)):
        assert got[i]["n_words"] == n and got[i]["score"] == pytest.approx(score, abs=1e-5)
        assert got[i]["per_word"] is None if not n else got[i]["per_word"] == pytest.approx(score / n, abs=1e-5)
    assert lm_scoring.scored(df.limit(0), order).count() == 0


@pytest.mark.parametrize("piece", [1, 50, 1 << 18])
def test_words_within_texts(monkeypatch, piece):
    """Words of many texts at once: no word runs on into the next text, equal words and no others have equal hashes."""
    monkeypatch.setattr(segments, "PIECE", piece)
    r = random.Random(6)
    long_ = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(1024)).encode() for k in (0, 1)]
    texts = [bytes(r.choices(b"ab\0\xff \t\n\v\f\r\x08\x0e\x1c\x85", weights=[9, 9, *[1] * 12], k=r.randint(0, 99))) for _ in range(200)]
    texts += [b"", b" ", b"a" * 32, b"a" * 33 + b" " + b"a" * 34, b"a\0", b"a", b"a\0\0", b"", *long_, b"abcdefgh abcdefghi abcdefgh\0"]
    words = [t.split() for t in texts]
    h, counts = segments.words_within(b"".join(texts), np.cumsum([0, *map(len, texts)]))
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    pairs = set(zip(flat, h.tolist(), strict=True))
    assert len(pairs) == len(set(flat)) == len(set(h.tolist()))
    none, nothing = segments.words_within(b"", np.zeros(3, np.int64))
    assert len(none) == 0 and nothing.tolist() == [0, 0]


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_scores_of_whole_model(spark, monkeypatch, order, least):
    """With least 1 no n-gram is left out; higher bounds leave out no word."""
    monkeypatch.setattr(lm_scoring, "FREQUENT", 50)
    r = random.Random(4)
    texts = [" ".join(r.choices([f"w{i}" for i in range(60)], weights=range(60, 0, -1), k=r.randint(0, 30))) for _ in range(60)] + [None, "", "only once here", "only twice", "only twice"]
    seqs = [tuple((t or "").split()) for t in texts]
    count = Counter(s[i : i + n] for s in seqs for n in range(1, order + 1) for i in range(len(s) - n + 1))

    def share(gram):
        if len(gram) == 1:
            return count[gram] / sum(map(len, seqs))
        return count[gram] / count[gram[:-1]] if count[gram] >= least else 0.4 * share(gram[1:])

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: x["score"] for x in lm_scoring.scored(df, order, least=least).collect()}
    want = {k: sum(math.log10(share(s[max(0, i - order + 1) : i + 1])) for i in range(len(s))) for k, s in enumerate(seqs)}
    assert got == pytest.approx(want, abs=1e-5)


def test_scores_of_rows_without_ids(spark):
    texts = ["a b c", "a b c", None, "a b", "b c a b"]
    df = spark.createDataFrame([(None if i < 3 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = Counter((r["id"], r["n_words"], round(r["score"], 4)) for r in lm_scoring.scored(df).collect())
    want = plain_scores(texts, 2)
    assert got == Counter((None if i < 3 else 7, n, round(s, 4) if n else 0.0) for i, (n, s) in enumerate(want))


def test_scores_leave_no_word_out(spark):
    """More words than any fixed vocabulary had: each has its own count and bigrams, in plain Python too."""
    r = random.Random(5)
    texts = [" ".join(f"u{r.randrange(90_000)}" if r.random() < 0.9 else f"f{r.randrange(20)}" for _ in range(1000)) for _ in range(150)]
    texts += [" ".join(f"twice{i}" for i in range(300))] * 2 + [" ".join(f"once{i}" for i in range(300)), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: x for x in lm_scoring.scored(df).collect()}
    seqs = [(t or "").split() for t in texts]
    one, two = Counter(w for s in seqs for w in s), Counter(b for s in seqs for b in zip(s, s[1:], strict=False))
    n = sum(one.values())
    assert len(one) > 65535 and len(got) == len(texts)
    for i, s in enumerate(seqs):
        want = math.log10(one[s[0]] / n) if s else 0.0
        for a, b in zip(s, s[1:], strict=False):
            want += math.log10(two[a, b] / one[a] if two[a, b] >= 2 else 0.4 * one[b] / n)
        assert got[i]["n_words"] == len(s) and got[i]["score"] == pytest.approx(want, abs=1e-4)
    assert got[152]["per_word"] < -5 < got[0]["per_word"] < got[150]["per_word"]


def test_flow():
    assert sharding.min_cost_flow([5, 3], [4, 4], [[0, 1], [1, 0]]) == {(0, 0): 4, (0, 1): 1, (1, 1): 3}
    r = random.Random(3)
    for _ in range(30):
        supply = [r.randint(0, 9) for _ in range(3)]
        demand = [r.randint(3, 12) for _ in range(3)]
        if sum(demand) < sum(supply):
            continue
        cost = [[r.randint(0, 5) for _ in range(3)] for _ in range(3)]
        flow = sharding.min_cost_flow(supply, demand, cost)
        assert [sum(flow.get((i, j), 0) for j in range(3)) for i in range(3)] == supply
        assert all(sum(flow.get((i, j), 0) for i in range(3)) <= demand[j] for j in range(3))
        # no cycle of the residual graph is negative, so no flow is cheaper
        slack = [demand[j] - sum(flow.get((i, j), 0) for i in range(3)) for j in range(3)]
        edges = [(i, 3 + j, cost[i][j]) for i in range(3) for j in range(3)] + [(3 + j, i, -cost[i][j]) for (i, j) in flow]
        edges += [(3 + j, 6, 0) for j in range(3) if slack[j]] + [(6, 3 + j, 0) for j in range(3) if slack[j] < demand[j]]
        dist = [0] * 7
        for _ in range(7):
            dist = [min([dist[v], *(dist[a] + c for a, b, c in edges if b == v)]) for v in range(7)]
        assert all(dist[a] + c >= dist[b] for a, b, c in edges)


def test_shards(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, "x" * r.randint(0, 200), r.choice("aaaab"), 0) for i in range(2000)] + [(None, None, "a", 0), (None, "é", None, 0), (7, "x", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    old = F.when(F.col("source") == "a", 0).otherwise(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)))
    plan = sharding.resharded(df, old, 3, 5, carry=True).cache()
    got = plan.collect()
    assert len(got) == len(rows)
    size = Counter()
    for x in got:
        size[x["shard"]] += x["size"]
    assert sorted(size) == list(range(5)) and max(size.values()) - min(size.values()) <= 32
    for s in range(5):
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got)))
    total, held = sum(size.values()), Counter()
    for x in got:
        held[x["old"]] += x["size"]
    moved = sum(x["size"] for x in got if x["old"] != x["shard"])
    least = sum(max(0, held[i] - total / 5) for i in range(3))
    assert least - 300 <= moved <= least + 300
    changed = sharding.rewrite(plan, str(tmp_path))
    back = spark.read.parquet(str(tmp_path))
    assert back.count() == sum(x["shard"] in changed for x in got) and 0 in changed
    assert sharding.resharded(df.limit(0), old, 3, 5).count() == 0


def test_rewrite_keeps_every_row(spark, tmp_path):
    """Onto a corpus that is there: what doesn't change keeps its files, an emptied shard goes, no row is lost."""
    rows = [(i, f"t{i}" * 3, i % 3) for i in range(300)] + [(300 + i, f"u{i}" * 3, 3) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int")
    path = str(tmp_path / "corpus")
    df.withColumn("shard", F.col("at")).write.partitionBy("shard").parquet(path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "corpus").glob("shard=1/*")}
    plan = sharding.resharded(df, F.col("at"), 4, 3, carry=True)
    moved = plan.withColumn("shard", F.when(F.col("old") == 1, F.lit(1)).when(F.col("old") == 3, F.lit(0)).otherwise(F.col("old"))).withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy("id")) - 1)
    assert sharding.rewrite(moved, path, file_rows=50) == [0, 3]
    back = spark.read.parquet(path).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((a, b) for a, b, _ in rows)
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "corpus").glob("shard=1/*")} == before
    assert sorted(x.name for x in (tmp_path / "corpus").iterdir() if x.is_dir()) == ["shard=0", "shard=1", "shard=2"]
    for file in (tmp_path / "corpus").glob("shard=0/*.parquet"):
        assert spark.read.parquet(str(file)).count() <= 50
    assert sharding.rewrite(moved.filter("old = shard"), path) == [] and sharding.rewrite(moved.limit(0), path) == []
    real = sharding.rewrite(plan, path)
    assert real and sorted(r["doc_id"] for r in spark.read.parquet(path).collect()) == list(range(330))


def test_shards_without_ids(spark):
    rows = [(None, "x" * (i % 200), 0) for i in range(2000)] + [(None, None, 0)] * 2000 + [(7, f"e{i}", 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int")
    got = sharding.resharded(df, F.col("at"), 2, 10).groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    size = [r["n"] for r in got]
    assert len(got) == 10 and sum(r["rows"] for r in got) == 6000 and max(size) - min(size) < 0.02 * max(size)
    assert all(r["last"] + 1 == r["slots"] == r["rows"] for r in got)


def test_sharding_query(spark):
    """Sizes, checksums, slots and the law of even bytes on the query's own table."""
    import zlib

    folder = f"{DATA}/sf0.01"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op2_sharding"](spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(list(texts))
    size, slots = Counter(), {}
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["law"] == "bytes" and r["grown_shard"] is None
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(size) == list(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(size.values()) - min(size.values()) <= max(len(t) for t in texts.values()) + 16


def test_hosts(spark):
    urls = ["http://A.Example.COM:80/en/7x?q#f", "https://example.com/en/8", "http://x.net/de/1", "http://example.net/de/81", "ftp://z.org/es/", "no scheme", None, "://h?x/y", "a://b://c/d", "http://É.com/en/", "http://com/en/1", "http://xcom/en/1", "http://a.b.co.uk/p"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(12, 1), (None, 1), (11, None)], "id long, bad int")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(df, labels).collect()}
    assert got[0] == ("a.example.com:80", "/en/7x", None, "allow")
    assert got[1] == ("example.com", "/en/8", "com/en/", "block")
    assert got[2] == ("x.net", "/de/1", "net/de/", "allow") and got[3] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[4][2:] == ("org/es/", "block") and got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("h", "", None, "allow") and got[8][:2] == ("b:", "//c/d")
    assert got[9] == ("É.com", "/en/", "com/en/", "block") and got[10][3] == "block" and got[11][2] is None
    known = {"http://10.0.3.4/": "10.0.3.4", "http://99.9.3.4:80/": "99.9.3.4", "http://a.example.com.:443/": "example.com", "http://[::1]:8/": "[::1]", "http://1.2.3.4.5/": "4.5"}
    for url, domain in known.items():
        name = url_filter.name_of(url_filter.host_of(F.lit(url)))
        assert df.select(url_filter.domain_of(name, url_filter.suffix_of(name, ()))).first()[0] == domain
    row = df.select(url_filter.domain_of(F.lit("a.b.co.uk"), url_filter.suffix_of(F.lit("a.b.co.uk"), ("co.uk",)))).first()
    assert row[0] == "b.co.uk"
    assert url_filter.judged(df.limit(0), labels).count() == 0


def test_bad_hosts_are_blocked(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.site{i % 4}.org/{i}") for i in range(400)]
    labels = [(i, int(i % 2 and i % 20 != 1)) for i in range(0, 400) if i % 3]
    got = url_filter.judged(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "id long, bad int")).collect()
    assert all((r["verdict"] == "block") == r["host"].startswith("bad") for r in got)


def test_pipeline(spark):
    """Stage by stage against plain versions over the smallest table."""
    import corpus_pipeline as cp

    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] and len(cp.STAGES) == 5
    one = cp.quality_rules(spark, docs, folder).cache()
    kept = {r["doc_id"] for r in QUERIES["op4_quality_rules"](spark, folder).filter("kept").collect()}
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == kept
    from test_dedup import brute_components, brute_strings, fingerprint

    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    prints = [fingerprint(t) for _, t in rows]
    roots = brute_components([d for d, _ in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    two = cp.near_dedup(spark, one, folder).cache()
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == set(roots)
    three = cp.string_dedup(spark, two, folder).cache()
    left = brute_strings([(r["doc_id"], r["text"]) for r in two.collect()])
    assert three.columns == columns and three.count() == two.count()
    for r in three.collect():
        n, removed, _, sha = left[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) and len(r["text"].encode()) <= n - removed
        if r["text"].isascii() and len(r["text"]) == n - removed:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == sha
    four = cp.mix(spark, three, folder).cache()
    times = {r["doc_id"]: r["times"] for r in mixing.mixed(three).select("row.doc_id", "times").collect()}
    assert four.columns == columns and Counter(r["doc_id"] for r in four.collect()) == Counter({d: n for d, n in times.items() if n})
    five = cp.tokenize(spark, four, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in four.collect()}
    assert len(five) == four.count() and all(r["intact"] and r["ids"] == TIKTOKEN.encode_ordinary(texts[r["doc_id"]]) for r in five)
    whole = cp.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in whole) == Counter((r["doc_id"], r["n_tokens"]) for r in five)
