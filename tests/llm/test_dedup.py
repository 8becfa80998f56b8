"""Suffix dedup, Jaccard join and vector near-duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, jaccard, neardup, queries, search, suffix


def brute_removed(docs):
    """Cover of each text by 50-byte strings that start in a document with a smaller id."""
    first, out = {}, {}
    for d, t in sorted(docs.items()):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], d)
    for d, t in docs.items():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone & np.r_[True, ~gone[:-1]]).sum()) if len(b) else 0
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    v = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passages = [words(rng, 30, v) for _ in range(4)]
    docs = {}
    for d in range(120):
        t = words(rng, rng.randint(0, 60), v)
        if d % 3 == 0:
            t += " " + rng.choice(passages) + " " + words(rng, 20, v)
        docs[d * 7 % 1201] = t
    docs.update({2000: docs[7], 2001: docs[7], 2002: None, 2003: "", 2004: "ab" * 400, 2005: "ab" * 300, 2006: "x" * 49, 2007: "x" * 49, 2008: "x" * 50, 2009: "x" * 51, 2010: words(rng, 9000, v)})
    docs[2011] = docs[2010][1000:20000]
    base = words(rng, 200, v).split()
    for d in range(40):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "zz%d" % d
        docs[3000 + d] = " ".join(w)
    return docs


def test_suffix_equals_brute_force(spark, corpus):
    df = spark.createDataFrame([(d, t, "en") for d, t in corpus.items()], "doc_id long, text string, key string")
    got = {r["key"]: tuple(r)[1:] for r in suffix.dedup_digests(df).collect()}
    assert got == brute_removed(corpus)


@pytest.mark.parametrize("hot", [1, 3, 20])
def test_suffix_hot_anchors(spark, corpus, monkeypatch, hot):
    """Anchors of more than a few documents ship their windows one by one."""
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "LOT_BYTES", 20_000)
    df = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    got = {r["key"]: tuple(r)[1:] for r in suffix.dedup_digests(df).collect()}
    assert got == brute_removed(corpus)


def test_suffix_repeated_rows(spark):
    t = "a common passage of well over fifty bytes that stands in both"
    df = spark.createDataFrame([(1, t), (1, t), (2, "x " + t), (2, "x " + t), (2, "x " + t)], "doc_id long, text string")
    got = sorted((r["key"], r["n_removed"]) for r in suffix.dedup_digests(df).collect())
    assert got == [(1, 0)] * 2 + [(2, len(t))] * 3


def test_suffix_lots_scatter_strides(spark):
    ids = np.arange(0, 33 * 6000, 33)
    df = spark.createDataFrame([(int(i),) for i in ids], "id long")
    got = [r[0] for r in df.select(suffix._lot(F.col("id"), 33)).collect()]
    assert got == suffix._dealt(ids, 33).tolist()
    assert max(np.bincount(got, minlength=33)) < 300


def test_suffix_small_lots(spark, corpus, monkeypatch):
    monkeypatch.setattr(suffix, "SORT_BYTES", 4000)
    own = {d: t for d, t in corpus.items() if d < 2000 or d >= 3000}
    texts = [(d, (t or "")) for d, t in own.items()]
    ids, start, parts = [], [], []
    data, begin, size = suffix.join_texts([t.encode() for _, t in texts])
    o, a, z, key = suffix.runs(data, begin, size)
    ids = np.array([texts[i][0] for i in o])
    raw = data.tobytes()
    d, p, q = suffix.settle(ids, a - begin[o], [raw[x : y + 50] for x, y in zip(a, z)])
    want = brute_removed(own)
    for doc, t in texts:
        gone = np.zeros(len(t.encode()), bool)
        for i, x, y in zip(d, p, q):
            if i == doc:
                gone[x:y] = True
        assert int(gone.sum()) == want[doc][1]


def test_suffix_survives_hash_collisions(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    where = np.arange(2900)
    s = suffix.Suffixes(data)
    s.hash.of = lambda p, n: (np.asarray(p) * 0).astype(np.uint64)  # everything collides
    got, cls = s.classes(where, np.zeros(len(where), np.int64))
    b = data.tobytes()
    strings = [b[i : i + 50] for i in got]
    assert strings == sorted(strings)
    assert (np.diff(cls) == [x != y for x, y in zip(strings, strings[1:])]).all()


def test_suffix_texts_null_ids_empty_tables(spark):
    t = "a common passage of well over fifty bytes that stands in both"
    df = spark.createDataFrame([(1, t + " one", 5), (2, "two é" + t, 6), (None, t, 7), (3, None, 8)], "doc_id long, text string, lot int")
    got = {r["doc_id"]: (r["text"], r["lot"]) for r in suffix.dedup_texts(df).collect()}
    assert got == {1: (t + " one", 5), 2: ("two é", 6), None: (t, 7), 3: (None, 8)}
    assert suffix.dedup_digests(df.limit(0)).count() == 0
    assert suffix.dedup_texts(df.limit(0)).columns == df.columns


def brute_jaccard(docs, threshold=0.8):
    def sh(t):
        w = re.findall(r"\w+", (t or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()

    s = {d: sh(t) for d, t in docs.items()}
    ids = sorted(s)
    links, parent = {d: 0 for d in ids}, {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b] and len(s[a] & s[b]) >= threshold * len(s[a] | s[b]) - 1e-12:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (find(d), links[d], find(d) == d) for d in ids}


def test_jaccard_equals_brute_force(spark, corpus):
    df = spark.createDataFrame([(d, t, "x") for d, t in corpus.items()] + [(None, "a b c d e f", "y")], "doc_id long, text string, key string")
    got = {r["key"]: (r["class_id"], r["n_links"], r["kept"]) for r in jaccard.join(df).collect()}
    want = brute_jaccard(corpus)
    assert got == want
    assert max(w[1] for w in want.values()) > 10


def test_jaccard_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 7)
    df = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    got = {r["key"]: (r["class_id"], r["n_links"], r["kept"]) for r in jaccard.join(df).collect()}
    assert got == brute_jaccard(corpus)


def test_jaccard_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b, c d e f!")], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.join(df).collect())
    assert got == [(1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False)]
    assert jaccard.join(df.limit(0)).count() == 0



def test_forest_depth():
    assert jaccard.depth_for(0.8, 16, 8, 0.9995) == 4
    assert jaccard.depth_for(0.8, 16, 8, 0.5) > 4


def test_prefixes_are_shortened_as_far_as_what_was_seen_asks_for():
    assert jaccard.shortened({47: 9000, 49: 100}, 8, 0.8, 0.9995) == 8  # only pairs of 0.94 and more
    assert jaccard.shortened({43: 1, 49: 9000}, 8, 0.8, 0.9995) == 6
    assert jaccard.shortened({40: 1, 49: 9000}, 8, 0.8, 0.9995) == 4  # as far as pairs at the threshold need
    assert jaccard.shortened({49: 30}, 8, 0.8, 0.9995) == 4  # too few to show it
    assert jaccard.shortened({}, 8, 0.8, 0.9995) == 4
    assert jaccard.shortened({41: 50}, 8, 0.8, 0.9) == 8


def near_pairs(n):
    """Pairs of texts with similarities of 0.80 to 0.85: 100 words, a stretch of them replaced at one end."""
    rng = random.Random(8)
    docs = {}
    for i in range(n):
        w = ["w%d" % rng.randrange(10**6) for _ in range(104)]
        gone = rng.randint(8, 11)  # 100 shingles, `gone` of them replaced: (100 - gone) / (100 + gone)
        docs[2 * i], docs[2 * i + 1] = " ".join(w), " ".join(["v%d" % rng.randrange(10**6) for _ in range(gone)] + w[gone:])
    return docs


@pytest.mark.parametrize(("target", "least"), [(0.9, 0.9), (0.9995, 0.998)])
def test_recall_near_the_threshold(spark, target, least):
    docs = near_pairs(2500)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["key"]: r["n_links"] for r in jaccard.join(df, target=target).collect()}
    assert sum(got.values()) <= len(docs)
    assert sum(got.values()) / len(docs) >= least


@pytest.mark.parametrize(("block", "pairs"), [(2048, 24), (40, 3), (7, 1)])
def test_nodes_in_blocks(spark, monkeypatch, block, pairs):
    """Large nodes are dealt to blocks whose representatives outside the largest component meet all of the node."""
    import pandas as pd

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, (6, jaccard.TREES * jaccard.DEPTH)).astype(">u2")
    sig = base[rng.integers(0, 6, 150)]
    sig[rng.random(sig.shape) < 0.05] = 7
    sig[:, :4] = 5  # one node of the first tree
    rows = pd.DataFrame({"tree": 0, "node": 1, "block": np.arange(150) % -(-150 // block), "rep": np.arange(150), "group": np.arange(150), "grams": 100, "sig": [x.tobytes() for x in sig]})
    monkeypatch.setattr(jaccard, "ALL_PAIRS", pairs)
    found = [jaccard.below(rows, 0.8, 4).dropna()]
    same = lambda e: search.labels(150, e["a"].to_numpy(np.int64), e["b"].to_numpy(np.int64))
    rows["group"] = same(found[0])
    most = rows["group"].mode()[0]
    parts = [rows[rows["group"] != most].assign(side=0), rows.assign(side=1)]
    found.append(jaccard.across(pd.concat(parts, ignore_index=True).assign(i=0, j=0), 0.8).dropna())
    label = same(pd.concat(found))
    alike = (sig[:, None] == sig[None]).mean(2) >= 0.8 - 5.5 * (0.16 / sig.shape[1]) ** 0.5
    assert (label[:, None] == label[None])[alike].all()
    assert len(np.unique(label)) == len(np.unique(search.labels(150, *np.nonzero(alike))))


def test_hub_join_deals_hot_keys(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 0, id) AS k")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = components.hub_join(rows, table, ["k"], "n", 3000).collect()
    assert len(got) == 3000 and {r["n"] for r in got if r["k"] == 0} == {1000}


def test_query_jaccard_on_documents(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in queries.QUERIES["op3_jaccard_forest"](spark, sf).collect()}
    assert got == brute_jaccard(docs)


def test_query_suffix_on_documents(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op9_suffix_dedup"](spark, sf).collect()}
    assert got == brute_removed(docs)


def brute_vectors(rows, threshold=0.93):
    ok = {i: np.array(v, float) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    lab = {i: x for i, _, x in rows}
    ids = sorted(i for i, _, _ in rows if i is not None)
    parent, links = {i: i for i in ids}, {i: 0 for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if a in ok and b in ok and lab[a] == lab[b] and len(ok[a]) == len(ok[b]):
                x, y = ok[a], ok[b]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (links[i], find(i), find(i) == i) for i in ids}


def test_vectors_equal_brute_force(spark, sf):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.QUERIES["op7_itq_neardup"](spark, sf).collect()}
    assert got == brute_vectors(rows)


def test_vectors_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.05 * rng.standard_normal(16)).tolist(), 1) for i in range(30)] + [(30 + i, rng.standard_normal(16).tolist(), 1) for i in range(30)]
    rows += [(100, rows[0][1], 1), (101, rows[0][1], 1), (102, rows[0][1], 2), (103, rows[0][1], None), (104, None, 1), (105, [], 1), (106, [0.0] * 16, 1), (107, [float("nan")] * 16, 1), (108, [float("inf")] + [0.0] * 15, 1), (109, [None] + [1.0] * 15, 1), (110, [1.0] * 3, 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    got = {r["key"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_vectors(rows)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [10, 1500])
def test_vectors_of_several_lengths(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = []
    for n, d in [(40, 16), (30, 24), (4, 16), (2, 3)]:
        base = rng.standard_normal(d)
        rows += [(len(rows) + i, (base + 0.05 * rng.standard_normal(d)).tolist(), i % 2) for i in range(n)]
    rows += [(1000, rows[50][1], rows[50][2]), (1001, rows[50][1] + [0.0], rows[50][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["key"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_vectors(rows)
    assert got[1000][0] > 10


@pytest.mark.parametrize("width", [8, 14, 21])
def test_recall_of_the_tables(spark, monkeypatch, width):
    """Pairs at a cosine of 0.93 to 0.95 among unlike vectors, at several key widths."""
    monkeypatch.setattr(neardup, "width_for", lambda n: width)
    rng = np.random.default_rng(width)
    n, d = 400, 64
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n, d))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 0.95, (n, 1))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["key"]: r["n_links"] for r in neardup.near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.985 * 2 * n
    assert max(got.values()) == 1


def test_large_buckets_of_vectors(spark, monkeypatch):
    """Buckets beyond a block: what is outside their largest component meets them whole."""
    monkeypatch.setattr(search, "BLOCK", 9)
    monkeypatch.setattr(neardup, "BLOCK", 20)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((3, 16))
    rows = [(i, (base[i % 3] + (0.02 + 0.3 * (i % 7 == 0)) * rng.standard_normal(16)).tolist(), 1) for i in range(120)]
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["key"], r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    want = brute_vectors([(i if n < 120 else 1000 + n, v, lab) for n, (i, v, lab) in enumerate(rows)])
    want = sorted((i if i < 1000 else 5, *w[:2], i == w[1] or i >= 1000 and w[1] == 5) for i, w in want.items())
    assert got == want


def test_components_of_a_path(spark):
    n = 40
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["vertex"]: r["component"] for r in components.components(e).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}
