"""BPE, packing, FLAC, chat formatting, language ID, quality, toxicity."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from millrace.llm import bpe, chat, flac, langid, packing, quality, queries, sampling, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", " ", "  x  y", "<|endoftext|>", "a <|endoftext|> b", "it's I'll  we\n\n x", "aaaa" * 3000, "é ² x ½ y", "日本語 テキスト a b", "x" * 70 + " y" * 200, "tab\tx y\r\nz  <|endoftext|>foo bar", "don't 've 's a b's c", "a b " * 2000, "1 2 3 a 4 b c" * 300, " a b c \x1c d \x85 e"]


def direct(path, texts):
    t = bpe.tokenizer(path)
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def random_texts(n, seed=0):
    rng = random.Random(seed)
    alphabet = "aabbcde  \n'.!?12é²日<|>"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 900))) for _ in range(n)]


@pytest.mark.parametrize("texts", [ODD, random_texts(150)])
def test_chunked_encoding_is_exact(texts):
    e = bpe.Encoder(BYTE)
    got = e.encode(texts)
    assert got == direct(BYTE, texts)
    assert e.encode(texts) == got  # from the caches
    t = bpe.tokenizer(BYTE)
    for ids in got:
        assert bpe.decode(BYTE, ids) == t.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_encoder_with_tiny_caches_is_exact():
    e = bpe.Encoder(BYTE, cache_chars=100, cache_words=20)
    for t in ODD + random_texts(30, 3):
        assert e.encode([t]) == direct(BYTE, [t])


def test_shared_chunks_are_encoded_once():
    e = bpe.Encoder(BYTE)
    rng = random.Random(1)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(800))
    e.encode([passage])
    before = len(e.ids)
    e.encode(["something else first " + passage + " and last"])
    assert len(e.ids) - before < before / 3


def test_cuts_bound_chunks():
    for t in [*ODD, "q" * 20000]:
        c = bpe.cuts(t)
        assert (c[-1] if c else 0) == len(t)
        assert all(b - a <= bpe.MOST for a, b in zip([0, *c], c))


def test_bpe_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r, ids in zip(rows, direct(BYTE, [r["text"] or "" for r in rows])):
        want[r["doc_id"]] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op2_bpe_chunks"](spark, sf).collect()}
    assert got == want


def test_bpe_null_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b")], "doc_id long, text string, ids string")
    got = sorted(tuple(r) for r in bpe.encode_digests(df, BYTE).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert got == [(1, 0, empty, empty), (2, 0, empty, empty), (2, 0, empty, empty)]
    assert [r["ids"] for r in bpe.encode_documents(df, BYTE).collect()] == [b""] * 3
    assert bpe.encode_digests(df.limit(0), BYTE).count() == 0


@pytest.mark.parametrize("texts", [ODD, random_texts(150, 2)])
def test_word_encoding_is_exact(texts):
    assert packing.WordEncoder(WORD).encode(texts) == direct(WORD, texts)
    w = packing.WordEncoder(WORD, limit=5)
    assert [w.encode([t])[0] for t in texts] == direct(WORD, texts)


def reference_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        room = [i for i, b in enumerate(bins) if b >= n]
        if room:
            bins[min(room, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(100):
        cap = rng.choice([1, 10, 37, 64])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 120))]
        used = collections.defaultdict(list)
        for n, a, z, first, each, off in packing.best_fit(dict(collections.Counter(lengths)), cap):
            for r in range(a, z):
                used[first + (r - a) // each].append((off + (r - a) % each * n, n))
        for v in used.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            assert at <= cap
        assert sorted(cap - sum(n for _, n in v) for v in used.values()) == reference_best_fit(lengths, cap)


def check_packing(rows, texts, capacity=2048):
    by_doc, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    for d, t in texts.items():
        ids = direct(WORD, [t])[0] + b"\0\0\0\0"
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, k * capacity)
            part = ids[4 * r["start"] : 4 * (r["start"] + r["length"])]
            assert zlib.crc32(part) == r["ids_crc32"] and len(part) == 4 * r["length"]
        assert sum(r["length"] for r in own) == len(ids) // 4
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing_query(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_best_fit_packing"](spark, sf).collect()
    n = check_packing(rows, texts)
    assert n == len(reference_best_fit([r["length"] for r in rows], 2048))


def test_packing_buckets_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "a b c " * 2000, 9), (3, "word", 9), (3, "word", 9)], "doc_id long, text string, length int")
    p = packing.pieces(df, WORD)
    rows = packing.pack(p, rows_per_bucket=1).withColumnRenamed("key", "doc_id").collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) == 6
    assert sum(r["length"] for r in rows) == 1 + 6001 + 2 + 2
    assert packing.pack(packing.pieces(df.limit(0), WORD)).count() == 0


MISC = [b"", b"a", b"abc", bytes(5000), bytes(random.Random(1).randrange(256) for _ in range(3000)), bytes(int(128 + 90 * np.sin(i / 9)) for i in range(4000)), bytes([0, 255] * 700), b"plain words " * 300]


@pytest.mark.parametrize("order", [0, 1, 4, 8, 12])
def test_flac_round_trip(order):
    streams = flac.encode(MISC, lpc_order=order)
    assert flac.decode(streams) == MISC
    assert len(streams[3]) < 300 and (order < 4 or len(streams[5]) < 1500)


def test_flac_blocks_are_seekable():
    p = b"some words to store " * 400
    (blocks,) = flac.decode_blocks(flac.encode([p]))
    for at, pcm in blocks:
        assert p[at : at + len(pcm)] == pcm
    assert len(blocks) == -(-len(p) // flac.BLOCK)


def test_flac_damage_is_found():
    (s,) = flac.encode([b"some words to store " * 300])
    _, _, _, points, at = flac._metadata(s)
    for where in (at + 40, at + points[1][1] + 3, len(s) - 1, 30):
        bad = bytearray(s)
        bad[where] ^= 0x10
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_flac_without_seek_points():
    p = b"some words to store " * 300
    (s,) = flac.encode([p])
    n = int.from_bytes(s[43:46], "big")
    bare = s[:4] + b"\x80" + s[5:42] + s[46 + n :]
    assert flac.decode([bare, s]) == [p, p]


def test_flac_partitions_and_escapes():
    """A stream written bit by bit: fixed order 1, two partitions, one Rice coded and one escaped."""
    x = [3, 5, 4, 4, 7, -6, 2, 0, 1, 1, 1, 1, 2, 2, 2, 3]
    res = np.diff(x).tolist()
    bits = "0" + "001001" + "0" + f"{x[0] & 255:08b}" + "00" + "0001" + "0010"
    for r in res[:7]:
        z = r * 2 if r >= 0 else -2 * r - 1
        bits += "0" * (z >> 2) + "1" + f"{z & 3:02b}"
    bits += "1111" + f"{4:05b}" + "".join(f"{r & 15:04b}" for r in res[7:])
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 6 << 4, 0x02, 0, 15])
    frame = head + bytes([flac.crc8(head)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame += int(flac.crc16([frame])[0]).to_bytes(2, "big")
    info = bytes([0, 16, 0, 16]) + bytes(6) + (8000 << 44 | 7 << 36 | 16).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame
    assert flac.decode([stream]) == [bytes((v + 128) & 255 for v in x)]


def test_flac_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op6_flac_media"](spark, sf).collect():
        p = flac.text_payload(texts[r["doc_id"]] or "")
        assert (r["n_bytes"], r["payload_bytes"]) == (len((texts[r["doc_id"]] or "").encode()), len(p)) and len(p) % 192 == 0
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-16:])
        assert r["feature"] == flac.feature(p)


def test_flac_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 900, "x"), (3, "word " * 900, "x")], "doc_id long, text string, media string")
    stored = flac.media(df)
    rows = {(r["key"], r["payload_bytes"], r["media_sha256"]) for r in flac.digests(stored).collect()}
    assert len(rows) == 3 and {r[:2] for r in rows} == {(1, 192), (2, 192), (3, 4608)}
    blocks = flac.pcm_blocks(stored).where("key = 3").dropDuplicates(["block"]).orderBy("block").collect()
    assert b"".join(r["pcm"] for r in blocks) == flac.text_payload("word " * 900)
    assert flac.digests(flac.media(df.limit(0))).count() == 0


def test_chat_round_trip(spark):
    said = ["", "<|end|>\n", "<&|x", "a<|turn|>b", "plain\nlines", "<|role:user|>\n", "<<&&|", "&|"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "a|b%7C"]), rng.choice([*said, None])) for c in range(6) for t in range(rng.choice([1, 2, 200]))]
    rows += [(50, 0, None, "x"), (50, None, "user", "first"), (50, 0, None, "x"), (None, 0, "user", "alone"), (60, 3, "assistant", "b"), (60, 3, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seg int")
    out = chat.format_conversations(df).withColumn("full", chat.formatted(chat.F.col("segments")))
    got = {r["conv_id"]: r for r in out.withColumn("t", chat.read_turns(chat.F.col("full"))).withColumn("loss", chat.read_loss(chat.F.col("segments"))).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    assert got.keys() == by.keys()
    for c, v in by.items():
        v.sort()
        assert [tuple(x) for x in got[c]["t"]] == [(r, x) for _, r, x in v]
        assert got[c]["loss"] == "".join(x for _, r, x in v if r == "assistant")
        switches = 1 + sum(a[1] != b[1] for a, b in zip(v, v[1:]))
        assert got[c]["full"].count("<|role:") == got[c]["full"].count("<|end|>") == switches
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = {r[0]: r[1:] for r in c.execute(queries.ORACLE_SQL["op10_chat_format"]).fetchall()}
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op10_chat_format"](spark, sf).collect()}
    assert got == want


def test_language_held_out_accuracy(spark, sf):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_language_id"](spark, sf).collect()
    assert {r["doc_id"] for r in rows} == docs.keys()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) / len(held) > 0.97


def test_language_backs_off(spark):
    model = langid.build([("en", "the", 9), ("en", "thing", 3), ("fr", "les", 9), ("fr", "chose", 3), ("fr", "choses", 1)])
    assert model.predict(["the the", "les", "chosent", None, "", "123 !", "thin"])[0] == ["en", "fr", "fr", "und", "und", "und", "en"]
    model.limit = 1
    assert model.predict(["qq rr ss tt", "choser"])[0][1] == "fr"
    lang, score = model.predict(["日本"])
    assert lang == ["fr"] and 0 < score[0] < 1
    assert langid.build([]).predict(["x"]) == (["und"], [0.0])
    df = spark.createDataFrame([(1, None, None, "x")], "doc_id long, text string, lang string, score string")
    empty = langid.fit(df.limit(0))
    assert tuple(df.select(langid.predict(empty, df).alias("p")).first()["p"]) == ("und", 0.0)


def test_quality_on_labels(spark, sf):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op1_quality_classifier"](spark, sf).collect()
    known = [r for r in rows if r["doc_id"] in label]
    assert sum(r["kept"] == bool(label[r["doc_id"]]) for r in known) / len(known) > 0.95


def test_quality_expectation_maximisation():
    rng = random.Random(3)
    counts, truth = collections.Counter(), collections.defaultdict(list)
    for _ in range(4000):
        good = rng.random() < 0.8
        p = 0
        for k in range(len(quality.LABELLERS)):
            bad = rng.random() < (0.02 if good else 0.3 + 0.05 * k)
            p = 3 * p + (quality.NONE if rng.random() < 0.1 else quality.BAD if bad else quality.GOOD)
        counts[p] += 1
        truth[p].append(good)
    posterior, table, prior = quality.expectation_maximisation(counts)
    right = sum(sum((posterior[p] >= 0.5) == g for g in v) for p, v in truth.items())
    assert right / 4000 > 0.95 and abs(prior - 0.8) < 0.05
    assert (table[:, 1, quality.BAD] > table[:, 0, quality.BAD]).all()
    assert quality.expectation_maximisation({})[2] == 0.5


def test_quality_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "a good line of words", 1), (2, " ", 1), (3, "a good line of words", 1), (3, "a good line of words", 1)], "doc_id long, text string, score int")
    model = quality.fit(df)
    rows = df.select("doc_id", quality.judge(model, df).alias("q")).collect()
    assert [r["q"]["score"] == 0 for r in rows] == [True, False, True, False, False]
    assert quality.fit(df.limit(0)).posterior == {}


def test_toxicity_held_out():
    rng = random.Random(5)
    syllables = ["ka", "to", "mi", "re", "su", "no", "lan", "dor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    bad = ["idiot", "worthless", "clown"]
    docs = []
    for i in range(900):
        t = text(rng.randint(5, 60))
        if i % 3 == 0:
            t[rng.randrange(len(t))] = rng.choice(bad)
        docs.append((" ".join(t), i % 3 == 0))
    train, test = docs[:600], docs[600:]
    model = toxicity.build([t for t, y in train if y], [t for t, y in train if not y])
    s = model.scores([t for t, _ in test])
    assert np.mean([(p >= 0.5) == y for p, (_, y) in zip(s, test)]) > 0.97
    spelled = model.scores(["kato i d i o t mire", "ka wor-th-less", "ka c.l.o.w.n", "kato mire", "", "ka " * 30])
    assert (spelled[:3] > 0.5).all() and (spelled[3:] < 0.5).all()
    assert (toxicity.build([], ["a"]).scores(["x"]) < 0.01).all()


def test_toxicity_learns_rare_and_short_insults():
    rng = random.Random(8)
    syllables = ["ka", "to", "mi", "re", "su", "no", "lan", "dor"]
    text = lambda: ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 40))]
    rare = [f"{a}{b}x{c}" for a in "bghpw" for b in ("zze", "vvi", "qua") for c in ("ub", "eg")] + ["zug"]
    put = lambda bad: " ".join([*text(), bad, *text()])
    model = toxicity.build([put(b) for b in rare for _ in range(3)], [" ".join(text()) for _ in range(300)])
    assert np.mean(model.scores([put(b) for b in rare]) >= 0.5) > 0.9
    assert model.scores([put("zug")])[0] >= 0.5
    assert np.mean(model.scores([" ".join(text()) for _ in range(200)]) >= 0.5) < 0.05


def test_toxicity_kernel_is_the_subsequence_kernel():
    def brute(a, b):
        def feats(w):
            out = collections.Counter()
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                        if (w[i] + w[j] + w[k]).isalpha():
                            out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        x, y = feats(a), feats(b)
        dot = lambda p, q: sum(v * q[c] for c, v in p.items())
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    words = ["idiot", "idiots", "i-diot", "clown", "claown", "banana"]
    got = toxicity._Kernel(words)(words)
    want = [[brute(a, b) for b in words] for a in words]
    assert np.allclose(got, want, atol=1e-4)


def test_toxicity_query(spark, sf):
    rows = queries.QUERIES["op5_toxicity"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a clown", "x"), (2, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert docs.select(toxicity.score(model, docs)).count() == 3
    assert toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 5, 100).collect()[0]["label"] == 1


def test_toxicity_sample_passes_over_long_texts(spark):
    docs = spark.createDataFrame([(i, "x" * (5 if i % 4 == 0 else 50)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 4 % 2) for i in range(80)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 8, 10).collect()
    assert collections.Counter(r["label"] for r in rows) == {0: 8, 1: 8}


def test_samples_are_bounded_by_rows(spark):
    """Rows that repeat an id, however many, are one row of a sample; ids of other classes don't suffer from them."""
    rows = [(7, "a word that many rows say", 1)] * 3000 + [(i, "text number %d of this class" % i, i % 2) for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = sampling.lowest(df, "label", "doc_id", 5).collect()
    assert len(got) == 10 and len({r["doc_id"] for r in got}) == 10
    labels = df.select("doc_id", F.col("label").alias("toxic")).distinct()
    assert toxicity.training_rows(df.select("doc_id", "text"), labels, "doc_id", "text", "toxic", 20, 1000).count() == 40
    assert langid.training_rows(df.withColumn("lang", F.col("label").cast("string")), "lang", "text", "doc_id", 20, 1000).count() == 40
    long = df.withColumn("text", F.when(F.col("label") == 1, F.repeat("text", 100)).otherwise(F.col("text")))
    assert {r["label"] for r in toxicity.training_rows(long.select("doc_id", "text"), labels, "doc_id", "text", "toxic", 20, 10_000).collect()} == {0, 1}


def test_inserted_letters_keep_insults(sf):
    """Insults that no clean word is near to are still caught with a letter inserted, and clean words are left alone."""
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "te", "ru", "so", "ne", "pa", "di", "vu"]
    clean = [" ".join("".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(40)) for _ in range(300)]
    insults = ["blockhead", "dimwit", "scoundrel", "numskull", "jackanapes"]
    toxic = [f"{t} {rng.choice(insults)} {rng.choice(insults)}" for t in clean[:80]]
    model = toxicity.build(toxic, clean[80:], toxicity.Bounds(landmarks=120, rounds=3))
    assert (model.scores(clean[80:]) < 0.5).all() and (model.scores(insults) >= 0.5).all()
    spoilt = []
    for w in insults:
        for _ in range(20):
            k = rng.randint(1, len(w) - 1)
            spoilt.append(w[:k] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[k:])
    assert (model.scores(spoilt) >= 0.5).mean() >= 0.9
    assert (model.scores(["-".join(w) for w in insults]) >= 0.5).all()
