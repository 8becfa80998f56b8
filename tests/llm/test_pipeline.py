"""The corpus pipeline against brute-force versions of its stages."""

import collections

import corpus_pipeline
from millrace.llm import langid, packing
from tests.llm.test_dedup import brute_jaccard
from tests.llm.test_text_ops import check_packing


def brute_cut(docs):
    first, out = {}, {}
    for d, t in sorted(docs.items()):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], d)
    for d, t in docs.items():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        out[d] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf)
        if name != "best_fit_packing":
            assert out.columns == columns
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.stage(out, name)
        rows = docs.collect()
        if name == "language_id":
            assert len(rows) >= 0.97 * len(before)
        elif name == "quality_classifier":
            good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in rows}
            known = [d for d in before if d in good]
            assert sum((d in kept) == bool(good[d]) for d in known) / len(known) > 0.95
        elif name == "jaccard_join":
            want = {d for d, (c, _, k) in brute_jaccard(before).items() if k}
            assert {r["doc_id"] for r in rows} == want
        elif name == "suffix_dedup":
            assert {r["doc_id"]: r["text"] for r in rows} == brute_cut(before)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        else:
            check_packing(rows, {d: t or "" for d, t in before.items()})


def test_stages_on_odd_rows(spark):
    rows = [(1, "Some words in one language here", "en", "s", 3, 1), (2, None, "en", None, None, 2), (None, "Some words in one language here", "en", "s", 3, 3), (4, "", None, "s", 0, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _quality int")
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, df, "")
        assert out.count() >= 0
        assert step(spark, df.limit(0), "").count() == 0
        if name == "jaccard_join":
            assert collections.Counter(r["doc_id"] for r in out.collect())[None] == 1


def test_run_reads_and_writes_every_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
    assert langid.UND == "und" and packing.CapacityTree(3).tightest(1) is None
