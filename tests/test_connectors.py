"""Encoders, warehouse sink, acknowledgements, store, broker options, backfills, scripted lanes."""

import datetime as dt
import gzip
import random
import struct
from decimal import Decimal

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.config import BatchConfig, ConfigError
from millrace.operators import acks, encoders, warehouse
from millrace.operators.chain import Pipeline
from millrace.operators.flow import Breaker, Retry
from millrace.operators.objects import RECORD_BITS, Entry
from millrace.operators.schema_check import TargetColumn as C
from millrace.operators.schema_check import parse_type
from millrace.operators.store import Conflict, MemoryStore
from millrace.sources import backfill, brokers, memory
from millrace.streaming import runtime
from millrace.streaming.runtime import FatalWriteError


def row(kind, value):
    return encoders.row_writer(parse_type(kind))(value)


def test_row_encodings():
    assert row("UInt8", 7) == b"\7" and row("Int64", -1) == b"\xff" * 8 and row("Bool", True) == b"\1"
    assert row("String", "é") == b"\x02\xc3\xa9" and row("FixedString(3)", "a") == b"a\0\0"
    assert row("Nullable(UInt8)", None) == b"\1" and row("Nullable(UInt8)", 3) == b"\0\3"
    assert row("Array(UInt8)", [1, 2]) == b"\2\1\2" and row("Map(String, UInt8)", {"a": 1}) == b"\1\1a\1"
    assert row("Tuple(UInt8, String)", [1, "x"]) == b"\1\1x" and row("LowCardinality(Nullable(String))", None) == b"\1"
    assert row("Decimal(9, 2)", Decimal("1.505")) == struct.pack("<i", 151) and row("Decimal(18, 2)", Decimal("-1.505")) == struct.pack("<q", -151)
    assert row("Date", dt.date(1970, 1, 3)) == b"\2\0" and row("DateTime64(3)", dt.datetime(1970, 1, 1, 0, 0, 1)) == struct.pack("<q", 1000)
    assert row("UUID", "00112233-4455-6677-8899-aabbccddeeff").hex() == "7766554433221100ffeeddccbbaa9988"
    assert row("IPv4", "1.2.3.4") == b"\4\3\2\1" and row("Int128", -2) == (-2).to_bytes(16, "little", signed=True)
    assert row("Ring", [[0.0, 1.0]]) == b"\1" + struct.pack("<dd", 0, 1)
    for kind, bad in (("UInt8", 256), ("UInt8", None), ("FixedString(1)", "ab"), ("Decimal(3, 0)", 1000), ("Array(UInt8)", 5), ("Date", "x")):
        with pytest.raises(encoders.EncodeError):
            row(kind, bad)


def test_column_encodings():
    col = lambda kind, v: encoders.column_bytes(parse_type(kind), v)
    assert col("Array(UInt8)", [[1, 2], [], [3]]) == struct.pack("<3Q", 2, 2, 3) + b"\1\2\3"
    assert col("Nullable(UInt16)", [5, None]) == b"\0\1" + struct.pack("<HH", 5, 0)
    assert col("Map(String, UInt8)", [{"a": 1}, {}]) == struct.pack("<2Q", 1, 1) + b"\1a\1"
    assert col("Tuple(UInt8, String)", [[1, "x"], [2, "y"]]) == b"\1\2\1x\1y"
    low = col("LowCardinality(String)", ["a", "b", "a", ""])
    assert low == struct.pack("<QQQ", 1, 0x600, 3) + b"\0\1a\1b" + struct.pack("<Q4B", 4, 1, 2, 1, 0)
    null = col("LowCardinality(Nullable(String))", [None, "", "z"])
    assert null == struct.pack("<QQQ", 1, 0x600, 3) + b"\0\0\1z" + struct.pack("<Q3B", 3, 0, 1, 2)
    b = encoders.block([C("id", "UInt8"), C("s", "String")], [[1, "x"], [2, "y"]])
    assert b == b"\2\2" + b"\2id\5UInt8\1\2" + b"\1s\6String\1x\1y"


def test_encode_policy(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abcdef")], "id int, s string")
    columns = [C("id", "UInt8"), C("s", "FixedString(4)")]
    assert [r[0] and bytes(r[0]) for r in df.select(encoders.encode_rows(df, columns)).collect()] == [b"\1abc\0", None]
    with pytest.raises(Exception, match="FixedString"):
        df.select(encoders.encode_rows(df, columns, "fail")).collect()


def test_warehouse_sink(spark, tmp_path):
    out = str(tmp_path)

    def send(endpoint, statement, settings, body):
        with open(f"{out}/{endpoint}-{settings['insert_deduplication_token']}", "wb") as f:
            f.write(statement.encode() + b"\n" + body)

    sink = warehouse.WarehouseSink("db.t", [C("id", "UInt8"), C("s", "String")], ["a", "b"], send, "p", "r")
    df = spark.createDataFrame([(1, "x", 0), (2, "y", 1), (3, "z", 1)], "id int, s string, shard int")
    for _ in range(2):  # a replay has the same tokens
        sink.writer()(df, 4)
    files = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    head = b"INSERT INTO `db`.`t` (`id`, `s`) FORMAT RowBinary\n"
    assert files == {"a-p-r-0-4": head + b"\1\1x", "b-p-r-1-4": head + b"\2\1y\3\1z"}
    assert warehouse.classify("Code: 60. DB::Exception") == "fatal" and warehouse.classify("Code: 241") == warehouse.classify("timeout") == "retryable"
    with pytest.raises(ValueError):
        warehouse.insert_statement("t; drop", ["a"])
    with pytest.raises(ValueError):
        warehouse.WarehouseSink("t", [], ["a"], send, settings={"wait_end_of_query": "0"})

    def refuse(*_):
        raise RuntimeError("Code: 60. no such table")

    with pytest.raises(Exception, match="no such table"):
        warehouse.WarehouseSink("t", [C("id", "UInt8")], ["a"], refuse).writer()(df.limit(1), 0)
    assert issubclass(FatalWriteError, RuntimeError)


def test_ack_set():
    a = acks.AckSet().clone()
    assert a.deliver() is None and a.deliver() == "delivered"
    b = acks.AckSet().clone()
    b.drop()
    assert b.deliver() == "failed"
    with pytest.raises(ValueError):
        b.deliver()


@settings(max_examples=50)
@given(st.lists(st.sampled_from(["delivered", "failed"]), max_size=12), st.randoms())
def test_tracker_is_the_contiguous_prefix(states, rng):
    t = acks.PartitionTracker()
    for i in range(len(states)):
        t.register(i, 10 * i + 9)
    order = list(range(len(states)))
    rng.shuffle(order)
    known: dict[int, str] = {}
    for i in order:
        assert t.resolve(i, states[i]) == "ok" and t.resolve(i, states[i]) == "duplicate"
        known[i] = states[i]
        t.advance()
        n = 0
        while known.get(n) == "delivered":
            n += 1
        assert t.committed == (10 * n if n else None) and t.stalled == (known.get(n) == "failed")
    assert t.resolve(99, "delivered") == "ahead"
    with pytest.raises(ValueError):
        t.register(99, 0)


def test_checkpointer_epochs():
    c = acks.Checkpointer()
    c.begin_epoch([0, 1], 1)
    c.register(0, 0, 9)
    c.register(1, 0, 4)
    assert c.resolve(1, 0, 0, "delivered") == "ok" and c.take_watermarks() == {0: 10} and c.take_watermarks() == {}
    assert not c.drained
    c.extend_epoch([2])
    with pytest.raises(ValueError):
        c.extend_epoch([0])
    c.resolve(1, 1, 0, "delivered")
    assert c.revoke([1]) == {1: 5} and c.take_watermarks() == {} and c.drained
    with pytest.raises(ValueError):
        c.extend_epoch([1])
    c.begin_epoch([0], 2)
    assert c.resolve(1, 0, 0, "delivered") == "stale" and c.stale == 1
    with pytest.raises(ValueError):
        c.begin_epoch([0], 2)


def test_store():
    now = [0.0]
    s = MemoryStore(lambda: now[0])
    r = s.create("a/1", b"x")
    with pytest.raises(Conflict):
        s.create("a/1", b"y")
    r2 = s.update("a/1", b"y", r)
    with pytest.raises(Conflict):
        s.update("a/1", b"z", r)
    s.create("a/2", b"t", ttl=5)
    assert list(s.list("a/")) == ["a/1", "a/2"]
    now[0] = 5
    assert s.get("a/2") is None and list(s.list("a/")) == ["a/1"]
    s.delete("a/1", r2)
    assert [(k, v) for _, k, v in s.watch("a/", r2)] == [("a/2", b"t"), ("a/2", None), ("a/1", None)]


def test_broker_options(spark):
    s = brokers.BrokerSource("b:1", "t", "g", {"fetch.min.bytes": 5}, 100)
    assert s.options()["kafka.fetch.min.bytes"] == "5" and s.options()["maxOffsetsPerTrigger"] == "100"
    for bad in ({"properties": {"group.id": "x"}}, {"topic": " "}, {"properties": {"partition.assignment.strategy": "cooperative-sticky"}}):
        with pytest.raises(ConfigError):
            brokers.BrokerSource(**({"brokers": "b", "topic": "t", "group_id": "g"} | bad))
    with pytest.raises(ConfigError):
        brokers.BrokerSink("b", "t", properties={"acks": "1"})
    sink = brokers.BrokerSink("b", "t", 10)
    assert sink.options()["kafka.acks"] == "all"
    df = spark.createDataFrame([(b"k", b"123456789", None), (b"k", b"1234567890", None), (None, b"1", [("hh", b"12345678")])], "key binary, value binary, headers array<struct<key: string, value: binary>>")
    assert [r[0] for r in df.select(sink.fits(F.col("key"), F.col("value"), F.col("headers"))).collect()] == [True, False, False]
    raw = spark.createDataFrame([(None, b"k", 1, 5, dt.datetime(1970, 1, 1, 0, 0, 1))], "value binary, key binary, partition int, offset long, timestamp timestamp")
    r = brokers.to_envelope(raw).first()
    assert (bytes(r["value"]), r["event_time_ms"]) == (b"", 1000)
    assert brokers.lag({"latestOffset": '{"t":{"0":10,"1":4}}', "endOffset": '{"t":{"0":7}}'}) == {"t-0": 3, "t-1": 4}


def test_backfill(spark, tmp_path):
    z = zstandard.ZstdCompressor()
    files = {"a.ndjson": b"1\r\n\n  \n2\n3", "b.gz": gzip.compress(b"4\n") + gzip.compress(b"5\n"), "c.zst": z.compress(b"6\n") + z.compress(b"7\n"), "d.GZIP": gzip.compress(b"8")}
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    rows = backfill.listing(spark, str(tmp_path)).collect()
    assert {r["key"].rsplit("/", 1)[1]: r["size"] for r in rows} == {k: len(v) for k, v in files.items()}
    splits = backfill.plan([Entry(r["key"], r["size"], r["etag"]) for r in rows], 40)
    table = spark.createDataFrame([(s.ident, i, o.key, 1 if o.key.endswith("a.ndjson") else 0) for s in splits for i, o in enumerate(s.objects)], "split string, ordinal int, key string, from_record long")
    got = backfill.read_splits(spark, table, str(tmp_path)).collect()
    assert sorted(bytes(r["value"]) for r in got) == [b"2", b"3", b"4", b"5", b"6", b"7", b"8"]
    assert len({(r["split"], r["offset"]) for r in got}) == 7
    with pytest.raises(backfill.PoisonedSplit, match="undecodable"):
        list(backfill.records(b"no gzip", "x.gz"))
    with pytest.raises(backfill.PoisonedSplit):
        list(backfill.records(b"12345\n", "x", max_bytes=4))


def test_resume():
    s = backfill.Split("s", (Entry("a", 1, "e1"), Entry("b", 1, "")))
    assert backfill.resume_point(s, 5, {0: ("a", "e1")}) == (0, 5)
    assert backfill.resume_point(s, 2 << RECORD_BITS, {}) == (2, 0)
    for at, seen, why in ((5, {0: ("a", "e2")}, "etag_drift"), (5, {0: ("z", "e1")}, "not_found"), ((1 << RECORD_BITS) + 1, {}, "etag_drift"), (3 << RECORD_BITS, {}, "not_found")):
        with pytest.raises(backfill.PoisonedSplit) as e:
            backfill.resume_point(s, at, seen)
        assert e.value.reason == why


def test_lanes(spark, tmp_path):
    spark.dataSource.register(memory.LanesSource)
    rng = random.Random(1)
    lanes = {k: [(bytes([rng.randrange(256)]), None if i % 2 else b"k") for i in range(5)] for k in range(3)}
    text = memory.script(lanes)
    rows = spark.read.format("lanes").option("lanes", text).load().collect()
    assert sorted((r["partition"], r["offset"], bytes(r["value"])) for r in rows) == [(k, i, lanes[k][i][0]) for k in range(3) for i in range(5)]
    got: list = []
    q = spark.readStream.format("lanes").options(lanes=text, step="2").load().writeStream.foreachBatch(lambda df, i: got.append(df.count())).option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(got) == 15 and max(got) <= 6


def test_warehouse_seals_batches(spark, tmp_path):
    out = str(tmp_path)

    def send(endpoint, statement, settings, body):
        with open(f"{out}/{settings['insert_deduplication_token']}", "wb") as f:
            f.write(body)

    df = spark.createDataFrame([(i, "x" * (i % 5), 0) for i in range(23)], "id int, s string, shard int")
    sink = warehouse.WarehouseSink("t", [C("id", "UInt8"), C("s", "String")], ["a"], send, batch=BatchConfig(max_rows=6, max_bytes=18))
    sink.writer()(df, 7)
    bodies = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    rows = [{"id": i, "s": "x" * (i % 5)} for i in range(23)]
    sealed = list(sink.bodies(rows))
    assert [len(b) for _, _, b in sealed] == [len(bodies["pipeline-run-0-7" + (f"-{n}" if n else "")]) for n in range(len(sealed))]
    assert {r for _, r, _ in sealed} >= {"bytes", "drain"} and sum(n for n, _, _ in sealed) == 23
    assert [(n, r) for n, r, _ in warehouse.WarehouseSink("t", [C("id", "UInt8"), C("s", "String")], ["a"], send, batch=BatchConfig(max_rows=10)).bodies(rows)] == [(10, "rows"), (10, "rows"), (3, "drain")]


def test_fatal_answers_end_a_stream_at_the_first_attempt(spark, tmp_path):
    tries = str(tmp_path / "tries")

    def refuse(endpoint, statement, settings, body):
        with open(tries, "a") as f:
            f.write("x")
        raise OSError("Code: 60. DB::Exception: no such table")

    sink = warehouse.WarehouseSink("t", [C("event_id", "Int64")], ["a"], refuse, batch=BatchConfig(max_bytes=100))
    spark.range(50).selectExpr("id AS event_id", "0 AS shard").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("event_id long, shard int").parquet(f"{tmp_path}/in")
    plan = lambda df: Pipeline(df).split("skip").add("all", F.lit(True))
    report = runtime.finish(runtime.run_split(source, plan, {"all": runtime.with_retry(sink.writer(), Retry(initial_ms=1, cap_ms=1, attempts=4))}, f"{tmp_path}/c"))
    assert not report.completed and report.exit_code == 1
    assert open(tries).read() == "x"


def test_jitter_shortens_waits():
    waits, calls = [], []

    def fails(df, batch):
        calls.append(batch)
        if len(calls) < 4:
            raise OSError("busy")

    runtime.with_retry(fails, Retry(initial_ms=1000, jitter=0.5), waits.append, random.Random(1))(None, 0)
    assert len(waits) == 3 and all(0.5 * b <= w <= b for w, b in zip(waits, [1, 2, 4])) and waits != [1, 2, 4]


def test_breaker_moves_to_the_next_replica():
    seen, now = [], [0.0]

    def replica(i):
        def write(df, batch):
            seen.append(i)
            if i == 0:
                raise OSError("down")

        return write

    w = runtime.with_breaker([replica(0), replica(1)], Breaker(2, threshold=1), lambda: now[0])
    with pytest.raises(OSError):
        w(None, 0)
    for _ in range(3):
        w(None, 0)
    assert seen == [0, 1, 1, 1]


def test_a_run_that_ends_early_is_not_complete():
    assert runtime.behind({"sources": [{"description": "s", "endOffset": {"0": 5}, "latestOffset": {"0": 5}}]}) == []
    assert runtime.behind({"sources": [{"description": "s", "endOffset": '{"0": 5}', "latestOffset": {"0": 9}}]})
    assert runtime.behind({"sources": [{"description": "s", "endOffset": None, "latestOffset": None}]}) == []
