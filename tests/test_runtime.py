"""Configuration, generated events, streams, metrics."""

import logging

import pytest
from pyspark.sql import functions as F

from millrace.config import ConfigError, PipelineConfig, duration_ms, interpolate
from millrace.functions import avro
from millrace.operators.chain import SKIP, Pipeline
from millrace.operators.flow import Retry
from millrace.sources import datagen
from millrace.streaming import metrics, runtime


def test_interpolation():
    env = {"A": "x", "E": "", "N": "a\nb"}
    assert interpolate("${A} $$ ${E:-d} ${M:-} ${A:?no} ${E}", env) == "x $ d  x "
    for bad in ("${M}", "${M:?gone}", "${E:?gone}", "${N}", "${", "${1}"):
        with pytest.raises(ConfigError):
            interpolate(bad, env)


def test_config():
    text = "pipeline: {name: p}\nsource: {events: {}}\nsinks:\n  a: {parquet: {path: '${D}'}, batch: {max_rows: 10, linger: 2s}, retry: {initial: 50ms}}\n"
    c = PipelineConfig.from_text(text, {"D": "/x"})
    assert c.sinks["a"].options == {"path": "/x"} and c.sinks["a"].batch.linger_ms == 2000 and c.sinks["a"].retry.initial_ms == 50
    for bad in ("pipeline: {name: p}\nsource: {e: {}}", text + "sink: {x: {}}", text.replace("  a:", "  sink:"), text + "nonsense: 1", text + "backpressure: {high: 0.2, low: 0.5}", text.replace("max_rows: 10", "max_rows: 0")):
        with pytest.raises(ConfigError):
            PipelineConfig.from_text(bad, {"D": "/x"})
    assert duration_ms("2m") == 120_000
    with pytest.raises(ConfigError):
        duration_ms("soon")


def test_generator_is_deterministic_and_consistent():
    assert [datagen.Draws(0).bits() for _ in range(1)] == [0xE220A8397B1DCDAF]
    c = datagen.StorefrontConfig(partitions=3, seed=5, count=1000)
    assert sum(c.budget(i) for i in range(3)) == 1000
    seen, orders = [], {}
    for lane in range(3):
        for i, (_, e) in zip(range(c.budget(lane)), datagen.lane_events(c, lane)):
            assert e["order_id"] % 3 == lane
            seen.append(e["type"])
            if e["type"] == "order_placed":
                assert e["order_id"] not in orders and 1 <= len(e["lines"]) <= 5
                orders[e["order_id"]] = sum(x["qty"] * x["unit_cents"] for x in e["lines"])
            elif e["type"] == "payment_captured":
                assert orders[e["order_id"]] == e["amount_cents"]
            else:
                assert orders[e["order_id"]] >= e["amount_cents"]
    assert seen.count("order_placed") > 500 and seen.count("refund_issued") > 5
    w = datagen.Waiting()
    for i in range(300):
        w.add((i, 0))
    assert len(w.orders) == 256 and (299, 0) in w.orders and (0, 0) not in w.orders


def test_generator_source(spark):
    spark.dataSource.register(datagen.StorefrontSource)
    rows = spark.read.format("storefront").options(count="60", seed="3", encoding="avro").load().orderBy("partition", "offset").collect()
    codec = avro.Codec(datagen.EVENT_SCHEMA)
    json_rows = spark.read.format("storefront").options(count="60", seed="3").load().orderBy("partition", "offset").collect()
    for a, b in zip(rows, json_rows):
        assert codec.decode(bytes(a["value"]))["order_id"] == int(b["key"])
    assert [r["offset"] for r in rows if r["partition"] == 0] == list(range(15))


def test_generator_stream(spark, tmp_path):
    spark.dataSource.register(datagen.StorefrontSource)
    got: list = []
    source = spark.readStream.format("storefront").options(count="100", seed="3", tick_ms="0").load()
    q = source.writeStream.foreachBatch(lambda df, i: got.extend(df.select("partition", "offset").collect())).option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert len(got) == len({tuple(r) for r in got}) == 100


def split(df):
    return Pipeline(df).split(SKIP).add("even", F.col("id") % 2 == 0).add("small", F.col("id") < 3)


def test_stream_split_and_restart(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.range(10).write.parquet(src)
    even, small = [], []
    source = spark.readStream.schema("id long").parquet(src)
    writers = {"even": runtime.capture_writer(even), "small": runtime.scripted_writer(runtime.capture_writer(small), ["fatal"])}
    report = runtime.finish(runtime.run_split(source, split, writers, f"{tmp_path}/cp"))
    assert not report.completed and report.exit_code == 1 and small == []
    report = runtime.finish(runtime.run_split(source, split, writers, f"{tmp_path}/cp"))  # the same batch comes again
    assert report.completed and report.rows == 10
    assert [b for b, _ in even] == [0, 0] and sorted(small[0][1]) == [(0,), (1,), (2,)]
    spark.range(10, 12).write.mode("append").parquet(src)
    runtime.finish(runtime.run_split(source, split, writers, f"{tmp_path}/cp"))
    assert sorted(even[-1][1]) == [(10,)]


def test_retry_writer_and_replay(spark, tmp_path):
    waits = []
    w = runtime.with_retry(runtime.scripted_writer(runtime.table_writer(f"{tmp_path}/o", "shard"), ["retryable", "retryable"]), Retry(jitter=0), waits.append)
    df = spark.range(4).withColumn("shard", F.col("id") % 2)
    w(df, 0)
    w(df, 0)
    assert waits == [0.1, 0.2]
    assert runtime.read_branch(spark, f"{tmp_path}/o").count() == 4
    with pytest.raises(OSError):
        runtime.with_retry(runtime.scripted_writer(w, ["retryable"] * 9), Retry(attempts=2), waits.append)(df, 1)


def test_stall_watch():
    now = [0.0]
    s = runtime.StallWatch(10, lambda: now[0])
    assert not s.stalled(1)
    now[0] = 11
    assert s.stalled(1) and not s.stalled(2) and not s.stalled(2, pending=False)


def test_meters():
    m = metrics.Meter()
    m.add("rows", 2)
    m.add("rows")
    assert m.values["millrace_rows_total"] == 3
    with pytest.raises(ValueError):
        m.set("sink_bytes", 1)
    now = [0.0]
    f = metrics.RateLimit(2, 10, lambda: now[0])
    record = lambda: logging.LogRecord("x", 30, "", 0, "hello", (), None)
    assert [f.filter(record()) for _ in range(4)] == [True, True, False, False]
    now[0] = 11
    r = record()
    assert f.filter(r) and "2 like it" in r.msg
