"""Queries of sinks, state, objects, coordination, generated events, formats and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import avro
from ..operators import assignment, batching, checkpoint, encoders, flow, objects, schema_check
from ..operators.chain import SKIP, Pipeline
from ..session import shared_folder, ship
from ..sources import backfill, datagen, memory
from .row_queries import events, table


def batch_seal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("shard", (F.col("event_id") % 4).cast("int"))
    sealed = batching.seal_rows(rows, "shard", ["event_id"], 100)
    return sealed.groupBy("shard", "batch_seq").agg(F.count("*").alias("n"), F.min("event_id").alias("first")).withColumn("token", batching.dedup_token("p", "r1", F.col("shard"), F.col("batch_seq")))


SEAL_ROWS_SQL = """SELECT shard, batch_seq, count(*) AS n, min(event_id) AS first, 'p-r1-' || shard || '-' || batch_seq AS token
FROM (SELECT event_id, CAST(event_id % 4 AS INTEGER) AS shard, CAST(floor((row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1) / 100) AS BIGINT) AS batch_seq FROM events) GROUP BY 1, 2"""


def batch_seal_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).cast("int").alias("shard"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    sealed = batching.seal_bytes(rows, "shard", ["doc_id"], "bytes", 100_000)
    return sealed.groupBy("shard", "batch_seq").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


SEAL_BYTES_SQL = """WITH RECURSIVE d AS (SELECT CAST(doc_id % 4 AS INTEGER) AS shard, coalesce(octet_length(encode(text)), 0) AS bytes, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS i FROM documents),
w AS (SELECT shard, i, bytes, 0::BIGINT AS batch_seq, bytes::BIGINT AS held FROM d WHERE i = 1
  UNION ALL SELECT d.shard, d.i, d.bytes, w.batch_seq + CASE WHEN w.held >= 100000 THEN 1 ELSE 0 END, CASE WHEN w.held >= 100000 THEN d.bytes ELSE w.held + d.bytes END FROM w JOIN d ON d.shard = w.shard AND d.i = w.i + 1)
SELECT shard, batch_seq, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM w GROUP BY 1, 2"""


def _acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    status = F.when(F.col("event_id") % 911 == 910, "failed").when(F.col("event_id") % 503 == 502, "pending").otherwise("delivered")
    return e.select("partition", F.col("offset").alias("seq"), ((F.col("offset") + 1) * 10 - 1).alias("last_offset"), status.alias("status"))


_ACKS_SQL = """WITH a AS (SELECT CAST(event_id % 4 AS INTEGER) AS partition, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS seq,
  CASE WHEN event_id % 911 = 910 THEN 'failed' WHEN event_id % 503 = 502 THEN 'pending' ELSE 'delivered' END AS status FROM events),
h AS (SELECT partition, min(seq) FILTER (status <> 'delivered') AS head FROM a GROUP BY 1)
"""


def ck_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint.watermarks(_acks(spark, sf_dir)).select("partition", "watermark", "held")


def ck_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint.watermarks(_acks(spark, sf_dir)).select("partition", "stalled")


def bp_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-flight bytes follow the events' values; pauses and resumes by partition."""
    ship(spark)
    rows = events(spark, sf_dir).select("partition", "offset", F.col("event_time_ms"), F.pmod((F.col("event_id") * 7919), F.lit(1000)).alias("used"))
    out = flow.fold(rows, "partition", ["offset"], lambda: flow.Backpressure(budget=1000, min_pause_ms=0), lambda m, r: m.step(int(r["offset"]), int(r["used"])), "action")
    return out.where("action <> 'hold'").select("partition", "offset", "action")


BP_SQL = """WITH RECURSIVE e AS (SELECT CAST(event_id % 4 AS INTEGER) AS partition, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS o, (event_id * 7919) % 1000 AS used FROM events),
w AS (SELECT partition, o, used >= 800 AS paused, CASE WHEN used >= 800 THEN 'pause' ELSE 'hold' END AS action FROM e WHERE o = 0
  UNION ALL SELECT e.partition, e.o, CASE WHEN w.paused THEN e.used > 500 ELSE e.used >= 800 END,
    CASE WHEN w.paused AND e.used <= 500 THEN 'resume' WHEN NOT w.paused AND e.used >= 800 THEN 'pause' ELSE 'hold' END FROM w JOIN e ON e.partition = w.partition AND e.o = w.o + 1)
SELECT partition, o AS "offset", action FROM w WHERE action <> 'hold'"""


def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scripted run of one replica for each partition: outcomes come from its events, one each 1000 ms."""
    ship(spark)
    rows = events(spark, sf_dir).select("partition", "offset", (F.col("event_type") == "error").alias("failed"))

    def step(b: flow.Breaker, r: dict) -> str:
        now = int(r["offset"]) * 1000
        picked = b.pick(now)
        if picked is None:
            return "refused"
        b.failure(0, now) if r["failed"] else b.success(0)
        return b.state(0)

    return flow.fold(rows, "partition", ["offset"], lambda: flow.Breaker(1, threshold=2, open_for_ms=5000), step, "state").groupBy("partition", "state").agg(F.count("*").alias("n"))


BREAKER_SQL = """WITH RECURSIVE e AS (SELECT CAST(event_id % 4 AS INTEGER) AS partition, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS o, event_type = 'error' AS failed FROM events),
w AS (SELECT partition, 0::BIGINT AS o, CASE WHEN failed THEN 1 ELSE 0 END AS failures, NULL::BIGINT AS open_until, 'closed' AS state FROM e WHERE o = 0
  UNION ALL SELECT e.partition, e.o,
    CASE WHEN w.open_until IS NOT NULL AND e.o * 1000 < w.open_until THEN w.failures WHEN NOT e.failed THEN 0 ELSE w.failures + 1 END,
    CASE WHEN w.open_until IS NOT NULL AND e.o * 1000 < w.open_until THEN w.open_until WHEN e.failed AND (w.open_until IS NOT NULL OR w.failures + 1 >= 2) THEN e.o * 1000 + 5000 END,
    CASE WHEN w.open_until IS NOT NULL AND e.o * 1000 < w.open_until THEN 'refused' WHEN e.failed AND (w.open_until IS NOT NULL OR w.failures + 1 >= 2) THEN 'open' ELSE 'closed' END
  FROM w JOIN e ON e.partition = w.partition AND e.o = w.o + 1)
SELECT partition, state, count(*) AS n FROM w GROUP BY 1, 2"""


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = flow.Retry(jitter=0.0)
    return spark.createDataFrame([(n, float(r.delay(n))) for n in range(1, 21)], "attempt int, delay_ms double")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id"), F.concat(F.col("url"), F.lit("#"), F.col("page_id").cast("string")).alias("key"), F.length("html").cast("long").alias("size"), F.md5("html").alias("etag"))


def s3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of the listing, folded in listing order by one task on light rows (key and size), as a planner would."""
    ship(spark)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        splits = objects.pack([objects.Entry(k, s, e) for k, s, e in zip(pdf["key"], pdf["size"], pdf["etag"], strict=True)], 60_000)
        return pd.DataFrame([(i, len(s), sum(x.size for x in s), objects.split_id(s)) for i, s in enumerate(splits)], columns=["split", "objects", "bytes", "split_id"])

    rows = _listing(spark, sf_dir).withColumn("job", F.lit(0))
    return rows.groupBy("job").applyInPandas(run, "split long, objects long, bytes long, split_id string")


PACK_SQL = """WITH RECURSIVE l AS (SELECT url || '#' || page_id AS key, length(html)::BIGINT AS size, md5(html) AS etag, row_number() OVER (ORDER BY url || '#' || page_id) AS i FROM pages),
c AS (SELECT *, greatest(size, 60000 // 16, 1) AS cost FROM l),
w AS (SELECT 0::BIGINT AS i, 0::BIGINT AS made, 0::BIGINT AS bin, []::STRUCT(n BIGINT, c BIGINT)[] AS bins
  UNION ALL SELECT i, CASE WHEN spot IS NULL THEN made + 1 ELSE made END, CASE WHEN spot IS NULL THEN made ELSE bins[spot].n END,
    list_filter(CASE WHEN spot IS NULL THEN list_append(CASE WHEN len(bins) = 10 THEN bins[2:] ELSE bins END, {'n': made, 'c': cost})
      ELSE list_transform(bins, lambda b: {'n': b.n, 'c': b.c + CASE WHEN b.n = bins[spot].n THEN cost ELSE 0 END}) END, lambda b: b.c < 60000)
  FROM (SELECT c.i, c.cost, w.made, w.bins, list_position(list_transform(w.bins, lambda b: b.c + c.cost <= 60000), true) AS spot FROM w JOIN c ON c.i = w.i + 1)),
r AS (SELECT w.bin, l.size, hex(encode(key)) AS k, hex(encode(etag)) AS e, key, etag FROM w JOIN l USING (i))
SELECT bin AS split, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes,
  's3-' || rtrim(translate(base64(unhex(sha256(unhex(hex(encode('millrace-split' || chr(10))) || '01000000' || string_agg(
    printf('%02X%02X000000000000', (length(k) // 2) % 256, length(k) // 512) || k || printf('%02X%02X000000000000', (length(e) // 2) % 256, length(e) // 512) || e, '' ORDER BY key, etag)))[1:32])), '+/', '-_'), '=') AS split_id
FROM r GROUP BY bin"""


def s3_split_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir).select("page_id", objects.split_id_column(F.col("key"), F.col("etag")).alias("split_id"))


SPLIT_ID_SQL = """WITH l AS (SELECT page_id, url || '#' || page_id AS key, md5(html) AS etag FROM pages),
h AS (SELECT page_id, unhex(sha256(concat_blob)) AS d FROM (SELECT page_id, encode('millrace-split' || chr(10)) || '\\x01\\x00\\x00\\x00'::BLOB
  || unhex(printf('%02X', octet_length(encode(key)) % 256) || printf('%02X', octet_length(encode(key)) // 256) || '000000000000') || encode(key) || unhex('2000000000000000') || encode(etag) AS concat_blob FROM l))
SELECT page_id, 's3-' || rtrim(translate(base64(unhex(hex(d)[1:32])), '+/', '-_'), '=') AS split_id FROM h"""


def s3_offset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber"), objects.encode_offset(F.col("l_linenumber").cast("long"), F.col("l_orderkey")).alias("position"))
    d = objects.decode_offset(F.col("position"))
    return o.select("l_orderkey", "l_linenumber", "position", d["ordinal"].alias("ordinal"), d["record"].alias("record"))


def s3_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("url"), F.element_at(F.array(*[F.lit(x) for x in (".gz", ".GZIP", ".zst", ".zstd", ".json")]), (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", objects.codec(key).alias("codec"))


def _fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("split"), F.col("p_retailprice").cast("long").alias("weight"), (F.col("p_partkey") % 7).cast("string").alias("owner"))


FLEET = [str(i) for i in range(6)]
FLEET_CAPS = {"0": 3, "3": 0}


def _planned(rows: list[tuple[str, int, str]]) -> dict[str, str]:
    """One job's plan: member 0 takes at most 3 splits, member 3 one, the others 20; every tenth split is withheld."""
    reserved = {s for s, _, _ in rows if int(s) % 10 == 0}
    return assignment.desired_assignment(FLEET, {s: (w, o) for s, w, o in rows}, reserved, FLEET_CAPS, 20, seed=0x5EA1)


def assign_desired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six members, a seventh is gone: its splits move to the others. A planner's task on light rows by job."""
    ship(spark)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _planned([(s, int(w), o) for s, w, o in zip(pdf["split"], pdf["weight"], pdf["owner"], strict=True)])
        return pd.DataFrame([(s, m) for s, m in got.items()], columns=["split", "member"])

    rows = _fleet(spark, sf_dir).withColumn("job", (F.col("split").cast("long") / 100).cast("long"))
    return rows.groupBy("job").applyInPandas(run, "split string, member string")


def claim_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    lease = F.when(n % 5 == 1, "me").when(n % 5 == 2, "other")
    owner = F.when(n % 3 == 0, "gone")
    status = F.when(n % 13 == 0, "completed").when(n % 17 == 0, "quarantined").otherwise("runnable")
    what = assignment.claim(status, lease, F.lit("me"), owner, n % 7 % 2, (n % 6).cast("int"), 4, n % 11 != 0)
    return table(spark, sf_dir, "part").select(n.alias("split"), what.alias("what")).where("what is not null").select("split", "what.action", "what.kind")


CLAIM_SQL = """WITH p AS (SELECT p_partkey AS n FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 5 <> 2),
k AS (SELECT n, CASE WHEN n % 5 = 1 THEN 'reclaim' WHEN n % 3 = 0 THEN 'expired' WHEN n % 7 IN (0, 2, 4, 6) THEN 'create' ELSE 'released' END AS kind FROM p)
SELECT n AS split, 'quarantine' AS action, kind FROM k WHERE kind IN ('reclaim', 'expired') AND n % 6 >= 3
UNION ALL SELECT n, 'claim', kind FROM k WHERE NOT (kind IN ('reclaim', 'expired') AND n % 6 >= 3) AND n % 11 <> 0"""


def storefront(spark: SparkSession, count: int = 4000, seed: int = 7) -> DataFrame:
    ship(spark)
    spark.dataSource.register(datagen.StorefrontSource)
    raw = spark.read.format("storefront").options(count=str(count), seed=str(seed)).load()
    return raw.select("partition", "offset", "event_time_ms", F.from_json(F.col("value").cast("string"), datagen.EVENT_DDL).alias("e")).select("partition", "offset", "event_time_ms", "e.*")


def datagen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storefront(spark).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("order_id").alias("orders"))


def storefront_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed branches of the stream in one ledger."""
    rows = storefront(spark)
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["qty"].cast("long") * x["unit_cents"])
    s = Pipeline(rows).split(SKIP).add("order", F.col("type") == "order_placed", "order_id", total.alias("amount_cents"), F.col("region").alias("detail"))
    s.add("payment", F.col("type") == "payment_captured", "order_id", "amount_cents", F.lit("").alias("detail")).add("refund", F.col("type") == "refund_issued", "order_id", "amount_cents", F.col("reason").alias("detail"))
    out = s.outputs()
    parts = [df.withColumn("kind", F.lit(k)) for k, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def storefront_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments without an order or with another amount, and refunds above their payment: all counts must be 0."""
    ledger = storefront_ledger(spark, sf_dir)
    side = lambda k: ledger.where(F.col("kind") == k).select("order_id", F.col("amount_cents").alias(f"{k}_cents"))
    both = side("payment").join(side("order"), "order_id", "left")
    back = side("refund").join(side("payment"), "order_id", "left")
    count = lambda df, name, bad: df.agg(F.lit(name).alias("violation"), F.count(F.when(bad, 1)).alias("n"))
    out = count(both, "orphan payment", F.col("order_cents").isNull())
    out = out.unionByName(count(both, "wrong amount", F.col("order_cents") != F.col("payment_cents")))
    return out.unionByName(count(back, "bad refund", F.col("payment_cents").isNull() | (F.col("refund_cents") > F.col("payment_cents"))))


def mv_region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last order and a summed map of priorities for each region."""
    t = lambda n: table(spark, sf_dir, n)
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    by = rows.groupBy("r_name", "o_orderpriority").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    out = by.groupBy("r_name").agg(F.min("first").alias("first_order"), F.max("last").alias("last_order"), F.sum("n").alias("orders"), F.sort_array(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    return out.select("r_name", "first_order", "last_order", "orders", F.array_join(F.transform("m", lambda x: F.concat(x["o_orderpriority"], F.lit("="), x["n"].cast("string"))), ";").alias("by_priority"))


MV_SQL = """WITH r AS (SELECT r_name, o_orderpriority, min(o_orderdate) AS f, max(o_orderdate) AS l, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT r_name, min(f) AS first_order, max(l) AS last_order, CAST(sum(n) AS BIGINT) AS orders, string_agg(o_orderpriority || '=' || n, ';' ORDER BY o_orderpriority) AS by_priority FROM r GROUP BY 1"""

ORDER_V1 = {"type": "record", "name": "Order", "fields": [{"name": "o_orderkey", "type": "long"}, {"name": "o_orderstatus", "type": ["null", "string"]}, {"name": "quantity", "type": "int"}]}
ORDER_V2 = {"type": "record", "name": "Order", "fields": [{"name": "quantity", "type": "long"}, {"name": "o_orderkey", "type": "long"}, {"name": "currency", "type": "string", "default": "USD"}]}


def _avro_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    o = table(spark, sf_dir, "orders")
    row = F.struct("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_custkey") % 1000).cast("int").alias("quantity"))
    datum = avro.encode_column(row, ORDER_V1)
    broken = F.when(F.col("o_orderkey") % 101 == 0, F.lit(bytearray(b"\x01\0\0\0\7"))).otherwise(F.lit(bytearray(b"\x00\0\0\0\7")))
    return o.select("o_orderkey", "o_orderstatus", "o_custkey", F.concat(broken, datum).alias("value"))


def avro_wire_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _avro_orders(spark, sf_dir).select("o_orderkey", F.coalesce(avro.confluent_id(F.col("value")), F.lit(-1)).alias("schema_id"))


def avro_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _avro_orders(spark, sf_dir).where(avro.confluent_id(F.col("value")) == 7)
    d = rows.select(avro.decode_column(avro.confluent_datum(F.col("value")), ORDER_V1, "struct<o_orderkey: bigint, o_orderstatus: string, quantity: int>").alias("d"))
    return d.select("d.*")


def avro_decode_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read with a later schema: reordered, promoted, one field dropped, one filled by its default."""
    rows = _avro_orders(spark, sf_dir).where(avro.confluent_id(F.col("value")) == 7)
    d = rows.select(avro.decode_column(avro.confluent_datum(F.col("value")), ORDER_V1, "struct<quantity: bigint, o_orderkey: bigint, currency: string>", ORDER_V2).alias("d"))
    return d.select("d.*")


TYPES = ["UInt64", "Nullable(DateTime64(3, 'UTC'))", "LowCardinality(Nullable(String))", "Array(Tuple(a Int32, b Decimal(18, 4)))", "Map(String, Array(UInt8))", "Decimal128(6)", "Enum8('a' = 1, 'b(' = 2)", "FixedString(8)", "MultiPolygon", "AggregateFunction(sum, UInt64)", "DateTime64(9)", "SimpleAggregateFunction(max, Float64)", "Tuple(Int8, String)", "Nested(a Int8)", "IPv6", "Array("]


def ch_type_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for t in TYPES:
        c = schema_check.parse_type(t)
        rows.append((t, c.name, c.nullable, c.spark().simpleString() if c.spark() is not None else None))
    return spark.createDataFrame(rows, "type string, constructor string, nullable boolean, spark string")


#: What each type string means to us; a type that is not known or can't be read falls back to Other.
TYPES_SQL = """SELECT type, constructor, nullable, spark FROM (VALUES ('UInt64', 'UInt64', false, 'decimal(20,0)'), ('Nullable(DateTime64(3, ''UTC''))', 'Nullable', true, 'timestamp'),
  ('LowCardinality(Nullable(String))', 'LowCardinality', true, 'string'), ('Array(Tuple(a Int32, b Decimal(18, 4)))', 'Array', false, 'array<struct<a:int,b:decimal(18,4)>>'), ('Map(String, Array(UInt8))', 'Map', false, 'map<string,array<smallint>>'),
  ('Decimal128(6)', 'Decimal', false, 'decimal(38,6)'), ('Enum8(''a'' = 1, ''b('' = 2)', 'Enum8', false, 'string'), ('FixedString(8)', 'FixedString', false, 'string'), ('MultiPolygon', 'MultiPolygon', false, 'array<array<array<struct<x:double,y:double>>>>'),
  ('AggregateFunction(sum, UInt64)', 'Other', false, NULL), ('DateTime64(9)', 'DateTime64', false, 'bigint'), ('SimpleAggregateFunction(max, Float64)', 'SimpleAggregateFunction', false, 'double'),
  ('Tuple(Int8, String)', 'Tuple', false, 'struct<_1:tinyint,_2:string>'), ('Nested(a Int8)', 'Other', false, NULL), ('IPv6', 'IPv6', false, 'binary'), ('Array(', 'Other', false, NULL)) t(type, constructor, nullable, spark)"""

SCHEMA_SQL = """SELECT level, finding FROM (VALUES ('error', 'o_orderkey: nullable, but the table has Int64'), ('error', 'o_custkey: bigint does not fit Nullable(String) (string)'),
  ('error', 'o_totalprice: aggregate states can''t be written; write plain values and aggregate there'), ('error', 'o_orderdate: MATERIALIZED columns can''t be written'), ('error', 'o_orderpriority: not in the table'),
  ('warning', 'extra: not written and without a default')) t(level, finding)"""


def schema_check_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = schema_check.TargetColumn
    target = [c("o_orderkey", "Int64"), c("o_custkey", "Nullable(String)"), c("o_orderstatus", "LowCardinality(Nullable(String))"), c("o_totalprice", "AggregateFunction(sum, Float64)"), c("o_orderdate", "DateTime", "MATERIALIZED"), c("extra", "String"), c("note", "String", "DEFAULT")]
    f = schema_check.validate(table(spark, sf_dir, "orders").schema, target)
    return spark.createDataFrame([("error", x) for x in f.errors] + [("warning", x) for x in f.warnings], "level string, finding string")


def distributed_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = schema_check.check_layout([1, 2], "xxHash64(id)", [1, 2], "Distributed('c', 'db', 't', xxHash64(`id`))", "c")
    bad = schema_check.check_layout([1, 1, 1], "xxHash64(id)", [1, 2], "Distributed('other', 'db', 't', rand())", "c")
    return spark.createDataFrame([("good", len(good), ""), *[("bad", 1, x) for x in bad]], "layout string, n int, finding string")


DISTRIBUTED_SQL = """SELECT * FROM (VALUES ('good', 0, ''), ('bad', 1, '3 shards here, 2 in the cluster'), ('bad', 1, 'cluster c here, other there'), ('bad', 1, 'sharding by xxHash64(id) here, by rand() there')) t(layout, n, finding)"""


def _streamed(spark: SparkSession, sf_dir: str, outcomes: list[str]) -> tuple[DataFrame, DataFrame]:
    """The events through a stream with two branches and a retrying sink."""
    from ..streaming import runtime

    folder = shared_folder(spark, "stream")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    plan = lambda df: Pipeline(df).split(SKIP).add("clicks", F.col("event_type") == "click", "event_id", "value").add("views", F.col("event_type") == "view", "event_id", "user_id")
    clicks = runtime.with_retry(runtime.scripted_writer(runtime.parquet_writer(f"{folder}/clicks"), outcomes), flow.Retry(initial_ms=1, cap_ms=2))
    report = runtime.finish(runtime.run_split(source, plan, {"clicks": clicks, "views": runtime.parquet_writer(f"{folder}/views")}, f"{folder}/checkpoint"))
    if not report.completed:
        raise RuntimeError(report.reason)
    return runtime.read_branch(spark, f"{folder}/clicks"), runtime.read_branch(spark, f"{folder}/views")


def stream_multi_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, views = _streamed(spark, sf_dir, [])
    a = clicks.agg(F.lit("clicks").alias("branch"), F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return a.unionByName(views.agg(F.lit("views").alias("branch"), F.count("*").alias("n"), F.sum("event_id").alias("ids")))


def stream_replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that fail at first and are retried leave each row once."""
    clicks, _ = _streamed(spark, sf_dir, ["retryable", "retryable"])
    return clicks.groupBy("event_id").agg(F.count("*").alias("times"))


def rowbinary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bytes of the warehouse's row format; rows whose status does not fit are skipped."""
    ship(spark)
    c = schema_check.TargetColumn
    columns = [c("o_orderkey", "Int64"), c("o_orderstatus", "Nullable(FixedString(2))"), c("tags", "Array(String)")]
    o = table(spark, sf_dir, "orders").withColumn("tags", F.array("o_orderpriority")).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 9 == 0, F.lit(None)).when(F.col("o_orderkey") % 10 == 0, F.lit("long")).otherwise(F.col("o_orderstatus")))
    out = o.select("o_orderkey", F.hex(encoders.encode_rows(o, columns)).alias("row"))
    return out.where("row is not null")


ROWBINARY_SQL = """WITH h AS (SELECT o_orderkey, printf('%016X', o_orderkey) AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 <> 0)
SELECT o_orderkey, array_to_string(list_transform(range(7, -1, -1), lambda i: k[2 * i + 1 : 2 * i + 2]), '') || CASE WHEN o_orderkey % 9 = 0 THEN '01' ELSE '00' || hex(encode(s)) || '00' END
  || '01' || printf('%02X', length(p)) || hex(encode(p)) AS row FROM h"""


def stream_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripted lanes through a bounded stream, two records a trigger and lane; offsets end where the lanes end."""
    ship(spark)
    from ..streaming import runtime

    spark.dataSource.register(memory.LanesSource)
    text = memory.script({k: [(f"{k}:{i}".encode(), None) for i in range(3 + k)] for k in range(4)})
    folder = shared_folder(spark, "lanes")
    q = spark.readStream.format("lanes").options(lanes=text, step="2").load().writeStream.foreachBatch(lambda df, i: runtime.parquet_writer(f"{folder}/out")(df, i)).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return runtime.read_branch(spark, f"{folder}/out").groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("last"))


def s3_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as compressed lines, planned into splits and read back with their positions."""
    ship(spark)
    folder = shared_folder(spark, "backfill")
    table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id")).alias("value")).repartition(5).write.option("compression", "gzip").text(folder)
    entries = [objects.Entry(r["key"], r["size"], r["etag"]) for r in backfill.listing(spark, folder, "*.gz").collect()]  # a planner's listing
    splits = backfill.plan(entries, max(1, sum(e.size for e in entries) // 2))
    todo = spark.createDataFrame([(s.ident, i, o.key, 0) for s in splits for i, o in enumerate(s.objects)], "split string, ordinal int, key string, from_record long")
    rows = backfill.read_splits(spark, todo, folder, pattern="*.gz")
    return rows.select(F.from_json(F.col("value").cast("string"), "event_id bigint, user_id bigint").alias("e")).select("e.*")


_AVRO_ROWS = "FROM orders WHERE o_orderkey % 101 <> 0"
QUERIES = {
    "batch_seal_rows": (batch_seal_rows, SEAL_ROWS_SQL),
    "batch_seal_bytes": (batch_seal_bytes, SEAL_BYTES_SQL),
    "ck_watermark": (ck_watermark, _ACKS_SQL + "SELECT a.partition, max((seq + 1) * 10) FILTER (head IS NULL OR seq < head) AS watermark, count(*) FILTER (seq >= head) AS held FROM a JOIN h USING (partition) GROUP BY 1"),
    "ck_stalled": (ck_stalled, _ACKS_SQL + "SELECT h.partition, coalesce(a.status = 'failed', false) AS stalled FROM h LEFT JOIN a ON a.partition = h.partition AND a.seq = h.head"),
    "bp_transitions": (bp_transitions, BP_SQL),
    "breaker_states": (breaker_states, BREAKER_SQL),
    "backoff_schedule": (backoff_schedule, "SELECT CAST(i AS INTEGER) AS attempt, least(10000.0::DOUBLE, 100.0::DOUBLE * pow(2.0::DOUBLE, i - 1)) AS delay_ms FROM range(1, 21) t(i)"),
    "s3_pack": (s3_pack, PACK_SQL),
    "s3_split_id": (s3_split_id, SPLIT_ID_SQL),
    "s3_offset_roundtrip": (s3_offset_roundtrip, "SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT * 1099511627776 + l_orderkey AS position, l_linenumber::BIGINT AS ordinal, l_orderkey AS record FROM lineitem"),
    "s3_codec": (s3_codec, "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'gzip' WHEN 1 THEN 'gzip' WHEN 4 THEN 'none' ELSE 'zstd' END AS codec FROM pages"),
    "assign_desired": (assign_desired, None),
    "claim_candidates": (claim_candidates, CLAIM_SQL),
    "datagen_events": (datagen_events, None),
    "storefront_ledger": (storefront_ledger, None),
    "storefront_integrity": (storefront_integrity, "SELECT unnest(['orphan payment', 'wrong amount', 'bad refund']) AS violation, 0::BIGINT AS n"),
    "mv_region_rollup": (mv_region_rollup, MV_SQL),
    "avro_wire_parse": (avro_wire_parse, "SELECT o_orderkey, CASE WHEN o_orderkey % 101 <> 0 THEN 7::BIGINT ELSE -1 END AS schema_id FROM orders"),
    "avro_decode": (avro_decode, f"SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS o_orderstatus, CAST(o_custkey % 1000 AS INTEGER) AS quantity {_AVRO_ROWS}"),
    "avro_decode_evolve": (avro_decode_evolve, f"SELECT CAST(o_custkey % 1000 AS BIGINT) AS quantity, o_orderkey, 'USD' AS currency {_AVRO_ROWS}"),
    "ch_type_parse": (ch_type_parse, TYPES_SQL),
    "schema_check_full": (schema_check_full, SCHEMA_SQL),
    "distributed_check": (distributed_check, DISTRIBUTED_SQL),
    "rowbinary_encode": (rowbinary_encode, ROWBINARY_SQL),
    "s3_backfill": (s3_backfill, "SELECT event_id, user_id FROM events"),
    "stream_lanes": (stream_lanes, "SELECT CAST(i AS INTEGER) AS partition, CAST(3 + i AS BIGINT) AS n, CAST(2 + i AS BIGINT) AS last FROM range(4) t(i)"),
    "stream_multi_sink": (stream_multi_sink, "SELECT 'clicks' AS branch, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type = 'click' UNION ALL SELECT 'views', count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE event_type = 'view'"),
    "stream_replay_idempotent": (stream_replay_idempotent, "SELECT event_id, 1::BIGINT AS times FROM events WHERE event_type = 'click'"),
}
