"""Queries of the row operators, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_decode import count_reasons, decode_array, decode_ndjson, decode_single, frame_lines, json_message, message_bytes
from ..operators.chain import FAIL, SKIP, Pipeline
from ..operators.envelope import envelope
from ..operators.routing import distributed_shard, key_hash_shard

SHARDS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as records with an envelope; some payloads are blank, malformed or repeat a key."""
    e = table(spark, sf_dir, "events")
    good = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"event_type":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.lit("}"))
    value = F.when(F.col("event_id") % 97 == 0, "{bad").when(F.col("event_id") % 101 == 0, "").when(F.col("event_id") % 103 == 0, F.concat(F.lit('{"event_id":0,"event_type":"x","event_id":'), F.col("event_id").cast("string"), F.lit("}"))).otherwise(good)
    return envelope(e, F.col("event_id") % 4, F.col("event_id"), F.col("user_id"), F.col("ts"), value)


EVENTS_SQL = """ev AS (
  SELECT *, CAST(event_id % 4 AS INTEGER) AS partition, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS "offset",
    CAST(user_id AS VARCHAR) AS key, epoch_ms(ts) AS event_time_ms,
    CASE WHEN event_id % 97 = 0 THEN 'malformed' WHEN event_id % 101 = 0 THEN 'blank' WHEN event_id % 103 = 0 THEN 'repeated' ELSE 'good' END AS state
  FROM events)"""

EVENT_SCHEMA = "struct<event_id: bigint, event_type: string, props: struct<k: bigint>>"

#: FNV-1a 64 of an ASCII string, and of a key modulo n, as DuckDB macros would have it.
FNV_SQL = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length({0}) + 1), lambda i: ord({0}[i])::UHUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode, filter, split by event type, route by key, count by branch and shard."""
    rows = decode_single(events(spark, sf_dir).withColumn("value", F.col("value").cast("string")), "value", EVENT_SCHEMA, ["event_id", "event_type"], "skip")
    chain = Pipeline.from_df(rows).filter(F.col("record.props.k") >= 10).with_columns(shard=key_hash_shard(F.col("key"), F.col("partition"), SHARDS), kind=F.col("record.event_type"))
    split = chain.split(SKIP).add("clicks", F.col("kind") == "click").add("views", F.col("kind") == "view").add("errors", F.col("kind") == "error")
    return split.tagged().groupBy("branch", "shard").agg(F.count("*").alias("n"), F.sum("record.props.k").alias("sum_k"))


FLAGSHIP_SQL = f"""WITH {EVENTS_SQL}
SELECT CASE event_type WHEN 'click' THEN 'clicks' WHEN 'view' THEN 'views' ELSE 'errors' END AS branch,
  CAST({FNV_SQL.format("key")} % {SHARDS} AS INTEGER) AS shard, count(*) AS n, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS sum_k
FROM ev WHERE state = 'good' AND event_type IN ('click', 'view', 'error') AND CAST(props->>'k' AS BIGINT) >= 10 GROUP BY 1, 2"""


def map_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline(table(spark, sf_dir, "lineitem")).map("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.upper("l_returnflag").alias("flag")).df


def filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline(table(spark, sf_dir, "lineitem")).filter((F.col("l_quantity") > 45) & (F.col("l_discount") >= 0.05)).map("l_orderkey", "l_linenumber", "l_quantity").df


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as an array sorted by line number; orders without lines have an empty one."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")))).alias("lines"))
    o = table(spark, sf_dir, "orders")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select("o_orderkey", "o_custkey", "o_orderpriority", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines"))


def try_map_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals; orders without lines or with more than 200 pieces are errors and skipped."""
    qty = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["qty"])
    error = F.when(F.size("lines") == 0, "an order without lines").when(qty > 200, "too many pieces")
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["cents"] * x["qty"])
    return Pipeline(_orders(spark, sf_dir)).try_map(error, SKIP, total_cents=total).map("o_orderkey", "total_cents").df


TRY_SQL = """SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_cents
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey HAVING sum(CAST(l_quantity AS BIGINT)) <= 200"""


def try_map_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the decode stage by partition: in, tombstones, skipped, out."""
    rows = events(spark, sf_dir).withColumn("value", F.col("value").cast("string"))
    record = F.from_json("value", EVENT_SCHEMA)
    blank = F.trim("value") == ""
    bad = ~blank & (record.isNull() | record["event_id"].isNull() | F.try_parse_json("value").isNull())
    return rows.groupBy("partition").agg(F.count("*").alias("n_in"), F.count(F.when(blank, 1)).alias("tombstones"), F.count(F.when(bad, 1)).alias("skipped"), F.count(F.when(~blank & ~bad, 1)).alias("n_out"))


TRY_COUNTS_SQL = f"""WITH {EVENTS_SQL} SELECT partition, count(*) AS n_in, count(*) FILTER (state = 'blank') AS tombstones,
count(*) FILTER (state IN ('malformed', 'repeated')) AS skipped, count(*) FILTER (state = 'good') AS n_out FROM ev GROUP BY 1"""


def flat_map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.filter("lines", lambda x: x["qty"] > 10)
    return Pipeline(_orders(spark, sf_dir)).flat_map(big, keep=["o_orderkey", "o_custkey"]).df


def flat_map_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.col("text"), "[ \n]+"), lambda w: w != "")
    return Pipeline(table(spark, sf_dir, "documents").where("text is not null")).flat_map(words, "word", ["lang"]).df.groupBy("lang", "word").agg(F.count("*").alias("n"))


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline(table(spark, sf_dir, "events").select("user_id", "event_type")).dedup("user_id", "event_type").df


def inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline(table(spark, sf_dir, "events")).inspect("seen", F.count("*").alias("n")).map("event_id", "value").df


def split_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed branches, each with its own columns; rows of other kinds are dropped."""
    s = Pipeline(table(spark, sf_dir, "events")).split(SKIP).add("clicks", F.col("event_type") == "click", "event_id", F.col("value").alias("amount")).add("views", F.col("event_type") == "view", "event_id", F.lit(None).cast("double").alias("amount"))
    out = s.outputs()
    return out["clicks"].withColumn("branch", F.lit("clicks")).unionByName(out["views"].withColumn("branch", F.lit("views")))


def split_multi_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row may go to several branches, and to one branch more than once."""
    s = Pipeline(table(spark, sf_dir, "orders")).split(SKIP).add("all", F.lit(True)).add("large", F.col("o_totalprice") > 200000, times=F.lit(2)).add("urgent", F.col("o_orderpriority").startswith("1"))
    return s.tagged().groupBy("branch").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def split_unrouted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Pipeline(table(spark, sf_dir, "events")).split(SKIP).add("clicks", F.col("event_type") == "click").add("views", F.col("event_type") == "view")
    return s.unrouted().groupBy("event_type").agg(F.count("*").alias("unrouted"))


def split_all_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unmatched=fail with branches that cover every row."""
    s = Pipeline(table(spark, sf_dir, "orders")).split(FAIL).add("open", F.col("o_orderstatus") == "O").add("other", F.col("o_orderstatus") != "O")
    return s.tagged().groupBy("branch").agg(F.count("*").alias("n"))


def route_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return rows.select("event_id", key_hash_shard(F.col("key"), F.col("partition"), SHARDS).alias("shard"))


def route_keyless(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("partition", (F.col("event_id") % 1000).cast("int"))
    return rows.select("event_id", key_hash_shard(F.lit(None).cast("binary"), F.col("partition"), SHARDS).alias("shard"))


def route_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", distributed_shard(F.col("o_orderkey"), [1] * 5, spark).alias("shard"))


def route_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", distributed_shard(F.col("o_orderkey"), [9, 10, 3], spark).alias("shard"))


_M = "18446744073709551616::UHUGEINT"
_ROTL = "((({0}) << {1}) % " + _M + " + (({0}) >> {2}))"


def _xxh_sql(k: str) -> str:
    """XXH64, seed 0, of 8 bytes."""
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    u = "::UHUGEINT"
    k1 = f"((({k}){u} * {p2}{u}) % {_M})"
    k2 = f"(({_ROTL.format(k1, 31, 33)} * {p1}{u}) % {_M})"
    h0 = f"xor(({p5}{u} + 8), {k2})"
    h1 = f"(({_ROTL.format(h0, 27, 37)} * {p1}{u} + {p4}{u}) % {_M})"
    h2 = f"((xor({h1}, ({h1}) >> 33) * {p2}{u}) % {_M})"
    return f"WITH a AS (SELECT o_orderkey, {h2} AS h FROM orders), b AS (SELECT o_orderkey, (xor(h, h >> 29) * {p3}{u}) % {_M} AS h FROM a), c AS (SELECT o_orderkey, xor(h, h >> 32) AS h FROM b)"


UNIFORM_SQL = _xxh_sql("o_orderkey") + " SELECT o_orderkey, CAST(h % 5 AS INTEGER) AS shard FROM c"
WEIGHTED_SQL = _xxh_sql("o_orderkey") + " SELECT o_orderkey, CASE WHEN h % 22 < 9 THEN 0 WHEN h % 22 < 19 THEN 1 ELSE 2 END AS shard FROM c"


def route_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of a flat_map inherit the envelope: each order's lines go to one shard."""
    rows = _orders(spark, sf_dir).withColumn("key", F.col("o_custkey").cast("string").cast("binary")).withColumn("partition", F.lit(0))
    kids = Pipeline(rows).flat_map(F.col("lines"), keep=["o_orderkey", "key", "partition"]).route(key_hash_shard(F.col("key"), F.col("partition"), SHARDS)).df
    return kids.groupBy("o_orderkey").agg(F.countDistinct("shard").alias("shards"), F.min("shard").alias("shard"), F.count("*").alias("lines"))


CHILDREN_SQL = f"""SELECT o_orderkey, 1::BIGINT AS shards, min(CAST({FNV_SQL.format("CAST(o_custkey AS VARCHAR)")} % {SHARDS} AS INTEGER)) AS shard, count(*) AS lines
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""


def _text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("value", F.col("value").cast("string")).select("event_id", "value")


def json_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode_single(_text_events(spark, sf_dir), "value", EVENT_SCHEMA, ["event_id", "event_type"])
    return out.select(F.col("event_id"), F.col("record.event_type").alias("event_type"), F.coalesce("record.props.k", F.lit(-1)).alias("k"))


def json_dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode_single(_text_events(spark, sf_dir), "value", EVENT_SCHEMA, ["event_id", "event_type"], reject_duplicate_keys=True)
    return out.select("event_id", F.col("record.event_type").alias("event_type"))


def json_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _text_events(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 101 == 0, F.lit(" \t\r\n")).otherwise(F.col("value")))
    out = decode_single(rows, "value", EVENT_SCHEMA, ["event_id", "event_type"])
    return out.agg(F.count("*").alias("records"))


def _malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each event; some have something behind them, a value of another type, a key twice or no event_id."""
    n = F.col("event_id")
    body = F.concat(F.lit('"event_id":'), n.cast("string"), F.lit(',"event_type":"'), F.col("event_type"), F.lit('"'))
    value = (
        F.when(n % 7 == 0, F.concat(F.lit("{"), body, F.lit("} junk")))
        .when(n % 7 == 1, F.concat(F.lit("{"), body, F.lit('}{"event_id":1}')))
        .when(n % 7 == 2, F.concat(F.lit("{"), body, F.lit(',"weight":"heavy"}')))
        .when(n % 7 == 3, F.concat(F.lit("{"), body, F.lit(',"extra":{"a":1,"a":2}}')))
        .when(n % 7 == 4, F.concat(F.lit('{"event_type":"'), F.col("event_type"), F.lit('"}')))
        .otherwise(F.concat(F.lit(" {"), body, F.lit(',"weight":null,"extra":[1]}\n')))
    )
    return table(spark, sf_dir, "events").select(n, value.alias("value"))


MALFORMED_SCHEMA = "struct<event_id: bigint, event_type: string, weight: bigint>"


def json_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with content behind them are malformed."""
    rows = _malformed(spark, sf_dir)
    out = decode_single(rows, "value", "struct<event_id: bigint, event_type: string>", ["event_type"])
    return out.select("event_id", F.col("record.event_type").alias("event_type"))


def json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of another type than its field's makes the whole document malformed, also where the field is optional."""
    out = decode_single(_malformed(spark, sf_dir), "value", MALFORMED_SCHEMA, ["event_id"])
    return out.select("event_id", F.col("record.event_type").alias("event_type"))


def json_ndjson_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of payloads of a hundred events each, without those that repeat a key."""
    lines = _malformed(spark, sf_dir).select((F.col("event_id") / 100).cast("long").alias("payload"), F.struct("event_id", F.regexp_replace("value", "\n", "").alias("line")).alias("l"))
    rows = lines.groupBy("payload").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\n").alias("value"))
    return decode_ndjson(rows, "value", MALFORMED_SCHEMA, ["event_id"], reject_duplicate_keys=True).select("payload", "record.event_id", "record.event_type")


def json_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipped documents by reason."""
    return count_reasons(_malformed(spark, sf_dir), "value", MALFORMED_SCHEMA, ["event_id"], reject_duplicate_keys=True)


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload for each conversation: its turns as JSON lines; every seventh turn is malformed."""
    line = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.lit("{bad")).otherwise(F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"role":"'), F.col("role"), F.lit('"}')))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return rows.select("conv_id", F.col("l.line").alias("lines"))


TURN_SCHEMA = "struct<turn: bigint, role: string>"


def json_ndjson_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir).select("conv_id", F.concat(F.array_join("lines", "\r\n"), F.lit("\n\n  \n")).alias("value"))
    return decode_ndjson(rows, "value", TURN_SCHEMA, ["turn", "role"]).select("conv_id", "record.turn", "record.role")


def json_ndjson_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir).select("conv_id", F.array_join("lines", "\n").alias("value"))
    return decode_ndjson(rows, "value", TURN_SCHEMA, ["turn", "role"], "atomic").select("conv_id", "record.turn", "record.role")


def json_array_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir).select("conv_id", F.concat(F.lit("["), F.array_join("lines", ","), F.lit("]")).alias("value"))
    return decode_array(rows, "value", TURN_SCHEMA, ["turn", "role"]).select("conv_id", "record.turn", "record.role")


ATOMIC_SQL = "SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE (conv_id + turn) % 7 = 0)"


def ndjson_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(frame_lines(F.col("text"))).alias("record", "line"))
    return rows.select("doc_id", "record", F.length("line").alias("chars"))


FRAMES_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, i, regexp_replace(line, '\r$', '') AS line FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS record, CAST(length(line) AS INTEGER) AS chars FROM f WHERE NOT regexp_full_match(line, '[ \t\n\f\r]*')"""


def kafka_json_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    out = c.select(*json_message(F.col("c_custkey").cast("string"), F.struct("c_custkey", "c_name", "c_mktsegment")))
    return out.select(F.col("key").cast("string").alias("key"), "value")


def kafka_size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages over the limit are left out: key and payload bytes together."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.withColumn("bytes", message_bytes(F.col("doc_id").cast("string"), F.col("text")).cast("long")).where("bytes <= 4000").select("doc_id", "bytes")


def kafka_prefix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with a region prefix go to that region's branch without it; others are dropped."""
    region = F.when(F.col("user_id") % 3 == 0, "eu-").when(F.col("user_id") % 3 == 1, "us-").otherwise("xx-")
    rows = table(spark, sf_dir, "events").withColumn("value", F.concat(region, F.col("event_type")))
    s = Pipeline(rows).split(SKIP).add("eu", F.col("value").startswith("eu-")).add("us", F.col("value").startswith("us-"))
    return s.tagged().groupBy("branch", F.expr("substring(value, 4)").alias("payload")).agg(F.count("*").alias("n"))


QUERIES = {
    "flagship_split_route": (flagship, FLAGSHIP_SQL),
    "op_map_project": (map_project, "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, upper(l_returnflag) AS flag FROM lineitem"),
    "op_filter": (filter_rows, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05"),
    "op_try_map_skip": (try_map_skip, TRY_SQL),
    "op_try_map_counts": (try_map_counts, TRY_COUNTS_SQL),
    "op_flat_map_lines": (flat_map_lines, "SELECT o_orderkey, o_custkey, l_linenumber AS line, l_partkey AS part, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE CAST(l_quantity AS BIGINT) > 10"),
    "op_flat_map_words": (flat_map_words, r"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(text, '[ \n]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2"),
    "op_dedup": (dedup, "SELECT DISTINCT user_id, event_type FROM events"),
    "op_inspect": (inspect, "SELECT event_id, value FROM events"),
    "op_split_route": (split_route, "SELECT event_id, value AS amount, 'clicks' AS branch FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, NULL, 'views' FROM events WHERE event_type = 'view'"),
    "op_split_multi_emit": (split_multi_emit, "SELECT 'all' AS branch, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders UNION ALL SELECT 'large', 2 * count(*), CAST(2 * sum(o_orderkey) AS BIGINT) FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'urgent', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderpriority LIKE '1%'"),
    "op_split_unrouted": (split_unrouted, "SELECT event_type, count(*) AS unrouted FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1"),
    "op_split_all_matched": (split_all_matched, "SELECT CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS branch, count(*) AS n FROM orders GROUP BY 1"),
    "route_key_hash": (route_key_hash, f"SELECT event_id, CAST({FNV_SQL.format('CAST(user_id AS VARCHAR)')} % {SHARDS} AS INTEGER) AS shard FROM events"),
    "route_keyless": (route_keyless, f"SELECT event_id, CAST((((event_id % 1000)::UHUGEINT * 11400714819323198485::UHUGEINT) % {_M}) % {SHARDS} AS INTEGER) AS shard FROM events"),
    "route_distributed_uniform": (route_uniform, UNIFORM_SQL),
    "route_distributed_weighted": (route_weighted, WEIGHTED_SQL),
    "route_children_colocated": (route_children, CHILDREN_SQL),
    "json_single": (json_single, f"WITH {EVENTS_SQL} SELECT event_id, CASE WHEN state = 'good' THEN event_type ELSE 'x' END AS event_type, CASE WHEN state = 'good' THEN CAST(props->>'k' AS BIGINT) ELSE -1 END AS k FROM ev WHERE state IN ('good', 'repeated')"),
    "json_dup_keys": (json_dup_keys, f"WITH {EVENTS_SQL} SELECT event_id, event_type FROM ev WHERE state = 'good'"),
    "json_trailing": (json_trailing, "SELECT event_id, event_type FROM events WHERE event_id % 7 NOT IN (0, 1)"),
    "json_types": (json_types, "SELECT event_id, event_type FROM events WHERE event_id % 7 IN (3, 5, 6)"),
    "json_ndjson_dup": (json_ndjson_dup, "SELECT event_id // 100 AS payload, event_id, event_type FROM events WHERE event_id % 7 IN (5, 6)"),
    "json_reasons": (json_reasons, "SELECT CASE WHEN event_id % 7 < 2 THEN 'syntax' WHEN event_id % 7 = 2 THEN 'type' WHEN event_id % 7 = 3 THEN 'duplicate_key' ELSE 'missing:event_id' END AS reason, count(*) AS n FROM events WHERE event_id % 7 < 5 GROUP BY 1"),
    "json_tombstone": (json_tombstone, f"WITH {EVENTS_SQL} SELECT count(*) AS records FROM ev WHERE state IN ('good', 'repeated') AND event_id % 101 <> 0"),
    "json_ndjson_skip": (json_ndjson_skip, "SELECT conv_id, turn, role FROM conversations WHERE (conv_id + turn) % 7 <> 0"),
    "json_ndjson_fail_atomic": (json_ndjson_atomic, ATOMIC_SQL),
    "json_array_atomic": (json_array_atomic, ATOMIC_SQL),
    "ndjson_frames": (ndjson_frames, FRAMES_SQL),
    "kafka_json_encode": (kafka_json_encode, """SELECT CAST(c_custkey AS VARCHAR) AS key, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS value FROM customer"""),
    "kafka_size_guard": (kafka_size_guard, "SELECT doc_id, CAST(octet_length(encode(text)) + length(CAST(doc_id AS VARCHAR)) AS BIGINT) AS bytes FROM documents WHERE octet_length(encode(text)) + length(CAST(doc_id AS VARCHAR)) <= 4000"),
    "kafka_prefix_split": (kafka_prefix_split, "SELECT CASE user_id % 3 WHEN 0 THEN 'eu' ELSE 'us' END AS branch, event_type AS payload, count(*) AS n FROM events WHERE user_id % 3 < 2 GROUP BY 1, 2"),
}
