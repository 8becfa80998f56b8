"""Operators' rules, policies and state machines."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import avro, hashing
from millrace.functions.json_decode import check_framing, decode_array, decode_ndjson, decode_single, frame_lines
from millrace.operators import assignment, flow, objects, schema_check
from millrace.operators.chain import FAIL, SKIP, Pipeline
from millrace.operators.checkpoint import watermarks
from millrace.operators.routing import weighted_shard


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_fnv_and_xxh64(spark):
    import xxhash

    keys = [b"", b"a", b"user-1", "é日".encode(), bytes(range(256)), None]
    df = spark.createDataFrame([(k,) for k in keys], "k binary")
    rows = df.select(hashing.fnv1a64(F.col("k")).alias("h"), hashing.limbs_mod(hashing.fnv1a64(F.col("k")), 7).alias("m"), hashing.signed(hashing.fnv1a64(F.col("k"))).alias("s")).collect()
    for k, r in zip(keys, rows):
        if k is None:
            assert r["h"] is None
        else:
            assert (r["h"]["hi"] << 32 | r["h"]["lo"]) == fnv(k) and r["m"] == fnv(k) % 7 and r["s"] % 2**64 == fnv(k)
    assert fnv(b"a") == 0xAF63DC4C8601EC8C
    s = spark.createDataFrame([("abc", 5), ("", -1)], "s string, n long")
    got = s.select(hashing.xxh64(F.col("s"), spark).alias("a"), hashing.xxh64(F.col("n"), spark).alias("b")).collect()
    for r, (x, n) in zip(got, [("abc", 5), ("", -1)]):
        assert r["a"] % 2**64 == xxhash.xxh64_intdigest(x) and r["b"] % 2**64 == xxhash.xxh64_intdigest((n % 2**64).to_bytes(8, "little"))
    assert got[0]["a"] == 0x44BC2CF5AD770999


def test_golden_and_unsigned_mod(spark):
    n = [0, 1, 5, 2**31, 2**32 - 1]
    df = spark.createDataFrame([(x,) for x in n], "p long")
    assert [r[0] for r in df.select(hashing.golden_mod(F.col("p"), 1000003)).collect()] == [x * 0x9E3779B97F4A7C15 % 2**64 % 1000003 for x in n]
    s = [-1, -(2**63), 5, 0]
    df = spark.createDataFrame([(x,) for x in s], "h long")
    assert [r[0] for r in df.select(hashing.unsigned_mod(F.col("h"), 7)).collect()] == [x % 2**64 % 7 for x in s]


def test_weighted_shard(spark):
    df = spark.range(22)
    got = [r[0] for r in df.select(weighted_shard(F.col("id"), [9, 0, 10, 3])).collect()]
    assert got == [0] * 9 + [2] * 10 + [3] * 3
    with pytest.raises(ValueError):
        weighted_shard(F.lit(0), [0, 0])


def test_policies(spark):
    df = spark.range(5)
    error = F.when(F.col("id") == 3, F.lit("three"))
    assert Pipeline(df).try_map(error, SKIP, x=F.col("id") * 2).df.count() == 4
    with pytest.raises(Exception, match="three"):
        Pipeline(df).try_map(error, FAIL).df.count()
    with pytest.raises(ValueError):
        Pipeline(df).split("maybe")
    assert Pipeline(df).filter(F.when(F.col("id") > 1, True)).df.count() == 3


def test_split(spark):
    df = spark.range(4)
    s = Pipeline(df).split(FAIL).add("low", F.col("id") < 2).add("high", F.col("id") > 2)
    with pytest.raises(Exception, match="no branch"):
        s.tagged().collect()
    s = Pipeline(df).split(SKIP).add("low", F.col("id") < 2, times=F.lit(2)).add("odd", F.col("id") % 2 == 1, (F.col("id") * 10).alias("x"))
    assert sorted((r["id"], r["branch"]) for r in s.tagged().collect()) == [(0, "low"), (0, "low"), (1, "low"), (1, "low"), (1, "odd"), (3, "odd")]
    assert [r["id"] for r in s.unrouted().collect()] == [2]
    assert sorted(r["x"] for r in s.outputs()["odd"].collect()) == [10, 30]
    seen = {}
    s.write({"low": lambda d: seen.update(low=d.count()), "odd": lambda d: seen.update(odd=d.count())})
    assert seen == {"low": 4, "odd": 2}
    with pytest.raises(ValueError):
        s.write({})
    with pytest.raises(ValueError):
        s.add("low", F.lit(True))


def test_flat_map_keeps_the_envelope(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "partition int, xs array<int>")
    assert sorted(tuple(r) for r in Pipeline(df).flat_map(F.col("xs"), keep=["partition"]).df.collect()) == [(1, 1), (1, 2)]


def test_framing_rules(spark):
    texts = ["a\rb\r\nc\r\r\n\n \t\nd", "", "\n\n", "x\n", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(frame_lines(F.col("t"))).collect()]
    assert got == [["a\rb", "c\r", "d"], [], [], ["x"], ["x"]]
    with pytest.raises(ValueError):
        check_framing("per_record", "ndjson")
    check_framing("whole_payload", "array")


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab\r\n \t", max_size=12), min_size=1, max_size=20))
def test_framing_property(spark, texts):
    def lines(t):
        out = []
        for x in t.split("\n"):
            x = x[:-1] if x.endswith("\r") else x
            if x.strip(" \t\n\f\r"):
                out.append(x)
        return out

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(frame_lines(F.col("t"))).collect()] == [lines(t) for t in texts]


def test_json_policies(spark):
    schema = "struct<a: bigint, b: struct<c: bigint>>"
    rows = ['{"a":1,"b":{"c":2}}', '{"a":1,"b":{"c":2,"c":3}}', "{bad", " \n", '{"b":{}}', None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    ids = lambda d: sorted(r["i"] for r in d.collect())
    assert ids(decode_single(df, "v", schema, ["a"])) == [0, 1]
    assert ids(decode_single(df, "v", schema, ["a"], reject_duplicate_keys=True)) == [0]
    with pytest.raises(Exception, match="malformed"):
        decode_single(df, "v", schema, ["a"], "fail").collect()
    many = spark.createDataFrame([(0, '{"a":1}\n{"a":2}'), (1, '{"a":1}\n{bad'), (2, "")], "i int, v string")
    assert ids(decode_ndjson(many, "v", "struct<a: bigint>", ["a"])) == [0, 0, 1]
    assert ids(decode_ndjson(many, "v", "struct<a: bigint>", ["a"], "atomic")) == [0, 0]
    arrays = spark.createDataFrame([(0, '[{"a":1},{"a":2}]'), (1, '[{"a":1},{}]'), (2, '{"a":1}'), (3, '[{"a":1}'), (4, "[]")], "i int, v string")
    assert ids(decode_array(arrays, "v", "struct<a: bigint>", ["a"])) == [0, 0]


def test_watermarks(spark):
    rows = [(0, 0, 9, "delivered"), (0, 1, 19, "delivered"), (1, 0, 9, "failed"), (1, 1, 19, "delivered"), (2, 0, 9, "delivered"), (2, 1, 19, "pending"), (2, 2, 29, "delivered")]
    df = spark.createDataFrame(rows, "partition int, seq long, last_offset long, status string")
    got = {r["partition"]: (r["watermark"], r["stalled"], r["held"]) for r in watermarks(df).collect()}
    assert got == {0: (20, False, 0), 1: (None, True, 2), 2: (10, False, 2)}


@given(st.integers(1, 10**4), st.floats(1, 5), st.integers(1, 60), st.floats(0, 1))
def test_backoff(initial, factor, attempt, jitter):
    r = flow.Retry(initial_ms=initial, factor=factor, cap_ms=max(initial, 10_000), jitter=jitter)
    full = r.delay(attempt)
    assert full <= r.cap_ms + 1e-6 and r.delay(attempt, random.Random(1)) <= full
    assert full >= initial - 1e-9
    assert flow.Retry(attempts=3).delay(2) is not None and flow.Retry(attempts=3).delay(3) is None


@given(st.lists(st.tuples(st.integers(0, 1200), st.booleans()), max_size=60))
def test_backpressure(steps):
    m = flow.Backpressure(budget=1000, min_pause_ms=3)
    paused, since = False, 0
    for t, (used, rejected) in enumerate(steps):
        a = m.step(t, used, True, rejected)
        if not paused:
            assert (a == "pause") == (rejected or used >= 800)
        else:
            assert (a == "resume") == (not rejected and used <= 500 and t - since >= 3)
        if a == "pause":
            paused, since = True, t
        elif a == "resume":
            paused = False


def test_budget_saturates():
    b = flow.ByteBudget()
    assert b.sub(5) == 0 and b.add(2**64) == 2**64 - 1 and b.add(1) == 2**64 - 1


def test_breaker():
    b = flow.Breaker(2, threshold=2, open_for_ms=100)
    assert b.pick(0) == (0, 0) and b.pick(0) == (1, 0) and b.pick(0) == (0, 0)
    b.failure(0, 0)
    b.failure(0, 0)
    assert b.state(0) == "open" and b.pick(1)[0] == 1 and b.pick(1)[0] == 1
    b.failure(0, 50)  # while open it keeps its time
    i, episode = b.pick(100)
    assert (i, episode) == (0, 1) and b.state(0) == "half_open" and b.pick(100)[0] == 1
    b.release(0, 0)  # of an earlier episode
    assert b.states[0].probes == 1
    b.release(0, 1)
    assert b.states[0].probes == 0
    b.failure(0, 100)
    assert b.state(0) == "open"
    b.success(0)
    assert b.state(0) == "closed"


@given(st.lists(st.integers(0, 500), max_size=60), st.integers(16, 400))
def test_packing_of_objects(sizes, target):
    entries = [objects.Entry(f"k{i:03d}", n) for i, n in enumerate(sizes)]
    splits = objects.pack(entries, target)
    assert sorted(e.key for s in splits for e in s) == [e.key for e in entries]
    for s in splits:
        assert len(s) == 1 or sum(max(e.size, target // 16) for e in s) <= target
        assert objects.split_id(s) == objects.split_id(s[::-1])
    assert len({objects.split_id(s) for s in splits}) == len(splits)


def test_offsets(spark):
    df = spark.createDataFrame([(0, 0), (5, 77), (2**23 - 1, 2**40 - 2), (2**23, 0), (0, 2**40 - 1), (-1, 0)], "o long, r long")
    e = df.withColumn("p", objects.encode_offset(F.col("o"), F.col("r")))
    rows = e.select("o", "r", "p", objects.decode_offset(F.col("p")).alias("d")).collect()
    for r in rows[:3]:
        assert (r["d"]["ordinal"], r["d"]["record"]) == (r["o"], r["r"])
    assert all(r["p"] is None for r in rows[3:])


def test_split_id_column(spark):
    df = spark.createDataFrame([("é/x.gz", "e1"), ("", "")], "k string, e string")
    assert [r[0] for r in df.select(objects.split_id_column(F.col("k"), F.col("e"))).collect()] == [objects.split_id([objects.Entry("é/x.gz", 1, "e1")]), objects.split_id([objects.Entry("", 0, "")])]


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from(["a", "b", "c", "gone", None])), max_size=25), st.integers(1, 30))
def test_assignment(splits, cap):
    table = {f"s{i}": x for i, x in enumerate(splits)}
    got = assignment.desired_assignment(["a", "b", "c"], table, default_cap=cap)
    assert got == assignment.desired_assignment(["c", "a", "b"], dict(reversed(table.items())), default_cap=cap)
    count = {m: sum(v == m for v in got.values()) for m in "abc"}
    assert max(count.values(), default=0) <= cap and len(got) == min(len(table), 3 * cap)
    if cap >= len(table):
        weight = {s: max(1, w) for s, (w, _) in table.items()}
        load = {m: sum(weight[s] for s, v in got.items() if v == m) for m in "abc"}
        for s, m in got.items():
            assert not any(load[m] > load[o] + weight[s] for o in "abc")


def slow_assignment(members, splits, reserved, caps, default, seed):
    """The same plan by looking at every move."""
    names = sorted(members, key=lambda m: (assignment.tie(seed, m), m))
    room = {m: max(1, caps.get(m, default)) for m in names}
    w = {s: max(1, x[0]) for s, x in splits.items() if s not in reserved}
    owner = {}
    load = lambda m: sum(w[s] for s, o in owner.items() if o == m)
    free = lambda m: sum(o == m for o in owner.values()) < room[m]
    for s in sorted(w, key=lambda s: (-w[s], s)):
        if splits[s][1] in names and free(splits[s][1]):
            owner[s] = splits[s][1]
    for s in sorted(w, key=lambda s: (-w[s], s)):
        able = [m for m in names if free(m)]
        if s not in owner and able:
            owner[s] = min(able, key=load)
    while True:
        sums = {m: load(m) for m in names}
        moves = []
        for a in names:
            able = [m for m in names if m != a and free(m)]
            if able:
                b = min(able, key=sums.get)
                moves += [(-2 * w[s] * (sums[a] - sums[b] - w[s]), names.index(a), s, b) for s, o in owner.items() if o == a and sums[a] > sums[b] + w[s]]
        if not moves:
            return owner
        _, _, s, b = min(moves)
        owner[s] = b


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["a", "b", "c", "gone", None])), max_size=25), st.integers(0, 12), st.integers(0, 9), st.sets(st.integers(0, 25), max_size=5))
def test_assignment_equals_slow_one(splits, cap, seed, out):
    table = {f"s{i:02}": x for i, x in enumerate(splits)}
    reserved = {f"s{i:02}" for i in out}
    got = assignment.desired_assignment(["a", "b", "c"], table, reserved, {"b": cap}, 9, seed)
    assert got == slow_assignment(["a", "b", "c"], table, reserved, {"b": cap}, 9, seed)
    assert not reserved & set(got)


def test_assignment_floors():
    assert assignment.desired_assignment(["a"], {"s": (0, None), "t": (0, None)}, caps={"a": 0}) == {"s": "a"}
    assert assignment.desired_assignment([], {"s": (1, None)}) == {}


def test_assign_query_equals_slow_plans(spark, sf):
    from millrace.plans import state_queries as q

    jobs = {}
    for r in q._fleet(spark, sf).collect():
        jobs.setdefault(int(r["split"]) // 100, {})[r["split"]] = (r["weight"], r["owner"])
    want = {}
    for splits in jobs.values():
        want |= slow_assignment(q.FLEET, splits, {s for s in splits if int(s) % 10 == 0}, q.FLEET_CAPS, 20, 0x5EA1)
    assert {r["split"]: r["member"] for r in q.assign_desired(spark, sf).collect()} == want


def test_claims(spark):
    rows = [
        ("never owned", "runnable", None, None, 0, 5, True, ("claim", "create")),
        ("given back, attempts don't matter", "runnable", None, None, 3, 5, True, ("claim", "released")),
        ("another's live lease", "runnable", "other", "other", 1, 9, True, None),
        ("mine", "runnable", "me", "me", 1, 2, True, ("claim", "reclaim")),
        ("mine, for the last time", "runnable", "me", "me", 1, 3, True, ("quarantine", "reclaim")),
        ("left behind", "runnable", None, "gone", 1, 0, True, ("claim", "expired")),
        ("left behind too often", "runnable", None, "gone", 1, 3, False, ("quarantine", "expired")),
        ("not described yet", "runnable", None, "gone", 1, 0, False, None),
        ("done", "completed", None, None, 0, 0, True, None),
    ]
    df = spark.createDataFrame([r[:7] for r in rows], "name string, status string, lease string, owner string, epoch long, attempts int, known boolean")
    c = F.col
    got = df.select("name", assignment.claim(c("status"), c("lease"), F.lit("me"), c("owner"), c("epoch"), c("attempts"), 4, c("known")).alias("x")).collect()
    assert {r["name"]: r["x"] and tuple(r["x"]) for r in got} == {r[0]: r[7] for r in rows}


def test_packing_counts_empty_objects():
    assert [len(s) for s in objects.pack([objects.Entry(str(i), 0) for i in range(40)], 8)] == [8] * 5


def test_json_strictness(spark):
    schema = "struct<a: bigint, b: string, c: struct<d: double>>"
    rows = ['{"a":1}', '{"a":1} junk', '{"a":1}{"a":2}', '{"a":1},{"a":2}', '{"a":1}] [', '{"a":"1"}', '{"a":1.5}', '{"a":1,"b":5}', '{"a":1,"c":{"d":"x"}}', '{"a":1,"c":{"d":2},"z":[{}]}', ' {"a":1}\n ', '{"a":1,"c":{"z":1,"z":2}}', "[1]", '"x"', '{"b":null}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    ids = lambda d: sorted(r["i"] for r in d.collect())
    assert ids(decode_single(df, "v", schema, ["a"])) == [0, 7, 9, 10, 11]
    assert ids(decode_single(df, "v", schema, ["a"], reject_duplicate_keys=True)) == [0, 7, 9, 10]
    assert decode_single(df, "v", schema, ["a"]).schema["record"].dataType.fieldNames() == ["a", "b", "c"]
    lines = spark.createDataFrame([(0, '{"a":1}\n{"a":1,"a":2}\n{"a":1} x'), (1, '{"a":3}')], "i int, v string")
    assert ids(decode_ndjson(lines, "v", schema, ["a"])) == [0, 0, 1]
    assert ids(decode_ndjson(lines, "v", schema, ["a"], reject_duplicate_keys=True)) == [0, 1]
    assert ids(decode_ndjson(lines, "v", schema, ["a"], "atomic")) == [1]
    arrays = spark.createDataFrame([(0, '[{"a":1},{"a":1,"a":2}]'), (1, '[{"a":3}] [{"a":4}]'), (2, '[{"a":"x"}]'), (3, '[{"a":5}]')], "i int, v string")
    assert ids(decode_array(arrays, "v", schema, ["a"])) == [0, 0, 3]
    assert ids(decode_array(arrays, "v", schema, ["a"], reject_duplicate_keys=True)) == [3]


ORDER = {"type": "record", "name": "R", "fields": [{"name": "i", "type": "int"}, {"name": "l", "type": "long"}, {"name": "f", "type": "float"}, {"name": "d", "type": "double"}, {"name": "s", "type": "string"}, {"name": "b", "type": "bytes"}, {"name": "t", "type": "boolean"}, {"name": "u", "type": ["null", "string", "long"]}, {"name": "a", "type": {"type": "array", "items": "long"}}, {"name": "m", "type": {"type": "map", "values": "int"}}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["X", "Y"]}}, {"name": "x", "type": {"type": "fixed", "name": "F", "size": 2}}]}


@given(st.fixed_dictionaries({"i": st.integers(-(2**31), 2**31 - 1), "l": st.integers(-(2**63), 2**63 - 1), "f": st.just(0.5), "d": st.floats(allow_nan=False), "s": st.text(), "b": st.binary(), "t": st.booleans(), "u": st.one_of(st.none(), st.text(), st.integers(-(2**63), 2**63 - 1)), "a": st.lists(st.integers(-(2**40), 2**40)), "m": st.dictionaries(st.text(), st.integers(0, 9)), "e": st.sampled_from(["X", "Y"]), "x": st.binary(min_size=2, max_size=2)}))
def test_avro_round_trip(value):
    data = avro.encode(ORDER, value)
    codec = avro.Codec(ORDER)
    assert codec.decode(data) == value
    with pytest.raises(avro.AvroError):
        codec.decode(data + b"\0")
    with pytest.raises(avro.AvroError):
        codec.decode(data[:-1])


def test_avro_resolution():
    w = {"type": "record", "name": "A", "fields": [{"name": "id", "type": "int"}, {"name": "name", "type": "string"}, {"name": "gone", "type": {"type": "array", "items": "string"}}]}
    r = {"type": "record", "name": "A", "fields": [{"name": "name", "type": "string"}, {"name": "id", "type": "double"}, {"name": "channel", "type": "string", "default": "web"}]}
    data = avro.encode(w, {"id": 7, "name": "n", "gone": ["a", "b"]})
    assert avro.Codec(w, r).decode(data) == {"name": "n", "id": 7.0, "channel": "web"}
    with pytest.raises(avro.AvroError):
        avro.Codec(w, {"type": "record", "name": "A", "fields": [{"name": "new", "type": "int"}]})
    with pytest.raises(avro.AvroError):
        avro.Codec("string", "int")
    with pytest.raises(avro.AvroError):
        avro.Codec({"type": "fixed", "name": "D", "size": 12, "logicalType": "duration"})


def test_avro_fingerprints(spark):
    assert avro.fingerprint('"int"'.strip('"')) == 0x7275D51A3F395C8F
    assert avro.canonical({"type": "record", "name": "R", "namespace": "a.b", "doc": "x", "fields": [{"name": "f", "type": {"type": "long", "logicalType": "timestamp-millis"}}]}) == '{"name":"a.b.R","type":"record","fields":[{"name":"f","type":"long"}]}'
    fp = avro.fingerprint("int")
    rows = [(b"\xc3\x01" + fp.to_bytes(8, "little") + b"\x02",), (b"\xc3",), (b"\0\0\0\1\0zz",)]
    df = spark.createDataFrame(rows, "v binary")
    got = df.select(avro.single_object_fingerprint(F.col("v")), avro.confluent_id(F.col("v")), avro.confluent_datum(F.col("v"))).collect()
    assert got[0][0] == f"{fp:016X}" and got[1][0] is None and got[2][1] == 256 and got[1][1] is None and bytes(got[2][2]) == b"zz"


def test_avro_column_policies(spark):
    df = spark.createDataFrame([(avro.encode("long", 5),), (b"\x80",), (None,)], "v binary").select(avro.decode_column(F.col("v"), {"type": "record", "name": "R", "fields": [{"name": "n", "type": "long"}]}, "struct<n: bigint>").alias("d"))
    assert [r["d"] and r["d"]["n"] for r in df.collect()] == [5, None, None]


def test_schema_cache():
    now = [0.0]
    store = {1: "int"}
    down = [False]

    def fetch(i):
        if down[0]:
            raise OSError
        return store[i]

    c = avro.SchemaCache(fetch, 30, lambda: now[0])
    down[0] = True
    assert c.get(1) is None
    down[0] = False
    assert c.get(1) == "int"
    with pytest.raises(avro.SchemaUnavailable):
        c.get(2)
    store[2] = "long"
    with pytest.raises(avro.SchemaUnavailable):
        c.get(2)
    now[0] = 31
    assert c.get(2) == "long"
    del store[1]
    assert c.get(1) == "int"


def test_types_and_schema_findings(spark):
    p = schema_check.parse_type
    assert p("Nullable(DateTime64(3, 'UTC'))").args[0].args == (3, "UTC")
    assert p("Tuple(a Int8, b String)").labels == ("a", "b") and p("Tuple(Int8, String)").labels == ()
    assert p("Array(").name == "Other" and p("Enum8('a,b' = 1, ')' = 2)").name == "Enum8" and p("AggregateFunction(sum, UInt8)").name == "Other"
    assert p("Decimal64(4)").args == (18, 4) and p("Map(String, Array(UInt8))").spark().simpleString() == "map<string,array<smallint>>"
    df = spark.createDataFrame([], "id long not null, name string")
    c = schema_check.TargetColumn
    ok = [c("id", "Int64"), c("name", "Nullable(String)")]
    assert schema_check.validate(df.schema, ok).errors == []
    assert len(schema_check.validate(df.schema, [c("id", "Nullable(Int32)"), c("name", "String")]).errors) == 2
    assert schema_check.validate(df.schema, [c("id", "Int8")], "names").errors == ["name: not in the table"]
    assert schema_check.validate(df.schema, [], "off").errors == []
    assert schema_check.same_on_all([ok, ok, ok[:1]]) == ["replica 2: its columns differ from those of replica 0"]
    assert schema_check.check_layout([1], "x", [1], "Distributed('c', d, t, `x`)") == []
