"""JSON payload decoding: single documents, newline-delimited documents, arrays; strictness; NDJSON framing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"^[ \t\n\f\r]*\z"
PER_RECORD, WHOLE_PAYLOAD = "per_record", "whole_payload"


def check_framing(source: str, decoder: str) -> None:
    """A source that already cuts records must not meet a decoder that cuts again."""
    if source == PER_RECORD and decoder != "single":
        raise ValueError(f"the source frames records, so the decoder must be 'single', not {decoder!r}")


def is_blank(value: Column) -> Column:
    return value.rlike(BLANK)


CORRUPT = "_corrupt"


def whole_document(value: Column) -> Column:
    """Whether a string is one JSON document with nothing behind it. It is read as the first of two elements of an array
    whose second one is the string's own hash, which nothing inside the string can stand for."""
    mark = F.xxhash64(value).cast("string")
    items = F.from_json(F.concat(F.lit("["), value, F.lit(',"'), mark, F.lit('"]')), "array<string>")
    return F.coalesce((F.size(items) == 2) & (items[1] == mark), F.lit(False))


def parsed(value: Column, schema: T.StructType | str) -> Column:
    """The record with one more field, CORRUPT, which is not null if a field has another type than its JSON value."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])
    return F.from_json(value, wide, {"columnNameOfCorruptRecord": CORRUPT})


def reason(value: Column, record: Column, required: list[str], reject_duplicate_keys: bool = False) -> Column:
    """Why a document is malformed: syntax (trailing content included), duplicate_key, type, or missing:<field>; else null."""
    out = F.when(record.isNull() | ~whole_document(value), "syntax")
    if reject_duplicate_keys:
        out = out.when(F.try_parse_json(value).isNull(), "duplicate_key")
    out = out.when(record[CORRUPT].isNotNull(), "type")
    for name in required:
        out = out.when(record[name].isNull(), f"missing:{name}")
    return out


def decode_single(df: DataFrame, value: str, schema: T.StructType | str, required: list[str], errors: str = "skip", reject_duplicate_keys: bool = False) -> DataFrame:
    """A `record` for each payload. Blank payloads are tombstones and give no row; a malformed payload (trailing content and
    values of another type than their field's count as such), or one that lacks a required field, is skipped or stops the
    query. With reject_duplicate_keys a repeated key at any depth is malformed."""
    rows = df.filter(~F.coalesce(is_blank(F.col(value)), F.lit(True))).withColumn("record", parsed(F.col(value), schema))
    return _plain(_apply(rows, reason(F.col(value), F.col("record"), required, reject_duplicate_keys), errors))


def count_reasons(df: DataFrame, value: str, schema: T.StructType | str, required: list[str], reject_duplicate_keys: bool = False) -> DataFrame:
    """reason and n: how many payloads decode_single skips, and why (tombstone among the reasons)."""
    blank = F.coalesce(is_blank(F.col(value)), F.lit(True))
    rows = df.withColumn("record", parsed(F.col(value), schema))
    why = F.when(blank, "tombstone").otherwise(reason(F.col(value), F.col("record"), required, reject_duplicate_keys))
    return rows.select(why.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("record", F.col("record").dropFields(CORRUPT))


def _apply(rows: DataFrame, why: Column, errors: str) -> DataFrame:
    if errors == "skip":
        return rows.filter(why.isNull())
    if errors != "fail":
        raise ValueError(f"errors is {errors!r}, not skip or fail")
    return rows.filter(F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("malformed payload: "), why)).cast("boolean")).otherwise(F.lit(True)))


def frame_lines(value: Column) -> Column:
    """The records of a newline-delimited payload: cut at line feeds alone, one carriage return at the end dropped, lines
    of white space left out; a last line without a line feed counts."""
    lines = F.transform(F.split(value, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.filter(lines, lambda x: ~x.rlike(BLANK))


def _items(texts: Column, schema: str, required: list[str], reject_duplicate_keys: bool) -> Column:
    """record and why (null: sound) of each document of an array of strings."""

    def one(x: Column) -> Column:
        r = parsed(x, schema)
        return F.struct(r.alias("record"), reason(x, r, required, reject_duplicate_keys).alias("why"))

    return F.transform(texts, one)


def _atomic(rows: DataFrame, bad: Column, errors: str) -> DataFrame:
    """Payloads in which any document is malformed go whole, or stop the query."""
    first = F.filter("_items", lambda i: i["why"].isNotNull())
    why = F.when(bad, "syntax").otherwise(F.try_element_at(first, F.lit(1))["why"])
    kept = _apply(rows, why, "skip" if errors == "atomic" else errors)
    return _plain(kept.withColumn("record", F.explode(F.transform("_items", lambda i: i["record"]))).drop("_items"))


def decode_ndjson(df: DataFrame, value: str, schema: str, required: list[str], errors: str = "skip", reject_duplicate_keys: bool = False) -> DataFrame:
    """A `record` for each line. skip: bad lines alone go. atomic: a payload with a bad line goes whole. fail: it stops."""
    rows = df.withColumn("_items", _items(frame_lines(F.col(value)), schema, required, reject_duplicate_keys))
    if errors == "skip":
        return _plain(rows.withColumn("record", F.explode(F.filter("_items", lambda i: i["why"].isNull()))).drop("_items").withColumn("record", F.col("record.record")))
    return _atomic(rows, F.lit(False), errors)


def decode_array(df: DataFrame, value: str, schema: str, required: list[str], errors: str = "skip", reject_duplicate_keys: bool = False) -> DataFrame:
    """A `record` for each element of a top-level array; a payload with a bad element, or no array, goes whole."""
    rows = df.filter(~F.coalesce(is_blank(F.col(value)), F.lit(True)))
    rows = rows.withColumn("_items", _items(F.from_json(value, "array<string>"), schema, required, reject_duplicate_keys))
    bad = ~F.col(value).rlike(r"^[ \t\n\r]*\[") | F.col("_items").isNull() | ~whole_document(F.col(value))
    return _atomic(rows, bad, "atomic" if errors == "skip" else errors)


def read_ndjson(spark, path: str) -> DataFrame:
    """Lines of newline-delimited files (plain, gzip, zstd by extension), framed as frame_lines does."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value"), F.input_file_name().alias("file"))
    return rows.filter(~F.col("value").rlike(BLANK))


def json_message(key: Column | None, payload: Column, headers: dict[str, str] | None = None) -> list[Column]:
    """Columns of a message sink: key, value (JSON) and headers."""
    out = [key.cast("binary").alias("key") if key is not None else F.lit(None).cast("binary").alias("key"), F.to_json(payload).alias("value")]
    if headers:
        out.append(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).cast("binary").alias("value")) for k, v in headers.items()]).alias("headers"))
    return out


def message_bytes(key: Column, value: Column) -> Column:
    return F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))
