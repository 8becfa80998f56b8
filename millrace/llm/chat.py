"""Chat formatting with Spark expressions only.

Turns become `<|role:R|>` NEWLINE text {`<|turn|>` text} `<|end|>` NEWLINE: adjacent turns of one role share a header and
an end mark. Inside texts each `<`, any number of `&`, `|` gets one more `&`, so that no text holds a control string and
one `&` less gives the text back. In roles `%` and `|` are written `%25` and `%7C`.

Null texts and roles are empty ones, a null turn sorts first, rows with the same turn sort by role and text, repeated
rows stay, and a null conversation id is a conversation of its own. An empty table gives an empty result. Other columns
of the input are ignored.

A conversation is gathered in two steps, so that one with very many turns is sorted and formatted by many tasks in
segments; only finished segments meet in the conversation's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(&*)\|", r"<&$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<&(&*)\|", r"<$1|")


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|role:"), F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C")), F.lit("|>\n"))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant", segment_turns: int = 64) -> DataFrame:
    """conv_id and segments: array of (text, loss), whose texts concatenated are the formatted conversation; loss has the
    (start, length) in characters of each text of `loss_role` within its segment."""
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seg = F.floor(F.col("turn") / F.lit(segment_turns)).alias("seg")
    parts = rows.groupBy("conv_id", seg).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    t = F.col("t")
    last = F.size(t) - 1

    def piece(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.when(F.get(t, i - 1)["role"] == x["role"], "").otherwise(_header(x["role"]))).otherwise("")
        after = F.when(i < last, F.when(F.get(t, i + 1)["role"] == x["role"], TURN).otherwise(END)).otherwise("")
        body = escape(x["text"])
        return F.struct(F.concat(before, body, after).alias("s"), F.length(before).alias("lead"), F.length(body).alias("n"), (x["role"] == loss_role).alias("loss"))

    parts = parts.withColumn("p", F.transform(t, piece)).select(
        "conv_id",
        "seg",
        F.get(t, F.lit(0))["role"].alias("first"),
        F.element_at(t, -1)["role"].alias("final"),
        F.array_join(F.col("p.s"), "").alias("body"),
        F.aggregate(
            "p",
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x["s"])).alias("at"),
                F.when(x["loss"], F.array_append(a["spans"], F.struct((a["at"] + x["lead"]).alias("start"), x["n"].alias("length")))).otherwise(a["spans"]).alias("spans"),
            ),
        )["spans"].alias("spans"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "first", "final", "body", "spans"))).alias("g"))
    g = F.col("g")
    end = F.size(g) - 1

    def segment(x: Column, i: Column) -> Column:
        head = F.when((i > 0) & (F.get(g, i - 1)["final"] == x["first"]), "").otherwise(_header(x["first"]))
        tail = F.when((i < end) & (F.get(g, i + 1)["first"] == x["final"]), TURN).otherwise(END)
        return F.struct(F.concat(head, x["body"], tail).alias("text"), F.transform(x["spans"], lambda s: F.struct((s["start"] + F.length(head)).alias("start"), s["length"].alias("length"))).alias("loss"))

    return whole.select("conv_id", F.transform(g, segment).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    blocks = F.filter(F.split(text, r"<\|end\|>\n", -1), lambda b: b != "")

    def block(b: Column) -> Column:
        head = F.substring_index(b, "|>\n", 1)
        role = F.replace(F.replace(F.substr(head, F.lit(8)), F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))
        return F.transform(F.split(F.substr(b, F.length(head) + 4), r"<\|turn\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, block))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.flatten(F.transform(segments, lambda s: F.transform(s["loss"], lambda x: unescape(F.substr(s["text"], x["start"] + 1, x["length"]))))), "")
