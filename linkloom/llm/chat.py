"""Chat formatting in Spark expressions.

Turn structs of a conversation are collected and sorted, adjacent turns of one role are merged
into a block, and blocks are concatenated:

    <|im_start|>ROLE\nTEXT<|turn|>TEXT<|im_end|>\n

Control strings inside texts (this template's and those of other common templates) get a
backslash after their first character, and one more if they have some already, so no text can
close a turn and unescaping gives back every text. Roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|turn|>", "<|im_end|>\n"
#: What may follow the first character of a control string.
TAILS = r"(?:\||/?s>|/?INST\]|</?SYS>>)"
CHUNK = 256


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(?=\\*{TAILS})", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(?=\\*{TAILS})", "$1")


def _starts(lengths: Column) -> Column:
    """Running sums before each element; in blocks, so the cost isn't the square of the length."""
    last = F.element_at
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(lengths) / CHUNK).cast("int") - 1)),
        lambda b: F.slice(lengths, b * CHUNK + 1, CHUNK),
    )

    def running(xs: Column, first: Column) -> Column:
        grown = F.aggregate(xs, F.array(first), lambda a, x: F.concat(a, F.array(last(a, -1) + x)))
        return F.slice(grown, F.lit(1), F.size(xs))

    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y))
    return F.flatten(F.zip_with(blocks, running(sums, F.lit(0).cast("long")), running))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of (conv_id, turn, role, text) rows.

    loss_mask: array of (start, length), in code points of ``formatted``, of the assistant's
    texts as they stand there. Turns go by (turn, role, text), nulls first; null text and role
    are empty; repeated rows stay repeated; rows with a null conv_id form one conversation;
    other columns are ignored; an empty table gives no rows. Conversations are gathered in
    two steps, by runs of turn numbers and then whole, so sorting a huge one is shared out.
    """
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / CHUNK).alias("part"),
        F.struct(
            "turn",
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = (
        rows.groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_list("t")).alias("ts"))
        .groupBy("conv_id")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ts"))), lambda x: x["ts"])).alias("ts"))
    )
    at = lambda i: F.get("ts", i)
    firsts = whole.withColumn(
        "firsts",
        F.filter(
            F.sequence(F.lit(0), F.size("ts") - 1),
            lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]),
        ),
    )
    blocks = firsts.select(
        "conv_id",
        F.transform(
            "firsts",
            lambda s, k: F.struct(
                F.url_encode(at(s)["role"]).alias("role"),
                (at(s)["role"] == "assistant").alias("loss"),
                F.transform(
                    F.slice("ts", s + 1, F.coalesce(F.get("firsts", k + 1), F.size("ts")) - s),
                    lambda t: escape(t["text"]),
                ).alias("texts"),
            ),
        ).alias("blocks"),
    )
    head = lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"))
    pieces = lambda b: F.transform(
        b["texts"],
        lambda t, i: F.struct(
            F.when(i == 0, F.length(head(b))).otherwise(len(SEP)).cast("long").alias("gap"),
            F.length(t).cast("long").alias("len"),
            F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).cast("long").alias("tail"),
            b["loss"].alias("loss"),
        ),
    )
    laid = blocks.select(
        "conv_id",
        F.array_join(
            F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], SEP), F.lit(END))), ""
        ).alias("formatted"),
        F.flatten(F.transform("blocks", pieces)).alias("pieces"),
    )
    placed = laid.withColumn("at", _starts(F.transform("pieces", lambda p: p["gap"] + p["len"] + p["tail"])))
    spans = F.zip_with(
        "pieces", "at", lambda p, a: F.struct((a + p["gap"]).alias("start"), p["len"].alias("length"), p["loss"].alias("loss"))
    )
    return placed.select(
        "conv_id",
        "formatted",
        F.transform(
            F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))
        ).alias("loss_mask"),
    )


def parse_turns(formatted: Column) -> Column:
    """The array of (role, text) turns that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b.startswith(START))

    def of(b: Column) -> Column:
        role = F.url_decode(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1))
        body = F.regexp_replace(b, r"^[^\n]*\n", "")
        return F.transform(
            F.split(body, r"<\|turn\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, of))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(
        F.transform(
            mask,
            lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
        ),
        "",
    )
