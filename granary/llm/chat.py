"""Chat formatting with a reversible template and a loss mask, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.text import running_starts

#: Control strings of the template; every "<|", "[INST]", "[/INST]", "<s>" and "</s>" of a text is escaped.
OPEN, OPEN_END, NEXT, END = "<|role=", "|>", "<|next|>", "<|end|>"
_PLAIN = r"([<\[])(\\*)(/?s>|\||/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|\||/?INST\])"


def escape(text: Column) -> Column:
    """One more backslash inside each control string, so that none is left and each can be restored."""
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    turns has conv_id, turn, role, text. Turns are collected, sorted by turn
    (nulls first; ties by role and text) and adjacent turns of one role become
    one block: ``<|role=R|>text<|next|>text<|end|>``. R is URL-encoded.
    loss_spans are the code-point spans (start, end) of the texts of
    ``trained_role`` in formatted, in order.

    Null texts and roles count as empty strings. A null conv_id is a
    conversation of its own. Repeated rows are turns of their own. An empty
    table gives an empty result. A conversation is one cell of the result, so
    it must fit in a row; the array functions are linear in its turns.
    """
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    told = turns.select("conv_id", turn.alias("told")).groupBy("conv_id").agg(F.array_sort(F.collect_list("told")).alias("told"))
    firsts = F.filter(
        F.sequence(F.lit(1), F.size("told")),
        lambda i: (i == 1) | (F.col("told")[i - 1]["role"] != F.col("told")[F.greatest(i - 2, F.lit(0))]["role"]),
    )
    blocks = F.transform(
        "firsts",
        lambda first, k: F.struct(
            F.col("told")[first - 1]["role"].alias("role"),
            F.transform(
                F.slice("told", first, F.coalesce(F.get("firsts", k + 1), F.size("told") + 1) - first),
                lambda t: escape(t["text"]),
            ).alias("texts"),
        ),
    )
    merged = told.withColumn("firsts", firsts).select("conv_id", blocks.alias("blocks"))
    # Every block is a list of parts: marker, text, marker, text, ..., marker.
    parts = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.flatten(
                F.transform(
                    b["texts"],
                    lambda t, j: F.array(
                        F.struct(
                            F.when(j == 0, F.concat(F.lit(OPEN), F.url_encode(b["role"]), F.lit(OPEN_END)))
                            .otherwise(F.lit(NEXT))
                            .alias("part"),
                            F.lit(False).alias("loss"),
                        ),
                        F.struct(t.alias("part"), (b["role"] == trained_role).alias("loss")),
                        F.struct(
                            F.when(j == F.size(b["texts"]) - 1, F.lit(END)).otherwise(F.lit("")).alias("part"),
                            F.lit(False).alias("loss"),
                        ),
                    ),
                )
            ),
        )
    )
    laid = merged.select("conv_id", parts.alias("parts")).withColumn(
        "starts", running_starts(F.transform("parts", lambda p: F.length(p["part"]).cast("long")))
    )
    spans = F.filter(
        F.zip_with(
            "parts",
            "starts",
            lambda p, at: F.struct(
                at.alias("start"), (at + F.length(p["part"])).alias("end"), p["loss"].alias("loss")
            ),
        ),
        lambda s: s["loss"],
    )
    return laid.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"], s["end"])).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_replace(b, r"^<\|role=[^|]*\|>", ""), r"<\|next\|>", -1),
                lambda t: F.struct(
                    F.url_decode(F.regexp_extract(b, r"^<\|role=([^|]*)\|>", 1)).alias("role"), unescape(t).alias("text")
                ),
            ),
        )
    )


def read_loss_texts(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, one unescaped text per span."""
    return F.transform(
        spans,
        lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
