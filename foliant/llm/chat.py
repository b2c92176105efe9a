"""Chat formatting with Spark expressions only.

Per conversation the turn structs are collected and sorted, adjacent turns of one role become one run (array
aggregation over the slice of the run), and runs are concatenated into one text:

    <s><|im_start|>ROLE\\nTEXT<|im_more|>TEXT<|im_end|>\\n...</s>

``<|im_more|>`` stands between the texts of a run, so that merging loses nothing. Control strings inside texts get a
backslash after their first character, and one more if they already had some: ``</s>`` becomes ``<\\/s>``. The reverse
takes one off. Control strings hold their first character only once, so matches never overlap and no text can contain
an unescaped one. Roles are percent-encoded. The loss mask covers the texts of assistant turns; it comes as runs of
code points, in turn masked and not masked.

Cases: null text is empty; null role is an empty role; turns are ordered by (turn, role, text) with nulls first, so
ties and repeated rows have one defined order and each row stays a turn; an empty table gives no rows; columns other
than the four are not read. A conversation is one row of the result, so its text must fit in a row (2 GB).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import materialize

START, MORE, END = "<|im_start|>", "<|im_more|>", "<|im_end|>"
OPEN, CLOSE = "<s>", "</s>"
# Strings with a meaning in this template or in other common ones; each begins with < or [.
CONTROL = (START, MORE, END, OPEN, CLOSE, "[INST]", "[/INST]")
TAILS = "|".join(re.escape(x[1:]) for x in CONTROL)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({TAILS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({TAILS})", "$1$2$3")


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_turns(turns: Column) -> Column:
    """array<struct<text, loss>>: the pieces of the formatted text, in order."""

    def run(first: Column, after: Column) -> Column:
        mine = F.slice(turns, first + 1, after - first)
        role = F.get(turns, first)["role"]
        loss = role == "assistant"
        head = F.concat(F.lit(START), F.url_encode(role), F.lit("\n"))
        texts = F.transform(mine, lambda t: escape(t["text"]))
        body = F.flatten(
            F.transform(
                texts,
                lambda t, i: F.array(
                    F.struct(F.when(i == 0, head).otherwise(F.lit(MORE)).alias("text"), F.lit(False).alias("loss")),
                    F.struct(t.alias("text"), loss.alias("loss")),
                ),
            )
        )
        return F.concat(body, F.array(F.struct(F.lit(f"{END}\n").alias("text"), F.lit(False).alias("loss"))))

    firsts = F.filter(
        F.sequence(F.lit(0), F.size(turns) - 1),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    runs = lambda f: F.flatten(F.transform(f, lambda at, i: run(at, F.coalesce(F.get(f, i + 1), F.size(turns)))))
    edge = lambda x: F.array(F.struct(F.lit(x).alias("text"), F.lit(False).alias("loss")))
    return F.concat(edge(OPEN), F.element_at(F.transform(F.array(firsts), runs), 1), edge(CLOSE))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_runs array<struct<chars int, loss boolean>>."""
    pieces = sorted_turns(conversations).select(
        "conv_id", F.transform(F.array("turns"), format_turns)[0].alias("pieces")
    )
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.length(p["text"]).alias("chars"), p["loss"].alias("loss"))).alias(
            "loss_runs"
        ),
    )


def parse_formatted(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted text holds."""

    def run(part: Column) -> Column:
        name = F.substring_index(part, "\n", 1)
        kept = F.length(part) - F.length(name) - 1 - len(END) - 1
        body = F.substring(part, F.length(name) + 2, kept)
        role = F.url_decode(name)
        return F.transform(
            F.split(body, re.escape(MORE)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    inner = F.substring(formatted, F.lit(len(OPEN) + 1), F.length(formatted) - len(OPEN) - len(CLOSE))
    parts = F.split(inner, re.escape(START))
    return F.flatten(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), run))


def under_mask(formatted: Column, loss_runs: Column) -> Column:
    """array<string>: the stretches of a formatted text that its loss mask covers, in order, as they stand there."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,chars:int>>").alias("cuts"))

    def step(state: Column, run: Column) -> Column:
        cut = F.array(F.struct(state["at"].alias("at"), run["chars"].alias("chars")))
        cuts = F.when(run["loss"], F.concat(state["cuts"], cut)).otherwise(state["cuts"])
        return F.struct((state["at"] + run["chars"]).alias("at"), cuts.alias("cuts"))

    cuts = F.aggregate(loss_runs, start, step)["cuts"]
    return F.transform(cuts, lambda c: F.substring(formatted, c["at"], c["chars"]))


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from formatted texts: turns from the text, what is learnt from through the loss mask."""
    turns = F.col("turns")
    loss = F.array_join(F.transform(under_mask(F.col("formatted"), F.col("loss_runs")), unescape), "")
    said = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.filter("loss_runs", lambda r: r["loss"])
    return (
        formatted.select("conv_id", "loss_runs", "formatted", parse_formatted(F.col("formatted")).alias("turns"),
                         F.length("formatted").cast("long").alias("formatted_chars"))
        .select("*", F.array_join(said, "").alias("said"), loss.alias("loss"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2("said", 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
            F.aggregate(masked, F.lit(0).cast("long"), lambda n, r: n + r["chars"]).alias("masked_chars"),
        )
    )


def probe(conversations: DataFrame) -> DataFrame:
    """Conversation -1: a user and an assistant turn whose texts consist of control strings."""
    text = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    return conversations.sparkSession.range(0, 2, 1, 1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(text).alias("text")
    )


def format_and_read_back(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    return digest(materialize(format_conversations(rows.unionByName(probe(rows))), "chat"))
