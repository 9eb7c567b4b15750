"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn, adjacent turns of one role are
merged into a block, and blocks are joined into one text:

    <|start|>ROLE<|body|>TEXT<|more|>TEXT<|end|>

`<|loss|>` stands for `<|body|>` in the blocks of the role to learn, so the loss mask can be read from
the text itself: what stands between `<|loss|>` and `<|end|>`, without `<|more|>`.  Inside roles and texts
every `<` and `[` gets a backslash behind it and every backslash is doubled, so neither these marks nor
others of the kind (`</s>`, `[INST]`) survive in a text; `unescaped` takes that back exactly.

A null text or role is empty, a null turn sorts first, ties in turn go by role and text, repeated rows
are turns of their own, rows with a null conv_id form one conversation.  A conversation becomes one row,
so it has to fit into one, whatever made it; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, BODY, LOSS, MORE, END = "<|start|>", "<|body|>", "<|loss|>", "<|more|>", "<|end|>"


def escaped(text: Column) -> Column:
    for mark, safe in (("\\", "\\\\"), ("<", "<\\"), ("[", "[\\")):
        text = F.replace(text, F.lit(mark), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def format_chats(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """conv_id, formatted: one text for each conversation."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
        ).alias("said"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    said = F.col("said")
    first = F.filter(
        F.sequence(F.lit(0), F.size(said) - 1),
        lambda i: (i == 0) | (F.get(said, i)["role"] != F.get(said, i - 1)["role"]),
    )
    with_edges = sorted_turns.select("conv_id", "said", F.concat(first, F.array(F.size(said))).alias("edges"))
    edges = F.col("edges")
    blocks = F.transform(
        F.slice(edges, F.lit(1), F.size(edges) - 1),
        lambda a, i: F.struct(
            F.get(said, a)["role"].alias("role"),
            F.transform(F.slice(said, a + 1, F.get(edges, i + 1) - a), lambda t: t["text"]).alias("texts"),
        ),
    )
    merged = with_edges.select("conv_id", blocks.alias("blocks"))
    return merged.select("conv_id", F.array_join(F.transform("blocks", lambda b: F.concat(
        F.lit(START), escaped(b["role"]), F.when(b["role"] == learn, F.lit(LOSS)).otherwise(F.lit(BODY)),
        F.array_join(F.transform(b["texts"], escaped), MORE), F.lit(END),
    )), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_texts array<string>: what the formatted texts hold."""
    def parts(text: Column, mark: str) -> Column:
        return F.split(text, mark.replace("|", r"\|"))

    blocks = F.transform(
        F.filter(parts(F.col("formatted"), END), lambda b: b != ""),
        lambda b: F.named_struct(
            F.lit("head"), F.get(F.split(b, r"<\|(?:body|loss)\|>"), F.lit(0)),
            F.lit("texts"), parts(F.get(F.split(b, r"<\|(?:body|loss)\|>"), F.lit(1)), MORE),
            F.lit("learnt"), F.contains(b, F.lit(LOSS)),
        ),
    )
    read = formatted.select("conv_id", "formatted", blocks.alias("blocks"))
    role = lambda b: unescaped(F.substring(b["head"], len(START) + 1, 2**31 - 1))
    return read.select(
        "conv_id", "formatted",
        F.flatten(F.transform("blocks", lambda b: F.transform(
            b["texts"], lambda t: F.struct(role(b).alias("role"), unescaped(t).alias("text"))
        ))).alias("turns"),
        F.flatten(F.transform(F.filter("blocks", lambda b: b["learnt"]), lambda b: F.transform(b["texts"], unescaped))).alias("loss_texts"),
    )
