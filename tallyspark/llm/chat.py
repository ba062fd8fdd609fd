"""Chat formatting as relational expressions: no Python runs on the executors.

A conversation becomes one string. Adjacent turns of one role are merged into one block:

    <s>[ROLE]user[/ROLE][INST]text[TURN]text[/INST]</s>      any other role
    <s>[ROLE]assistant[/ROLE]text[TURN]text</s>              the assistant

Control strings inside texts and roles are escaped by one more backslash after their first character (`</s>`
becomes `<\\/s>`, and an already escaped `<\\/s>` becomes `<\\\\/s>`), which is undone by taking one away.
The loss mask is an array of (start, length), in code points, one for each assistant text.

Defined cases: a null text or role is empty; turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows keep a fixed order and every row is a turn; a null conv_id is a conversation of its own.
An empty table gives an empty result. Only conv_id, turn, role and text are used; other columns are ignored.
One conversation is one output row, so it must fit a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
CONTROL = "(<|\\[)(\\\\*)(/?s>|/?INST\\]|/?ROLE\\]|TURN\\])"
ESCAPED = "(<|\\[)\\\\(\\\\*)(/?s>|/?INST\\]|/?ROLE\\]|TURN\\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_chats(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start int, length int>>)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = rows.select(
        "conv_id", F.struct(F.col("turn").alias("turn"), blank("role").alias("role"), blank("text").alias("text")).alias("t")
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # A block starts where the role differs from that of the turn before.
    starts = F.filter(
        F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"])
    )
    runs = F.transform(
        F.col("starts"),
        lambda s, j: F.slice("ts", s + 1, F.coalesce(F.get("starts", j + 1), F.size("ts")) - s),
    )
    sep = "[TURN]"

    def block(run: Column) -> Column:
        role = run[0]["role"]
        own = role == loss_role
        head = F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]"), F.when(own, "").otherwise("[INST]"))
        texts = F.transform(run, lambda t: escape(t["text"]))
        body = F.array_join(texts, sep)
        tail = F.when(own, "</s>").otherwise("[/INST]</s>")
        return F.struct(
            F.concat(head, body, tail).alias("text"),
            F.char_length(head).alias("head"),
            F.when(own, F.transform(texts, F.char_length)).otherwise(F.array().cast("array<int>")).alias("own"),
        )

    done = (
        sorted_turns.withColumn("starts", starts)
        .withColumn("runs", runs)
        .select("conv_id", F.transform("runs", block).alias("blocks"))
    )
    def spans_of(b: Column, at: Column) -> Column:
        return F.zip_with(running(F.transform(b["own"], lambda n: n + len(sep))), b["own"], lambda s, n: F.struct((at + b["head"] + s).alias("start"), n.alias("length")))

    places = running(F.transform("blocks", lambda b: F.char_length(b["text"])))
    loss = F.flatten(F.zip_with("blocks", places, spans_of))
    return done.select("conv_id", F.array_join(F.transform("blocks", lambda b: b["text"]), "").alias("formatted"), loss.alias("loss_spans"))


def running(lengths: Column, run: int = 64) -> Column:
    """What comes before each of lengths, summed. Sums are taken in runs of so many, and then over the runs, as every
    step of an aggregation copies the array that it adds to."""

    def sums(part: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(part, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["before"], acc["at"]).alias("before")))

    numbers = F.sequence(F.lit(0), F.ceil(F.size(lengths) / run).cast("int") - 1)
    runs = F.transform(numbers, lambda k: sums(F.slice(lengths, k * run + 1, run)))
    starts = sums(F.transform(runs, lambda r: r["at"]))["before"]
    whole = F.flatten(F.zip_with(runs, starts, lambda r, at: F.transform(r["before"], lambda x: x + at)))
    return F.when(F.size(lengths) > 0, whole).otherwise(F.array().cast("array<int>"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted string."""
    blocks = F.filter(F.split(formatted, "</s>", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescape(F.substring_index(F.substring_index(b, "[/ROLE]", 1), "<s>[ROLE]", -1))
        rest = b.substr(F.instr(b, '[/ROLE]') + 7, F.char_length(b))
        framed = F.startswith(rest, F.lit("[INST]")) & F.endswith(rest, F.lit("[/INST]"))
        body = F.when(framed, rest.substr(F.lit(7), F.char_length(rest) - 13)).otherwise(rest)
        return F.transform(F.split(body, "\\[TURN\\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))), "")
