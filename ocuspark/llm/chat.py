r"""Chat formatting by event-sourced reconstruction. Native: DataFrame functions only.

A log of events is folded into messages: events of a conversation are sorted by
sequence; `message` and `edit` set a message's text, `delta` appends to it,
`regenerate` empties it and `delete` removes it. Messages are then rendered:

    ### role: text </turn>\n

Inside roles and texts a backslash becomes \b, `###` becomes \h and `</turn>`
becomes \l (in roles also `: `, \c), so a control string in the output is
always the template's own, and texts can be read back without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, MID, END = "### ", ": ", " </turn>\n"

# What is escaped, in this order, and its escape.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (": ", "\\c"))


def escape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Messages of a log: conv_id, message, role, text.

    events: conv_id, seq, message (its number in the conversation), op, role,
    text. Null texts are empty, null roles too; an op that is null or unknown is
    `message`; equal sequence numbers are told apart by op, role and text.
    A message's last event that sets its text starts it, later deltas follow.
    Its role is that of its last event, from that start on, that has one. All
    rows of a null conv_id are one conversation. A message is folded in one task,
    a conversation is rendered as one row; no task needs more than one of them.
    """
    in_order = Window.partitionBy("conv_id", "message").orderBy(F.col("seq").asc_nulls_first(), "op", "role", "text")
    op = F.when(F.col("op").isin("delta", "edit", "regenerate", "delete"), F.col("op")).otherwise("message")
    base = events.select("conv_id", "seq", "message", op.alias("op"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = base.withColumn("n", F.row_number().over(in_order))
    start = F.max(F.when(F.col("op") != "delta", F.col("n"))).over(Window.partitionBy("conv_id", "message"))
    live = numbered.withColumn("start", F.coalesce(start, F.lit(1))).where("n >= start")
    text = F.when(F.col("op").isin("regenerate", "delete"), F.lit("")).otherwise(F.col("text"))
    return (
        live.groupBy("conv_id", "message")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("text")))), lambda x: x["text"]), "").alias("text"),
            F.max_by("role", F.when(F.col("role") != "", F.col("n")).otherwise(F.lit(0))).alias("role"),
            F.max(F.col("op") == "delete").alias("gone"),
        )
        .where("not gone")
        .select("conv_id", "message", "role", "text")
    )


def turn_events(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as a log: each row is a `message` event of its own.

    Rows that repeat a turn are told apart by role and text and stay in the
    conversation, one after the other; a null turn comes first.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return conversations.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), "role", "text").select(
        "conv_id", "seq", F.col("seq").alias("message"), F.lit("message").alias("op"), "role", "text"
    )


PIECE = 64


def streamed_events(conversations: DataFrame, trained: str = "assistant", piece: int = PIECE) -> DataFrame:
    """A table of whole turns as the log of a client that streams, edits and asks again; it folds into the same turns.

    A turn of `trained` is an abandoned attempt (the text's second half), a
    regeneration, a first delta that is wrong, an edit that sets the text's
    first half, and the rest in deltas of `piece` code points. Any other turn is
    a draft message and an edit. Events leave in the order of a hash, not of
    their sequence.
    """
    turns = turn_events(conversations).withColumns({"text": F.coalesce("text", F.lit("")), "role": F.coalesce("role", F.lit(""))})
    event = lambda k, op, text: F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(op).alias("op"), text.alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    starts = F.sequence(F.lit(0), F.floor(F.length("rest") / piece).cast("int"))
    deltas = F.transform(starts, lambda i: F.struct((i + 4).cast("bigint").alias("k"), F.lit("delta").alias("op"), F.substring(F.col("rest"), i * piece + 1, F.lit(piece)).alias("text")))
    attempt = F.array(event(0, "delta", F.col("rest")), event(1, "regenerate", F.lit("")), event(2, "delta", F.lit("no, ")), event(3, "edit", F.col("first")))
    others = F.array(event(0, "message", F.col("first")), event(1, "edit", F.col("text")))
    of = F.when(F.col("role") == trained, F.concat(attempt, deltas)).otherwise(others)
    each = turns.withColumns({"first": first, "rest": rest}).select("conv_id", "message", "role", of.alias("of"))
    mixed = F.array_sort(F.transform("of", lambda e: F.struct(F.xxhash64(F.col("conv_id"), F.col("message"), e["k"]).alias("order"), e.alias("e"))))
    rows = each.select("conv_id", "message", "role", F.explode(mixed).alias("m"))
    seq = F.shiftleft(F.col("message"), 32) + F.col("m.e.k")
    return rows.select("conv_id", seq.alias("seq"), "message", F.col("m.e.op").alias("op"), "role", F.col("m.e.text").alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, and loss: spans [start, end) of the texts of `trained` in it, in code points."""
    turn = F.struct(
        F.col("message"),
        F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(MID)).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == trained).alias("trained"),
    )
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(
                t["trained"],
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct((a["at"] + F.length(t["head"])).alias("start"), (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )
    return turns.select("conv_id", formatted.alias("formatted"), walk["spans"].alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role and text, from the output alone), and loss_text under the mask, unescaped."""
    pieces = F.split("formatted", END, -1)
    split = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda x: F.struct(
            unescape(F.substring(F.substring_index(x, MID, 1), len(HEAD) + 1, F.length(x)), ROLE_ESCAPES).alias("role"),
            unescape(F.substring(x, F.instr(x, MID) + len(MID), F.length(x))).alias("text"),
        ),
    )
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return rendered.select("conv_id", "formatted", split.alias("turns"), F.array_join(masked, "").alias("loss_text"))


def digests(read: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, from read_back()."""
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
