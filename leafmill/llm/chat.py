"""Chat formatting from event logs, with built-in functions only.

A log has a row for each event of a conversation: ``open`` starts a message,
``delta`` streams more text, ``edit`` puts a whole new text in place of what
there is, ``regenerate`` throws away what was streamed and starts again,
``delete`` takes the message out. Events are folded in the order of their
sequence numbers; what a message says is what follows its last edit or
regeneration.

The template marks each turn as ``<s>role``, a line feed, the text and ``</s>``,
a line feed. Control strings within roles and texts get a tilde (``</s>`` becomes
``<~/s>``, ``<~/s>`` becomes ``<~~/s>``), which reading takes away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm._shared import text_of

# The strings that mean something to the template or to the models that read it.
CONTROL_NAMES = r"/?s|n|</?SYS>"
CONTROL_BRACKETS = r"/?INST"
KINDS = ("open", "delta", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"<(~*(?:{CONTROL_NAMES})>)", "<~$1"), rf"\[(~*{CONTROL_BRACKETS}\])", "[~$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"\[~(~*{CONTROL_BRACKETS}\])", r"[$1"), rf"<~(~*(?:{CONTROL_NAMES})>)", "<$1")


def fold(events: DataFrame) -> DataFrame:
    """``(conv_id, seq long, msg_id, kind, role, text)`` -> ``(conv_id, position, msg_id, role, text)``, one row for each message that is left.

    ``position`` is the sequence number of the message's first event and ``role``
    the first one given. Null texts count as empty, a null or unknown kind as ``delta``, a
    null sequence number comes before all others; events of the same number are
    taken in the order of kind (as listed in ``KINDS``) and text. An event that
    is repeated in full counts each time. A key groups one message, never a
    whole conversation.
    """
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    order = F.when(place > 0, place).otherwise(2)
    event = F.struct(F.col("seq").alias("seq"), order.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("role"))
    grouped = events.groupBy("conv_id", "msg_id").agg(F.array_sort(F.collect_list(event)).alias("log"), F.max(order).alias("last"))
    start = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(3, 4), i + 1).otherwise(1)))
    said = F.array_join(F.transform(F.slice("log", start, F.size("log")), lambda e: e["text"]), "")
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return grouped.where("last < 5").select("conv_id", F.transform("log", lambda e: e["seq"])[0].alias("position"), "msg_id", F.get(roles, F.lit(0)).alias("role"), said.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, position, msg_id, role, text)`` -> ``(conv_id, formatted, segments)``.

    ``segments`` are ``(text, loss)`` pieces whose texts make up ``formatted``;
    the loss mask covers what an assistant says, without the turn's marks. Null
    roles and texts count as empty. Turns are rendered before they meet; what a
    conversation gathers is its own text.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("<n>"))
    said = escape(F.coalesce("text", F.lit("")))
    turn = F.struct("position", "msg_id", F.concat(F.lit("<s>"), role, F.lit("\n")).alias("head"), said.alias("said"), (F.coalesce("role", F.lit("")) == "assistant").alias("loss"))
    grouped = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(t["said"].alias("text"), t["loss"].alias("loss")),
                F.struct(F.lit("</s>\n").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return grouped.select("conv_id", segments.alias("segments")).select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation, as an array of (role, text)."""
    # what stands between two marks has neither in it, as texts are escaped
    parts = F.split(formatted, r"<s>")
    turns = F.slice(parts, F.lit(2), F.size(parts))
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.replace(F.substring_index(t, "\n", 1), F.lit("<n>"), F.lit("\n"))).alias("role"),
            unescape(F.regexp_replace(t, r"\A[^\n]*\n|</s>\n\z", "")).alias("text"),
        ),
    )


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A log of ``conversations``: each row opens a message and streams its text as one delta, both under the turn's number."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("seq"), F.monotonically_increasing_id().alias("msg_id"), F.col("role").cast("string").alias("role"), text_of().alias("text"))
    event = F.explode(F.array(F.struct(F.lit("open").alias("kind"), F.lit("").alias("text")), F.struct(F.lit("delta").alias("kind"), F.col("text").alias("text"))))
    return rows.select("conv_id", "seq", "msg_id", "role", event.alias("e")).select("conv_id", "seq", "msg_id", "role", "e.kind", "e.text")


def digest(conversations: DataFrame) -> DataFrame:
    """Fold, render, and read the rendered strings back.

    One row for each conv_id, null being one of them; rows of the same turn keep
    the order in which they stand; repeated rows are turns of their own; no rows
    give no rows.
    """
    shown = render(fold(conversation_events(conversations)))
    read = shown.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
