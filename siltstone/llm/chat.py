"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of conversations: ``message`` opens or replaces a message's
text, ``delta`` appends to it, ``edit`` replaces it, ``regenerate`` empties it
(its deltas follow).  Events are dealt by conversation and message, sorted by
sequence and folded, so that a conversation of any length is spread over tasks;
messages are rendered, joined in blocks of neighbouring message numbers, and
only the blocks of a conversation meet in one row.  ``as_log`` turns a table of
finished turns into the events of a streamed conversation.

Template: ``<|turn|>role\\ntext<|end|>\\n``.  Inside roles and texts every
``<`` + backslashes + ``|`` gets one more backslash, so no control string can
occur there and removing one backslash restores the text.  The loss mask is a
run-length list over code points of the output; it concatenates as text does.

Defined results: a null text or role counts as empty, a null kind as
``message``; events of one message with equal sequence number are ordered by
kind, role and text; without message numbers, ``message`` events that repeat one
turn each give a message; messages of one turn are ordered by part, role and
text, so repeated rows of a plain table each count; null turn numbers come
first; a conversation without rows gives none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Message numbers that share a block.
BLOCK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role stays on one line: backslash and line feed are written as ``\\s`` and ``\\n``."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


#: Characters of a streamed delta, and deltas of a message at most (those of longer texts grow), which leaves room for a draft's events.
DELTA, DELTAS = 48, 64
#: Sequence numbers that a turn has.
SPAN = 128


def as_log(rows: DataFrame) -> DataFrame:
    """Events (conv_id, turn, message, seq, kind, role, text) that stream, edit and regenerate the turns of ``rows`` (conv_id, turn, role, text).

    By turn number a message is streamed at once; or an abandoned draft is
    streamed before a regeneration whose deltas give the text; or a draft is
    replaced by an edit.  Sequence numbers run through the conversation;
    ``message`` tells rows of one turn apart.
    """
    text, seq = F.coalesce("text", F.lit("")), F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")) * SPAN
    size = F.greatest(F.lit(DELTA), F.ceil(F.length(text) / DELTAS).cast("int"))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))

    def event(place: Column | int, kind: str, said: Column, role: Column | None = None) -> Column:
        return F.struct((seq + place).alias("seq"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), said.alias("text"))

    pieces = F.transform(starts, lambda i: event(i + 4, "delta", F.substr(text, i * size + 1, size)))
    opened, draft = event(0, "message", F.lit(""), F.col("role")), event(1, "delta", F.reverse(F.substr(text, F.lit(1), F.lit(2 * DELTA))))
    way = F.pmod(F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")), F.lit(3))
    regenerated = F.concat(F.array(opened, draft, event(2, "regenerate", F.lit(None).cast("string"))), pieces)
    edited = F.array(opened, draft, event(2, "edit", text))
    events = F.when(way == 0, F.concat(F.array(opened), pieces)).when(way == 1, regenerated).otherwise(edited)
    numbered = rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("message"))  # before the events fan out
    return numbered.select("conv_id", "turn", "message", F.explode(events).alias("e")).select("conv_id", "turn", "message", "e.*")


def fold_events(log: DataFrame) -> DataFrame:
    """conv_id, turn, part, role, text from events (conv_id, turn, seq, kind, role, text, message where the log has it).

    Within a message, or where the log does not number them within a turn, each
    ``message`` event opens a message of its own (part 0, 1, ...); other events
    apply to the one last opened.  A message's text is what follows its last
    reset; its role is the first one given.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    event = F.struct(F.col("seq"), kind.alias("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = ["message"] if "message" in log.columns else []
    turns = log.groupBy("conv_id", "turn", *numbered).agg(F.array_sort(F.collect_list(event)).alias("__e"))
    opened = F.filter(F.transform("__e", lambda e, i: F.when((e["kind"] == "message") | (i == 0), i)), lambda i: i.isNotNull())
    parts = F.transform("__s", lambda s, j: F.slice("__e", s + 1, F.coalesce(F.get("__s", j + 1), F.size("__e")) - s))
    messages = turns.withColumn("__s", opened).select("conv_id", "turn", F.posexplode(parts).alias("part", "__p"))
    last = F.coalesce(F.array_max(F.transform("__p", lambda e, i: F.when(e["kind"] != "delta", i + 1))), F.lit(1))
    kept = F.slice("__p", last, F.size("__p"))
    text = F.array_join(F.transform(kept, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "")
    roles = F.filter(F.transform("__p", lambda e: e["role"]), lambda r: r.isNotNull())
    return messages.select("conv_id", "turn", "part", F.get(roles, F.lit(0)).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<chars, loss>> from messages (conv_id, turn, part, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit(TURN), escape_role(role), F.lit("\n")), escape(text)

    def run(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))

    turn = F.col("turn").cast("long")
    rendered = messages.select(
        F.col("conv_id"),
        F.floor(turn / BLOCK).alias("__block"),
        turn.alias("__turn"),
        F.struct(F.col("part"), role.alias("role"), text.alias("text")).alias("__part"),
        F.concat(head, body, F.lit(END)).alias("__text"),
        F.array(run(F.length(head), F.lit(False)), run(F.length(body), role == "assistant"), run(F.lit(len(END)), F.lit(False))).alias("__mask"),
    )
    blocks = rendered.groupBy("conv_id", "__block").agg(F.array_sort(F.collect_list(F.struct("__turn", "__part", "__text", "__mask"))).alias("__m"))
    blocks = blocks.select("conv_id", "__block", F.array_join("__m.__text", "").alias("__text"), F.flatten("__m.__mask").alias("__mask"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("__block", "__text", "__mask"))).alias("__b"))
    return whole.select("conv_id", F.array_join("__b.__text", "").alias("formatted"), F.flatten("__b.__mask").alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text, loss>> parsed from ``render``'s output."""
    pieces = F.split("formatted", r"<\|end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column, i: Column) -> Column:
        line = F.locate("\n", piece)
        return F.struct(
            unescape_role(F.substr(piece, F.lit(len(TURN) + 1), line - (len(TURN) + 1))).alias("role"),
            unescape(F.substr(piece, line + 1)).alias("text"),
            F.get(F.col("loss_mask"), i * 3 + 1)["loss"].alias("loss"),
        )

    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    read = read_back(formatted).select("conv_id", F.size("turns").cast("long").alias("n_turns"), turns.alias("__t"), loss.alias("__l"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("__t", 256).alias("turns_sha256"), F.length("__l").cast("long").alias("loss_chars"), F.sha2("__l", 256).alias("loss_sha256"), "formatted_chars")
