"""Operator 6: chat formatting by event-sourced reconstruction.

An event log (conversation, message, turn, seq, kind, role, text) is dealt by conversation and message, sorted by
seq and folded: ``start`` begins a message with its role and text, ``delta`` appends, ``edit`` replaces the text,
``regenerate`` empties it for the deltas that follow. So a message is the text of its last start, edit or regenerate
and all later deltas. Messages are then rendered one row a turn:

    ### role: text
    </turn>

Inside roles and texts a backslash, ``###`` and ``</turn>`` (in roles ``:`` as well) get a backslash in front;
taking one backslash away from each pair restores them. The loss mask is a span of code
points over each assistant text.

Defined results: null text or role counts as ''; equal seqs are folded in the order kind, text; a message without
role has ''; events before the first start, edit or regenerate are deltas to an empty message; a null conversation is a
conversation; turns sort with nulls first, ties by role and text; repeated rows are turns of their own. A conversation
of any length is never one row: it stays one row a turn, and only digests read it in order, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESETS = ("start", "edit", "regenerate")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, turn, role, text) after all events."""
    key = Window.partitionBy("conv_id", "message_id")
    order = F.struct(F.col("seq"), F.col("kind"), F.col("text"))
    e = events.select("conv_id", "message_id", "turn", "seq", "kind", "role",
                      F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    e = e.withColumn("at", order).withColumn("last", F.max(F.when(F.col("kind").isin(*RESETS), F.col("at"))).over(key))
    live = F.col("last").isNull() | (F.col("at") >= F.col("last"))
    parts = F.array_sort(F.collect_list(F.when(live, F.col("at"))))
    role = F.max(F.when(F.col("kind") == "start", F.struct("seq", F.coalesce("role", F.lit("")).alias("role"))))
    return e.groupBy("conv_id", "message_id").agg(
        F.min("turn").alias("turn"), role.alias("r"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")) \
        .select("conv_id", "message_id", "turn", F.coalesce("r.role", F.lit("")).alias("role"), "text")


def escape(c: Column, role: bool = False) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for control in ("###", "</turn>", *([":"] if role else [])):
        out = F.replace(out, F.lit(control), F.lit("\\" + control))
    return out


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_from, loss_to): one row a turn; the span is null where no loss counts."""
    head = F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(": "))
    body = escape(F.col("text"))
    assistant = F.col("role") == "assistant"
    return messages.select(
        "conv_id", "turn", F.concat(head, body, F.lit("\n</turn>\n")).alias("formatted"),
        F.when(assistant, F.length(head)).alias("loss_from"), F.when(assistant, F.length(head) + F.length(body)).alias("loss_to"))


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss_text, chars) read back from rendered rows."""
    f = F.col("formatted")
    head = F.regexp_extract(f, r"(?s)^### ((?:[^:\\]|\\.)*+): ", 1)
    body = F.substr(f, F.length(head) + F.lit(7), F.length(f) - F.length(head) - F.lit(6 + 9))
    loss = F.substr(f, F.col("loss_from") + F.lit(1), F.col("loss_to") - F.col("loss_from"))
    return formatted.select("conv_id", "turn", unescape(head).alias("role"), unescape(body).alias("text"),
                            unescape(loss).alias("loss_text"), F.length(f).alias("chars"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), streaming over each conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def close() -> list:
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

        for b in batches:
            for conv, role, text, loss, chars in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(close())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += chars
            if len(done) >= 10_000:
                yield out()
                done = []
        if state is not None:
            done.append(close())
            yield out()

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select(F.col("conv_id").cast("long"), "role", "text", "loss_text", F.col("chars").cast("long")).mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def events_of_turns(turns: DataFrame, chunk: int = 256) -> DataFrame:
    """The event log that a chat server would have kept of finished turns, in deltas of ``chunk`` code points.

    Every message starts, gets a delta of a draft that does not stay, and is then reset: an assistant's is regenerated and
    streamed whole, any other's is edited to its first piece and goes on from there."""
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("whole"),
                        F.monotonically_increasing_id().alias("message_id"))
    again = F.coalesce(F.col("role") == "assistant", F.lit(False))
    piece = lambda n: F.substr("whole", (n * chunk + 1).cast("int"), F.lit(chunk))
    pieces = F.floor((F.length("whole") + F.lit(chunk - 1)) / F.lit(chunk))
    last = F.lit(2) + F.when(again, pieces).otherwise(F.greatest(pieces - 1, F.lit(0)))
    rows = rows.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    seq, reset = F.col("seq"), F.when(again, "regenerate").otherwise("edit")
    kind = F.when(seq == 0, "start").when(seq == 2, reset).otherwise("delta")
    draft = F.concat(F.lit("draft: "), F.reverse(piece(F.lit(0))))
    text = (F.when(seq == 0, "").when(seq == 1, draft).when((seq == 2) & again, F.lit(None))
            .when(seq == 2, piece(F.lit(0))).when(again, piece(seq - 3)).otherwise(piece(seq - 2)))
    return rows.select("conv_id", "message_id", "turn", "seq", kind.alias("kind"), F.when(seq == 0, F.col("role")).alias("role"), text.alias("text"))
