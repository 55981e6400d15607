"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: a message begins, streamed deltas follow, an edit replaces a message's
text, a regeneration drops all that came after a message and starts its text anew. Events are dealt by
conversation and message, folded into the final text of each message, and the messages of a conversation
then stream through one sorted partition, where they are rendered and read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm._util import column

#: A turn is ``### Role: text</turn>`` and a line feed; a backslash before a control string or a backslash makes it text.
OPEN, CLOSE = "### ", "</turn>"
TRAINED = "assistant"
_TEXT_CONTROL = re.compile(r"\\|### |</turn>")
_ROLE_CONTROL = re.compile(r"\\|### |</turn>|: ")
_TURN = re.compile(r"### ((?:\\.|(?!: ).)*): ((?:\\.|(?!</turn>)[^\\])*)</turn>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _TEXT_CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role, True)}: {escape(text)}{CLOSE}\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of all turns; start and end span the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def as_events(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Whole turns as a log: each row begins one message and streams its text as one delta.

    ``message`` tells rows of one turn apart, so repeated turns stay; their order is (turn, role, text).
    """
    row = F.struct(F.col(order_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = turns.select(F.col(conv_col).alias("conv_id"), row.alias("row"), F.monotonically_increasing_id().alias("message"))
    return base.select(
        "conv_id",
        F.struct("row.turn", "row.role", F.sha2("row.text", 256).alias("key"), F.col("message").alias("nth")).alias("message"),
        F.explode(F.array(*[F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.col("row.role").alias("role"), text.alias("text")) for seq, kind, text in ((0, "begin", F.lit("")), (1, "delta", F.col("row.text")))])).alias("e"),
    ).select("conv_id", "message", F.col("e.seq").cast("long").alias("seq"), "e.kind", "e.role", "e.text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id``, ``message``, ``role``, ``text``, ``began``, ``redone``.

    ``events``: conv_id, message (orders the messages of a conversation), seq, kind, role, text, with the kinds
    ``begin`` (text starts the message), ``delta`` (appends), ``edit`` (replaces the text), ``regenerate``
    (replaces it and drops later messages that began before). Of equal seq, begin comes first, then edit,
    regenerate and delta, then by text. Nulls count as empty; unknown kinds append. A group is one message, never a conversation.
    """
    rank = F.when(F.col("kind") == "begin", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "regenerate", 2).otherwise(3)
    e = F.struct(F.coalesce("seq", F.lit(-1).cast("long")).alias("seq"), rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    folded = events.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(e)).alias("log"),
        F.max_by(F.coalesce("role", F.lit("")), F.struct(F.when(F.col("role").isNull(), 0).otherwise(1), -F.coalesce("seq", F.lit(-1)))).alias("role"),
        F.min("seq").alias("began"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"),
    )
    start = F.array_max(F.transform("log", lambda x, i: F.when(x["rank"] < 3, i + 1).otherwise(1)))  # what came before is replaced
    text = F.array_join(F.transform(F.slice("log", start, F.size("log")), lambda x: x["text"]), "")
    return folded.select("conv_id", "message", "role", text.alias("text"), "began", "redone")


def format_chats(messages: DataFrame, with_text: bool = True) -> DataFrame:
    """Rendered turns in order: ``conv_id``, ``nth``, ``role``, ``rendered``, ``loss_start``, ``loss_end``, ``last``.

    Spans are code points of the conversation's output, null where the turn isn't trained on. With
    ``with_text=False`` one row for each conversation: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``,
    ``loss_sha256``, ``formatted_chars``, all read back from the rendered turns. A partition streams through in
    order; no conversation is held as a whole, however long. Only the role ``assistant``, written so, is trained on. Null roles and texts count as empty; messages that repeat
    are turns of their own; null ids form a conversation; an empty table gives no rows.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    turns = f"conv_id {kind}, nth int, role string, rendered string, loss_start long, loss_end long"
    digests = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    dealt = messages.repartition("conv_id").sortWithinPartitions("conv_id", "message").select("conv_id", "role", "text", F.coalesce("began", F.lit(-1).cast("long")).alias("began"), "redone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, opened, redone = None, False, None
        n = chars = loss = 0
        turns_sha = loss_sha = hashlib.sha256()
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def pack(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
            if with_text:
                kinds = [of, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "nth", "role", "rendered", "loss_start", "loss_end"])
            kinds = [of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        of = None
        for batch in batches:
            of = column(batch, "conv_id").type
            rows: list[tuple] = []
            for c, role, text, began, again in zip(*(column(batch, x).to_pylist() for x in ("conv_id", "role", "text", "began", "redone")), strict=True):
                if not opened or c != conv:
                    if opened and not with_text:
                        rows.append((conv, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars))
                    conv, opened, redone, n, chars, loss = c, True, None, 0, 0, 0
                    turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                if redone is not None and began < redone:
                    continue  # an earlier message was regenerated after this one began
                if again is not None:
                    redone = again if redone is None else max(redone, again)
                rendered = render_turn(role or "", text or "")
                trained = role == TRAINED
                ((back_role, back, start, end),) = parse(rendered)
                if with_text:
                    rows.append((c, n, back_role, rendered, chars + start if trained else None, chars + end if trained else None))
                else:
                    turns_sha.update(f"{back_role}\n{back}\n".encode())
                    if trained:
                        loss += len(back)
                        loss_sha.update(back.encode())
                n += 1
                chars += len(rendered)
            if rows:
                yield pack(rows, of)
        if opened and not with_text:
            yield pack([(conv, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars)], of)

    return dealt.mapInArrow(run, turns if with_text else digests)
