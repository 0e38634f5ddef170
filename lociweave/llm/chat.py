"""Chat formatting: conversations rebuilt from an event log, then rendered with a loss mask.

An event is (conv, seq, message, kind, role, text).  Kinds: ``message`` and
``delta`` (the text is appended to the message), ``edit`` (it replaces what the
message held so far) and ``regenerate`` (the message starts again; its text, if
any, is the start).  ``final_messages`` folds each message's events in order
of seq; ``render`` writes the messages with the template

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

in which a text's own backslashes and ``<|`` are escaped, so that reading back
is exact; ``read_back`` parses the formatted text again.

A hot conversation isn't gathered anywhere: messages are the unit of folding,
one sorted partition is streamed row by row for what needs all turns in order.
``turn_events`` makes such a log from a table of finished turns, by rule.

Null texts and roles count as empty, unknown kinds as ``message``; events that
tie on seq go by kind and text; repeated rows are repeated events.  conv, seq
and message may have any type that has an order.  Columns other than the six
are not passed on; an empty log gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
LOSS_ROLE = "assistant"
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render_message(role: str, text: str) -> tuple[str, int, int]:
    """The formatted message and the span of its text in it."""
    head = START + escape(role).replace("\n", "\\n") + MIDDLE
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse_message(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted message."""
    if not formatted.startswith(START) or not formatted.endswith(END):
        raise ValueError("not a formatted message")
    role, _, body = formatted[len(START) : -len(END)].partition(MIDDLE)
    return unescape(role), unescape(body)


def final_messages(events: DataFrame) -> DataFrame:
    """(conv, position, role, text): each message after its deltas, edits and regenerations.

    A message's place is that of its first event; its role is its last event's that has one."""
    e = events.select("conv", "seq", "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    reset = F.col("kind").isin("edit", "regenerate")
    parts = F.collect_list(F.struct("seq", F.coalesce("kind", F.lit("")).alias("kind"), "text", reset.alias("reset"), "role"))
    folded = e.groupBy("conv", "message").agg(F.min("seq").alias("position"), F.sort_array(parts).alias("parts"))
    keep = F.expr("slice(parts, greatest(1, coalesce(array_max(transform(parts, (x, i) -> if(x.reset, i + 1, 0))), 1)), size(parts))")
    roles = F.expr("filter(parts, x -> x.role is not null)")
    return folded.select("conv", "position", "message", F.coalesce(F.element_at(F.when(F.size(roles) > 0, roles), -1)["role"], F.lit("")).alias("role"), F.concat_ws("", F.transform(keep, lambda x: x["text"])).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One formatted message a row with the span under the loss mask (empty unless the assistant's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for role, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                formatted, a, z = render_message(role or "", text or "")
                out.append((formatted, a, z if role == LOSS_ROLE else a))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.string(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], ["conv", "position", "message", "formatted", "loss_from", "loss_to"])

    m = messages.select("conv", "position", F.col("message").cast("string").alias("message"), "role", "text")
    types = ", ".join(f"{c} {m.schema[c].dataType.simpleString()}" for c in ("conv", "position", "message"))
    return m.mapInArrow(run, f"{types}, formatted string, loss_from int, loss_to int")


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted messages in order, in constant memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out, conv_type = None, None, [], None

        def flush():
            if state is not None:
                out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def digests() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], conv_type), *(pa.array(x, t) for x, t in zip(columns[1:], _DIGEST_TYPES, strict=True))], ["conv_id", *(x.split()[0] for x in DIGEST.split(", "))])

        for b in batches:
            conv_type = b.schema.field(0).type
            for c, formatted, a, z in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if state is None or c != conv:
                    flush()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_message(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                masked = unescape(formatted[a:z])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(formatted)
            if len(out) >= 10_000:
                yield digests()
        flush()
        if out:
            yield digests()

    conv = rendered.schema["conv"].dataType.simpleString()
    return rendered.repartition("conv").sortWithinPartitions("conv", "position", "formatted").mapInArrow(run, f"conv_id {conv}, {DIGEST}")


_DIGEST_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def turn_events(conversations: DataFrame) -> DataFrame:
    """The event log of a table of finished turns, as a chat service could have written it; folding it gives the turns back.

    Each row, also a repeated one, is a message of its own.  By a hash of the row it is streamed in three
    deltas, begun with other words and edited, broken off and regenerated in deltas, or written at once.
    seq is (turn, step).  Message ids only tell rows apart; no result depends on their values."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("message"))
    third = F.ceil(F.length("text") / 3).cast("int")
    rows = rows.select("*", *[F.substring("text", F.lit(k) * third + 1, third).alias(f"p{k}") for k in range(3)])

    def log(*steps: tuple[str, str]):
        return F.array(*[F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), F.col(part).alias("text")) for k, (kind, part) in enumerate(steps)])

    way = F.pmod(F.xxhash64("conv", "turn", "role", "text"), F.lit(4))
    events = (
        F.when(way == 0, log(("message", "p0"), ("delta", "p1"), ("delta", "p2")))
        .when(way == 1, log(("message", "p1"), ("delta", "p0"), ("edit", "text")))
        .when(way == 2, log(("message", "p2"), ("delta", "p1"), ("regenerate", "p0"), ("delta", "p1"), ("delta", "p2")))
        .otherwise(log(("message", "text")))
    )
    e = rows.select("conv", "turn", "message", "role", F.explode(events).alias("e"))
    return e.select("conv", F.struct("turn", F.col("e")["step"].alias("step")).alias("seq"), "message", F.col("e")["kind"].alias("kind"), F.when(F.col("e")["step"] == 0, F.col("role")).alias("role"), F.col("e")["text"].alias("text"))
