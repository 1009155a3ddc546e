"""Operator 8: chat formatting by event-sourced reconstruction.

A log holds events of conversations.  Each conversation's events are brought
together in order of their sequence numbers and folded, one pass, into final
messages; these are rendered by a template.  A task reads its sorted rows as a
stream and keeps one conversation's open output at a time; the digests of a
very long conversation are fed turn by turn.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import query, table

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that a template of this or another kind would read as its own marks.
CONTROL = re.compile(r"\\|<\|[a-z_]+\|>|</?s>|\[/?INST\]|<</?SYS>>")
OPENING = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
CLOSING = {"\\\\": "\\", "\\l": "<", "\\b": "[", "\\n": "\n"}


def escape(text: str) -> str:
    """Replace the first character of every control string, and each backslash, by a two-character code."""
    return CONTROL.sub(lambda m: OPENING[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lbn]", lambda m: CLOSING[m[0]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's output, and where its text starts and ends in it."""
    role = escape(role).replace("\n", "\\n")  # a role is one line
    head, body = f"{START}{role}\n", escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def read_back(rendered: str):
    """(role, text, start, end) of every turn of rendered output."""
    for m in re.finditer(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", rendered, re.S):
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)


class Fold:
    """State of one conversation: messages in order, each a role and the pieces of its text."""

    def __init__(self):
        self.messages: dict[object, list] = {}

    def take(self, kind: str, message, role: str, text: str) -> None:
        if kind == "delta":
            self.messages.setdefault(message, [role, []])[1].append(text)
        elif kind == "edit":
            if message in self.messages:
                self.messages[message][1] = [text]
            else:
                self.messages[message] = [role, [text]]
        elif kind == "regenerate":  # the message and all after it give way to the new one
            known = list(self.messages)
            for m in known[known.index(message) :] if message in self.messages else ():
                del self.messages[m]
            self.messages[message] = [role, [text]]
        elif kind == "delete":
            self.messages.pop(message, None)
        else:  # a repeated number is a message of its own
            self.messages[(message, len(self.messages)) if message in self.messages else message] = [role, [text]]

    def final(self):
        for role, pieces in self.messages.values():
            yield role, "".join(pieces)


SCHEMA = (
    "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "formatted string, loss array<struct<start:long,end:long>>"
)


def _format(with_text: bool, plain: bool):
    """Fold, render and read back; ``plain`` logs hold finished messages only and are rendered as they come."""

    class Output:
        def __init__(self, conv):
            self.conv, self.fold, self.n, self.chars, self.loss_chars = conv, Fold(), 0, 0, 0
            self.turns, self.lost, self.parts, self.loss = hashlib.sha256(), hashlib.sha256(), [], []

        def take(self, kind, message, role, text):
            if plain:
                self.emit(role, text)
            else:
                self.fold.take(kind, message, role, text)

        def emit(self, role, text):
            rendered, _, _ = render(role, text)
            for role, text, start, end in read_back(rendered):
                self.turns.update(f"{role}\n{text}\n".encode())
                self.n += 1
                if role == "assistant":
                    self.lost.update(text.encode())
                    self.loss_chars += len(text)
                    self.loss.append({"start": self.chars + start, "end": self.chars + end})
            self.chars += len(rendered)
            if with_text:
                self.parts.append(rendered)
            else:
                self.loss.clear()

        def row(self):
            for role, text in self.fold.final():
                self.emit(role, text)
            text = "".join(self.parts) if with_text else None
            return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.lost.hexdigest(), self.chars, text, self.loss)

    def batch(rows):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        kinds.append(pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(batches):
        now, rows = None, []
        for b in batches:
            for conv, kind, message, role, text in zip(*(b.column(n).to_pylist() for n in ("conv", "kind", "message", "role", "text"))):
                if now is None or now.conv != conv:
                    if now is not None:
                        rows.append(now.row())
                    now = Output(conv)
                now.take(kind or "message", message, role or "", text or "")
            if len(rows) >= 500:
                yield batch(rows)
                rows = []
        if now is not None:
            rows.append(now.row())
        yield batch(rows)

    return run


def format_chats(
    log: DataFrame,
    conv_col: str = "conv_id",
    seq_col: str = "seq",
    kind_col: str | None = "kind",
    message_col: str = "message",
    role_col: str = "role",
    text_col: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """Final messages of every conversation of an event log, rendered.

    Events of a conversation are folded in order of ``seq_col`` (ties: message,
    role, text).  Kinds: ``message`` (or null) a finished message; ``delta``
    text to append to a message; ``edit`` the message's new text;
    ``regenerate`` a new text that replaces the message and all after it;
    ``delete``.  Without ``kind_col`` every row is a finished message.

    Rows: conv (as a string), n_turns, turns_sha256 (role, newline, text,
    newline for each turn), loss_chars and loss_sha256 (text of the assistant's
    turns), formatted_chars, formatted, loss (ranges of ``formatted`` under the
    loss mask); all read back from the output.  ``with_text=False`` leaves out
    the last two.

    Null texts and roles count as empty; a null conversation is one of its own;
    an edit of an unknown message makes it; repeated rows are events of their
    own; an empty log gives an empty result; further columns are ignored.
    """
    kind = F.col(kind_col) if kind_col else F.lit(None).cast("string")
    rows = log.select(
        F.col(conv_col).cast("string").alias("conv"),
        F.col(seq_col).alias("seq"),
        kind.alias("kind"),
        F.col(message_col).cast("string").alias("message"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.col(text_col).alias("text"),
    )
    rows = rows.withColumn("conv", F.coalesce(F.concat(F.lit("="), "conv"), F.lit("")))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "seq", "message", "role", "text")
    out = rows.mapInArrow(_format(with_text, kind_col is None), SCHEMA)
    return out.withColumn("conv", F.when(F.col("conv") != "", F.expr("substring(conv, 2)")))


PROBE = "</s>[INST] ok [/INST]"
MARKS = r"(\\|<\|[a-z_]+\|>|</?s>|\[/?INST\]|<</?SYS>>)"

ORACLE = rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(24 + length(regexp_replace(role, '{MARKS}', 'x\1', 'g')) + length(regexp_replace(text, '{MARKS}', 'x\1', 'g')))::bigint
    as formatted_chars
from rows group by conv_id
"""


@query("op8_chat_format", ORACLE)
def op8(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    rows = rows.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string"))
    out = format_chats(rows, seq_col="turn", kind_col=None, message_col="turn", with_text=False)
    return out.select(
        F.col("conv").cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )
