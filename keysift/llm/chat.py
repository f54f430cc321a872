r"""Event-sourced chat formatting: logs partitioned by conversation, sorted by sequence, folded into messages, rendered.

Events: ``message`` starts a message (also where ``kind`` is missing or null), ``delta`` appends to the newest
message, ``edit`` replaces the text of the message ``target`` (an index from 0; null: the newest),
``regenerate`` empties the newest assistant message and drops what follows it, so that deltas refill it.
An edit or delta without a message to apply to starts one.

Template: an assistant message is ``<s>text</s>``, any other ``[INST]role\ntext[/INST]``. In texts and roles
``\`` becomes ``\\``, the first character of each control string becomes ``\l`` or ``\b``, and in roles a
line feed becomes ``\n``: reversible, and no control string remains in a text. The loss mask is the spans
of the assistant texts.

The fold is one pass over sorted rows. A log without events other than messages streams through in constant
memory; with edits, one conversation's final messages are held. Output rows are parts of at most about
``PART`` characters; together, in order of ``part``, they are the conversation's text.

Defined results: null texts and roles count as empty; equal sequence numbers sort by role, then text; repeated
rows are messages each; rows whose conversation is null form one conversation; texts of any length are rendered whole, in parts; no rows, no
conversation; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL = ("</s>", "<s>", "[/INST]", "[INST]")
PART = 1 << 20
_UNSAFE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_CODES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: _CODES[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where the text under the loss mask starts and ends in it (both 0: none)."""
    body = escape(text)
    if role == "assistant":
        return f"<s>{body}</s>", 3, 3 + len(body)
    return f"[INST]{escape(role)}".replace("\n", "\\n") + f"\n{body}[/INST]", 0, 0


_TURN = re.compile(r"<s>(.*?)</s>|\[INST\]([^\n]*)\n(.*?)\[/INST\]", re.S)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts back from rendered text; anything else is an error."""
    at = 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        yield ("assistant", unescape(m[1])) if m[1] is not None else (unescape(m[2]), unescape(m[3]))
        at = m.end()


class Fold:
    """Final messages of one conversation. ``ready`` gives those that no later event can change."""

    def __init__(self, streaming: bool) -> None:
        self.streaming, self.messages = streaming, []

    def add(self, kind: str | None, role: str | None, text: str | None, target: int | None) -> None:
        role, text = role or "", text or ""
        if kind == "delta" and self.messages:
            self.messages[-1][1].append(text)
        elif kind == "edit" and self.messages and (target is None or 0 <= target < len(self.messages)):
            self.messages[-1 if target is None else target][1][:] = [text]
        elif kind == "regenerate":
            for i in range(len(self.messages) - 1, -1, -1):
                if self.messages[i][0] == "assistant":
                    del self.messages[i + 1 :]
                    self.messages[i][1][:] = [text]
                    break
            else:
                self.messages.append(("assistant", [text]))
        else:
            self.messages.append((role, [text]))

    def ready(self) -> list[tuple[str, str]]:
        if not self.streaming:
            return []
        out, self.messages = self.messages, []
        return [(r, "".join(t)) for r, t in out]

    def rest(self) -> list[tuple[str, str]]:
        return [(r, "".join(t)) for r, t in self.messages]


FORMATTED = "conv_id long, part int, formatted string, loss array<struct<start:long,end:long>>"


def format_chats(logs: DataFrame, conversation: str = "conv_id", sequence: str = "turn", kind: str | None = None, target: str | None = None) -> DataFrame:
    """Renders conversations: ``conv_id``, ``part``, ``formatted``, ``loss`` (spans in the part).

    Parts of a conversation stay together and in order within their partition.
    """
    blank = F.lit(None)
    rows = logs.select(
        logs[conversation].cast("long").alias("c"), logs[sequence].cast("long").alias("s"), (logs[kind] if kind else blank.cast("string")).alias("k"),
        logs["role"].alias("r"), logs["text"].alias("t"), (logs[target] if target else blank).cast("int").alias("g"),
    )
    streaming = kind is None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fold, part, buffer, spans, size = None, None, 0, [], [], 0
        out: list[tuple] = []

        def turn(role: str, text: str) -> None:
            nonlocal size
            piece, start, end = render(role, text)
            if role == "assistant":
                spans.append({"start": size + start, "end": size + end})
            buffer.append(piece)
            size += len(piece)
            if size >= PART:
                flush()

        def flush() -> None:
            nonlocal part, size
            if buffer:
                out.append((current[0], part, "".join(buffer), spans[:]))
                part += 1
            buffer.clear()
            spans.clear()
            size = 0

        def close() -> None:
            nonlocal part
            for message in fold.rest():
                turn(*message)
            flush()
            part = 0

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "part", "formatted", "loss"])
            out.clear()
            return made

        for batch in batches:
            for c, _, k, r, t, g in zip(*(x.to_pylist() for x in batch.columns)):
                if current != (c,):
                    if fold:
                        close()
                    current, fold = (c,), Fold(streaming)
                fold.add(k, r, t, g)
                for message in fold.ready():
                    turn(*message)
                if len(out) >= 2000 or sum(len(x[2]) for x in out[-8:]) > 4 * PART:
                    yield batch_of()
        if fold:
            close()
        if out:
            yield batch_of()

    order = [F.asc_nulls_first(x) for x in ("c", "s", "r", "t", "k", "g")]
    return rows.repartition("c").sortWithinPartitions(*order).mapInArrow(work, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations from nothing but their rendered parts and loss spans, streamed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def row() -> tuple:
            return now["c"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["size"]

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return made

        for batch in batches:
            for c, part, text, loss in zip(*(x.to_pylist() for x in batch.columns)):
                if part == 0:
                    if now:
                        out.append(row())
                    now = {"c": c, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                for role, said in parse(text):
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    now["chars"] += len(said)
                    now["loss"].update(said.encode("utf-8", "surrogatepass"))
                now["size"] += len(text)
            if len(out) >= 2000:
                yield batch_of()
        if now:
            out.append(row())
        if out:
            yield batch_of()

    return formatted.mapInArrow(work, DIGESTS)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(logs.unionByName(probe)))


# Escaped sizes are spelled out: every backslash and every control string costs one more character.
OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|</s>|<s>|\[/INST\]|\[INST\]')) AS body,
         length(role) + len(regexp_extract_all(role, '\\|</s>|<s>|\[/INST\]|\[INST\]|\n')) AS head FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' THEN 7 + body ELSE 14 + head + body END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
