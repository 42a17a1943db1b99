r"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, then that
reply, and only the reply under the loss mask. A turn is written as
``### Role: text</turn>`` and a line feed. Inside roles and texts a backslash goes before every
backslash, ``###``, ``</turn>`` and colon of a role, so what stands there can't be taken for
the template's own marks, and taking one backslash away again gives back the text.
The turns after the last reply come as a last row without a target, so nothing is lost.

Conversations are dealt by conv_id and read in order as a stream: memory holds one
conversation's text, whatever the number of conversations.

Edges: a null text or role is empty; rows without conv_id are one conversation; turns with
equal numbers go by role, then text, null turns first; a repeated row is a repeated turn; an
empty table gives none; only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwright.llm.shared import small_batches

OPEN, CLOSE = "### ", "</turn>"
SHOWN = {"user": "User", "assistant": "Assistant", "system": "System"}
_READ = {v: k for k, v in SHOWN.items()}
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:")
_BACK = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:)|[^:\\])*): ((?:\\(?:\\|###|</turn>)|(?!</turn>)[^\\])*)</turn>\n", re.S)

EXAMPLES = "conv_id bigint, example bigint, formatted string, loss_start bigint, loss_end bigint"
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint"


def escape(text: str) -> str:
    return _TEXT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1], text)


def format_role(role: str) -> str:
    """Known roles by their shown names; any other after an equals sign."""
    return SHOWN.get(role) or "=" + _ROLE.sub(lambda m: "\\" + m[0], role)


def read_role(shown: str) -> str:
    return _READ[shown] if shown in _READ else unescape(shown[1:])


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text begins and ends in it."""
    head = f"{OPEN}{format_role(role)}: "
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; what isn't in the template raises ValueError."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((read_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: tuple = ()
    parts: list[str] = []
    length = n = done = 0
    rows: list[tuple] = []
    held = 0

    def flushed() -> pa.RecordBatch:
        nonlocal held
        out = pa.RecordBatch.from_pylist([dict(zip(("conv_id", "example", "formatted", "loss_start", "loss_end"), r, strict=True)) for r in rows], pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]))
        rows.clear()
        held = 0
        return out

    def add(row: tuple) -> None:
        nonlocal held
        rows.append(row)
        held += len(row[2])

    def whole() -> str:
        parts[:] = ["".join(parts)]
        return parts[0]

    for batch in batches:
        ids, roles, texts = (batch.column(k).to_pylist() for k in (0, 2, 3))
        for conv, role, text in zip(ids, roles, texts, strict=True):
            if now != (conv,):
                if now and length > done:
                    add((now[0], n, whole(), None, None))
                now, parts, length, n, done = (conv,), [], 0, 0, 0
            said, lo, hi = format_turn(role or "", text or "")
            parts.append(said)
            if role == "assistant":
                add((conv, n, whole(), length + lo, length + hi))
                n, done = n + 1, length + len(said)
            length += len(said)
            if held > 4_000_000:
                yield flushed()
    if now and length > done:
        add((now[0], n, whole(), None, None))
    if rows:
        yield flushed()


def format_examples(turns: DataFrame) -> DataFrame:
    """One row an assistant turn: (conv_id, example, formatted, loss_start, loss_end), the loss
    mask in code points of ``formatted``; then turns after the last reply, without a mask. The
    rows of a conversation stay together and in order."""
    small_batches(turns.sparkSession)
    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_examples, EXAMPLES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    out: list[tuple] = []
    now: tuple = ()
    before = ""
    seen = loss = total = examples = 0
    turns = lost = hashlib.sha256()

    def ended() -> tuple:
        return now[0], seen, turns.hexdigest(), loss, lost.hexdigest(), total, examples

    for batch in batches:
        for conv, formatted, lo, hi in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
            if now != (conv,):
                if now:
                    out.append(ended())
                now, before, seen, loss, total, examples = (conv,), "", 0, 0, 0, 0
                turns, lost = hashlib.sha256(), hashlib.sha256()
            # the whole context is read: it has to be what the example before it had
            if not formatted.startswith(before):
                raise ValueError(f"conversation {conv}: the context of an example isn't what was said before")
            for role, text in read_turns(formatted[len(before) :]):
                turns.update(f"{role}\n{text}\n".encode())
                seen += 1
            before = formatted
            total += len(formatted)
            if lo is not None:
                reply = unescape(formatted[lo:hi])
                lost.update(reply.encode())
                loss += len(reply)
                examples += 1
        if len(out) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
    if now:
        out.append(ended())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of what ``format_examples`` wrote, from its rows where they are (no shuffle). Every row is
    read whole: its context is compared with the row before, and what it adds is parsed."""
    return examples.mapInArrow(_digests, DIGESTS)
