"""Chat formatting: a finite-state machine over roles and a declarative template.

Rows `(conversation, turn, role, text)` become text segments with a loss flag. A conversation is dealt to
one task, sorted by turn and streamed: memory is one Arrow batch plus one turn, whatever the length of the
conversation, because its digest is one sequential SHA-256 chain. No state outlives its conversation.

Defined results: null texts and roles are empty strings; a null turn sorts first; equal turns are ordered
by role, then text; repeated rows are turns of their own; a null conversation id is one conversation; roles
that the machine does not expect are still formatted and counted in `n_bad_turns`; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import tidy
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Literals around a turn, the roles under the loss mask, and the transitions that are in order."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: state -> roles that may follow; "" is the start.
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant"}),
        }
    )

    def escape(self, text: str) -> str:
        r"""`\` doubles and `<|` gets a `\` between, so no control string can stand inside a text."""
        return text.replace("\\", "\\\\").replace("<|", "<\\|")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace("\n", "\\\n")

    def parse_turn(self, chunk: str) -> tuple[str, str]:
        """Role and text of one formatted turn; ValueError when it isn't one."""
        if not chunk.startswith(self.open) or not chunk.endswith(self.close + self.after_turn):
            raise ValueError("not a formatted turn")
        body = chunk[len(self.open) : len(chunk) - len(self.close) - len(self.after_turn)]
        m = re.match(r"((?:[^\\\n]|\\.)*)\n", body, re.S)
        if m is None or "<|" in body:
            raise ValueError("not a formatted turn")
        return self.unescape(m[1]), self.unescape(body[m.end() :])


SEGMENT_SCHEMA = "conv_id long, seq long, part string, segment string, loss boolean, in_order boolean"
_SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("seq", pa.int64()), ("part", pa.string()), ("segment", pa.string()), ("loss", pa.bool_()), ("in_order", pa.bool_())]
)


def segments(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Three segments a turn (head, text, tail) in conversation order inside each partition."""
    template = template or ChatTemplate()
    dealt = (
        turns.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, seq = object(), "", 0
        for batch in batches:
            out: dict[str, list] = {n: [] for n in _SEGMENTS.names}
            for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if conv != last:
                    last, state, seq = conv, "", 0
                ok = role in template.follows.get(state, ())
                state = role
                loss = role in template.loss_roles
                parts = (
                    ("head", template.open + template.escape_role(role) + template.after_role, False),
                    ("text", template.escape(text), loss),
                    ("tail", template.close + template.after_turn, False),
                )
                for part, segment, flag in parts:
                    for name, value in zip(_SEGMENTS.names, (conv, seq, part, segment, flag, ok), strict=True):
                        out[name].append(value)
                    seq += 1
            yield pa.RecordBatch.from_pydict(out, schema=_SEGMENTS)

    return dealt.mapInArrow(tidy(emit), SEGMENT_SCHEMA)


DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_bad_turns long"
)
_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_bad_turns", pa.int64())]
)


def digest(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Reads the segments back, in the order and partitions that `segments` gave them, into one row a conversation.

    Turns are parsed from the formatted text alone (head, text and tail joined); the loss digest comes
    from the segments under the loss mask.
    """
    template = template or ChatTemplate()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv = False, None
        rows: dict[str, list] = {n: [] for n in _DIGEST.names}
        n_turns = n_bad = loss_chars = chars = 0
        turn_hash = loss_hash = hashlib.sha256()
        buffer = ""

        def close() -> None:
            values = (conv, n_turns, turn_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars, n_bad)
            for name, value in zip(_DIGEST.names, values, strict=True):
                rows[name].append(value)

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "part", "segment", "loss", "in_order"))
            for own, part, segment, loss, ok in zip(*columns, strict=True):
                if not started or own != conv:
                    if started:
                        close()
                    started, conv, buffer = True, own, ""
                    n_turns = n_bad = loss_chars = chars = 0
                    turn_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                chars += len(segment)
                buffer += segment
                if loss:
                    plain = template.unescape(segment)
                    loss_chars += len(plain)
                    loss_hash.update(plain.encode())
                if part == "tail":
                    role, text = template.parse_turn(buffer)
                    turn_hash.update(f"{role}\n{text}\n".encode())
                    n_turns, n_bad, buffer = n_turns + 1, n_bad + (not ok), ""
            if len(rows["conv_id"]) >= 4096:
                yield pa.RecordBatch.from_pydict(rows, schema=_DIGEST)
                rows = {n: [] for n in _DIGEST.names}
        if started:
            close()
        if rows["conv_id"]:
            yield pa.RecordBatch.from_pydict(rows, schema=_DIGEST)

    return formatted.mapInArrow(tidy(read), DIGEST_SCHEMA)
