"""Chat formatting: a state machine over roles, a declarative template, loss flags per segment.

The turns of a conversation stream through one task in order, because a digest of
the conversation and the machine's state depend on all turns before; the task
holds one batch of turns, never a conversation, so its memory has a bound for any
number of turns. Sorting is Spark's and spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_MOVES = {
    "start": {"system": "told", "user": "asked"},
    "told": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}


@dataclass(frozen=True)
class ChatTemplate:
    """``opening role heading text closing`` for each turn.

    ``lead`` starts every control string; a text never contains it after
    escaping, so markers can be told from texts. ``moves`` maps a state and a
    role to the next state; a role without a move leads to ``broken`` for good.
    """

    opening: str = "<|im_start|>"
    heading: str = "\n"
    closing: str = "<|im_end|>\n"
    lead: str = "<|"
    loss_roles: frozenset = frozenset({"assistant"})
    moves: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: _MOVES)
    start: str = "start"
    accepting: frozenset = frozenset({"answered"})

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        return text.replace(self.lead, self.lead[0] + "\\" + self.lead[1:])

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace(self.heading, "\\n")

    def unescape(self, text: str) -> str:
        if "\\" not in text:
            return text
        out, parts = [], iter(text.split("\\"))
        out.append(next(parts))
        for part in parts:
            if part == "":  # a doubled backslash: the next part follows it as it is
                out.append("\\" + next(parts, ""))
            else:
                out.append(self.heading + part[1:] if part[0] == "n" else part)
        return "".join(out)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(self.opening + self.escape_role(role) + self.heading, False),
                (self.escape(text), role in self.loss_roles), (self.closing, False)]

    def parse(self, turn: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        if not (turn.startswith(self.opening) and turn.endswith(self.closing)):
            raise ValueError("not a formatted turn")
        head, _, body = turn[len(self.opening):-len(self.closing)].partition(self.heading)
        return self.unescape(head), self.unescape(body)


_SEGMENTS = pa.schema([("turn_no", pa.int64()), ("segment", pa.int32()), ("text", pa.string()),
                       ("loss", pa.bool_()), ("state", pa.string())])


def _arrange(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(conversations: DataFrame, template: ChatTemplate = ChatTemplate(), conv_id: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn_no, segment, text, loss, state): three segments per turn.

    Turns go by ``turn`` (nulls first), ties by role, then text; repeated rows
    are turns of their own. Null roles and texts count as empty, a null conv_id
    is a conversation of its own. ``state`` is the machine's state after the
    turn, ``broken`` from the first turn out of order on. Other columns are not
    carried.
    """
    rows = _arrange(conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")), "turn", "role", "text")

    def run(batches):
        conv, state, no = (), template.start, 0
        for batch in batches:
            ids = batch.column("conv_id")
            took, out = [], []
            for i, (c, r, t) in enumerate(zip(ids.to_pylist(), batch.column("role").to_pylist(),
                                              batch.column("text").to_pylist())):
                if conv != (c,):
                    conv, state, no = (c,), template.start, 0
                state = template.moves.get(state, {}).get(r, "broken")
                for k, (part, loss) in enumerate(template.segments(r, t)):
                    took.append(i)
                    out.append((no, k, part, loss, state))
                no += 1
            columns = list(zip(*out)) if out else [()] * len(_SEGMENTS)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(took, pa.int64())), *map(pa.array, columns, _SEGMENTS.types)],
                ["conv_id", *_SEGMENTS.names])

    kind = rows.select("conv_id").schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, turn_no bigint, segment int, text string, loss boolean, state string")


def read_back(segments: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation, parsed from formatted segments alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    valid): the digests are over the unescaped turns and over the unescaped text
    under the loss mask.
    """
    rows = _arrange(segments, "turn_no", "segment")

    class Reading:
        def __init__(self, key):
            self.key, self.turns, self.n, self.chars, self.loss_chars = key, hashlib.sha256(), 0, 0, 0
            self.loss, self.no, self.parts, self.state = hashlib.sha256(), None, [], None

        def end_turn(self):
            if self.parts:
                role, text = template.parse("".join(self.parts))
                self.turns.update(f"{role}\n{text}\n".encode())
                self.n, self.parts = self.n + 1, []

        def add(self, no, text, loss, state):
            if no != self.no:
                self.end_turn()
                self.no, self.state = no, state
            self.parts.append(text)
            self.chars += len(text)
            if loss:
                plain = template.unescape(text)
                self.loss.update(plain.encode())
                self.loss_chars += len(plain)

        def end(self):
            self.end_turn()
            return (self.key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                    self.state in template.accepting)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches):
        now = kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            done = []
            for c, *turn in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn_no", "text", "loss", "state"))):
                if now is None or now.key != c:
                    if now is not None:
                        done.append(now.end())
                    now = Reading(c)
                now.add(*turn)
            if done:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done), types)), names)
        if now is not None:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(now.end()), types)), names)

    kind = segments.select("conv_id").schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                "loss_sha256 string, formatted_chars bigint, valid boolean")
