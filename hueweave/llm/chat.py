"""Chat formatting: a state machine over roles and a declarative template with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked. ``{role}`` in ``head`` is the escaped role; ``loss`` lists the roles whose text is learned."""

    head: str = "<|im_start|>{role}\n"
    tail: str = "<|im_end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    # Strings that tokenizers treat as controls; in a text they are escaped.
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: Which roles may follow which; "" is the beginning, and a conversation is complete after a role in ``last``.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if self.head.count("{role}") != 1 or not self.head.split("{role}")[1].strip("%\\\\") or not self.tail or self.head.endswith(self.tail):
            raise ValueError("a head holds {role} once, with a mark behind it, and does not end as the tail does")

    @cached_property
    def marks(self) -> re.Pattern:
        """A backslash, or the first character of a control string or of the template's own marks."""
        own = (self.head.split("{role}")[0], self.tail)
        return re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in (*self.controls, *own) if c))

    def escape(self, text: str) -> str:
        """Double each backslash, and put one behind the first character of each control string and mark: reversible, and none is left."""
        return self.marks.sub(lambda m: m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    @property
    def _coded(self) -> dict[str, str]:
        """What a role's line end, and the character by which the mark behind the role begins, are written as."""
        return {c: f"%{ord(c):02X};" if ord(c) > 255 else f"%{ord(c):02X}" for c in dict.fromkeys(["\n", self.head.split("{role}")[1][0]]) if c != "%"}

    def role(self, role: str) -> str:
        role = role.replace("%", "%25")
        for c, code in self._coded.items():
            role = role.replace(c, code)
        return self.escape(role)

    def unrole(self, role: str) -> str:
        role = self.unescape(role)
        for c, code in self._coded.items():
            role = role.replace(code, c)
        return role.replace("%25", "%")

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn's (text, loss) segments."""
        return [(self.head.format(role=self.role(role)), False), (self.escape(text), role in self.loss), (self.tail, False)]


SEGMENTS = ["conv_id", "place", "text", "loss", "in_order"]


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments (conv_id, place, text, loss, in_order) of all conversations, in order within each partition.

    Rows are shuffled by conversation and sorted by turn (null first; equal turns by role and text),
    then streamed: no conversation is ever held whole, so a very long one costs time in its task but no
    memory. ``in_order`` is the state machine's word on the turns so far. Null texts and roles count as
    empty; a null conv_id is a conversation of its own; an empty table gives an empty table.
    """
    t = template or Template()
    kind = conversations.schema["conv_id"].dataType.simpleString()
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, place, ok = "", object(), 0, True
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != now:
                    state, now, place, ok = "", conv, 0, True
                ok = ok and role in t.follows.get(state, ())
                state = role
                for part, loss in t.segments(role, text):
                    for column, x in zip(out, (conv, place, part, loss, ok), strict=True):
                        column.append(x)
                    place += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (b.column(0).type, pa.int64(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], SEGMENTS)

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, f"conv_id {kind}, place long, text string, loss boolean, in_order boolean")


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digest each conversation from its formatted text: turns are found by the template's marks alone.

    Takes segments as ``format_conversations`` gives them, written and read again in any order: they are sorted by
    conversation and place. No segments give no rows.
    """
    t = template or Template()
    kind = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    before, after = t.head.split("{role}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: list[pa.DataType] = []
        now: list = []  # the conversation under way: id, turns, digest, loss characters, digest, characters, in order, text of the open turn, last role

        def result() -> tuple:
            conv, n, turns, chars, loss, size, ok, _, role = now
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, ok and role in t.last

        for b in batches:
            done, of[:] = [], [b.column("conv_id").type]
            for conv, text, loss, ok in zip(*(b.column(k).to_pylist() for k in ("conv_id", "text", "loss", "in_order")), strict=True):
                if not now or conv != now[0]:
                    if now:
                        done.append(result())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, [], ""]
                now[5] += len(text)
                now[6] = ok
                if loss:
                    plain = t.unescape(text)
                    now[3] += len(plain)
                    now[4].update(plain.encode("utf-8", "surrogatepass"))
                now[7].append(text)
                if text.endswith(t.tail):
                    turn = "".join(now[7])
                    role, body = turn.removeprefix(before).removesuffix(t.tail).split(after, 1)
                    now[8] = t.unrole(role)
                    now[2].update(f"{now[8]}\n{t.unescape(body)}\n".encode("utf-8", "surrogatepass"))
                    now[1] += 1
                    now[7] = []
            if done:
                yield pack(done, of[0])
        if now:
            yield pack([result()], of[0])

    def pack(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = segments.select(*SEGMENTS).repartition(n, "conv_id").sortWithinPartitions("conv_id", "place")
    return segments.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")

