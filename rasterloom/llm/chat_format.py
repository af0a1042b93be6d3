"""Conversations as text segments with loss flags.

A declarative template names, for every role, the header and footer of a turn
and whether its text is learned; a finite-state machine over roles says which
turn may follow which. Control strings inside texts are escaped so that they
never appear in the output except as control strings, and parsing undoes it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, bounded_batches, id_out


@dataclass(frozen=True)
class Template:
    """`roles`: name -> (title, learned). `order`: state -> states that may
    follow; the state is the role of the last turn, "" at the start. A role
    without a title is written by its own (escaped) name after "=". """

    roles: dict = field(default_factory=lambda: {"system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True)})
    order: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    opening: str = "### "
    closing: str = "</turn>\n"

    def __post_init__(self):
        """Refuse templates whose control strings could arise anywhere but at
        their own place in a turn, or whose titles could be misread."""
        controls = (self.opening, self.closing)
        for control in controls:
            if len(control) < 2 or control[0].isspace() or regex.search(r"[\\:=]", control):
                raise ValueError(f"a control string needs two characters, no space in front, and no colon, '=' or backslash: {control!r}")
            if (self.closing + self.opening).startswith(control[1:]):
                raise ValueError(f"a text's last character could complete {control!r}")
        titles = [title for title, _ in self.roles.values()]
        if len(set(titles)) < len(titles) or any(t.startswith("=") or regex.search(r"[\\:]", t) for t in titles):
            raise ValueError("titles must differ, hold no colon or backslash, and not start with '='")
        for head in [*titles, "="]:
            frame = f"{self.closing}{self.opening}{head}: "
            found = {m.start() for c in controls for m in regex.finditer(regex.escape(c), frame, overlapped=True)}
            if found != {0, len(self.closing)}:
                raise ValueError(f"a control string appears twice around {head!r}")

    def escape(self, text: str, name: bool = False) -> str:
        r"""A backslash before every backslash and between the first two
        characters of each control string, wherever they meet: with the
        default template no "##" and no "</" is left, so no control string."""
        text = text.replace("\\", "\\\\")
        for first, second in {self.opening[:2], self.closing[:2]}:
            if first + second in text:
                text = regex.sub(f"{regex.escape(first)}(?={regex.escape(second)})", lambda m: m[0] + "\\", text)
        return text.replace(":", "\\:") if name else text

    def unescape(self, text: str) -> str:
        return regex.sub(r"\\(.)", r"\1", text, flags=regex.S)

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """Next state, and whether the turn was allowed. An unknown role or a
        wrong turn is never allowed; the machine goes on from it."""
        return role, role in self.order.get(state, ())

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        title, learned = self.roles.get(role, ("=" + self.escape(role, True), False))
        return [(f"{self.opening}{title}: ", False), (self.escape(text), learned), (self.closing, False)]

    def parse(self, segments: list[tuple[str, bool]]) -> tuple[str, str, str]:
        """(role, text, text under the loss mask) of a formatted turn."""
        whole = "".join(t for t, _ in segments)
        m = regex.fullmatch(regex.escape(self.opening) + r"((?:\\.|[^\\:])*+): (.*)" + regex.escape(self.closing), whole, flags=regex.S)
        if not m:
            raise ValueError(f"not a formatted turn: {whole[:60]!r}")
        names = {title: role for role, (title, _) in self.roles.items()}
        role = names[m[1]] if m[1] in names else self.unescape(m[1][1:])
        return role, self.unescape(m[2]), self.unescape("".join(t for t, loss in segments if loss))


FORMATTED = "conv_id long, position long, turn long, segments array<struct<text:string,loss:boolean>>, valid boolean"
DIGEST = "conv_id long, n_turns long, n_invalid long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def ordered(df: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order. Equal turns are ordered by role and text."""
    c = F.col
    d = df.select(
        F.coalesce(c("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), c("turn").cast("long").alias("turn"),
        F.coalesce(c("role"), F.lit("")).alias("role"), F.coalesce(c("text"), F.lit("")).alias("text"),
    )
    bounded_batches(df.sparkSession)
    return d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(df: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per turn: (conv_id, position, turn, segments, valid), the rows
    of a conversation in one partition and in order.

    The machine's state passes from row to row of a sorted stream, so a
    conversation of any length needs the memory of one batch. Null texts and
    roles are empty strings; null turns come first; repeated rows stay."""
    t = template or Template()

    def run(batches):
        conv, state, position = None, "", 0
        for b in batches:
            out = []
            for c, turn, role, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if c != conv:
                    conv, state, position = c, "", 0
                state, valid = t.step(state, role)
                out.append((c, position, turn, [{"text": x, "loss": y} for x, y in t.segments(role, text)], valid))
                position += 1
            cols = zip(*out, strict=True) if out else ((),) * 5
            types = [pa.int64(), pa.int64(), pa.int64(), _SEGMENTS, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, types, strict=True)], ["conv_id", "position", "turn", "segments", "valid"])

    return ordered(df).mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digest of every conversation from its formatted rows alone, which must
    come as `format_turns` leaves them. The hashes run over the turns in
    order, so one task reads a conversation, as a stream."""
    t = template or Template()

    def run(batches):
        conv, turns, loss, n, bad, chars, size = None, None, None, 0, 0, 0, 0

        def row():
            return conv, n, bad, turns.hexdigest(), chars, loss.hexdigest(), size

        for b in batches:
            out = []
            for c, segments, valid in zip(b.column("conv_id").to_pylist(), b.column("segments").to_pylist(), b.column("valid").to_pylist(), strict=True):
                if c != conv:
                    if conv is not None:
                        out.append(row())
                    conv, turns, loss, n, bad, chars, size = c, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                pairs = [(s["text"], s["loss"]) for s in segments]
                role, text, learned = t.parse(pairs)
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(learned.encode())
                n, bad, chars, size = n + 1, bad + (not valid), chars + len(learned), size + sum(len(x) for x, _ in pairs)
            yield _digests(out)
        if conv is not None:
            yield _digests([row()])

    return formatted.mapInArrow(run, DIGEST).withColumn("conv_id", id_out("conv_id"))


def _digests(rows: list) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ((),) * 7
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, types, strict=True)], names)
