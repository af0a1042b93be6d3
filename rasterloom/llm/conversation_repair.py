"""Repair of damaged conversations by a streaming dynamic programme.

The wanted structure is `(s?(ua)+)?` over the initials of the roles: nothing,
or user and assistant in turn after at most one system row. A row may be kept
(0), given the role that fits (1) or deleted (2); an empty row of the role
that fits may be put in anywhere (5). Blank and repeated rows must go; a row
whose text breaks off costs 5 more if it stays. The cheapest edits are found,
of several the ones whose letters (Keep, Rerole, Delete, Insert) come first
in ASCII.

How it runs: rows are dealt by conversation and sorted, so every conversation
is one stream in one task, whatever its length. It passes twice, in one sort:

1. Narrow rows (turn, initial, fault; no text) from the last to the first.
   The state is the cost to go from each of four positions in the structure,
   carried from batch to batch. Two bits per position say which edit is best
   there, so a row leaves one byte; every `spill` bytes go to the shared folder.
2. Rows with texts from the first to the last. The bytes are read backwards,
   and the edits come out in order with their texts.

A task holds one batch, one chunk of bytes, and nothing that grows with the
conversation. Repeated rows are found before, by (conversation, digest of role
and text): equal rows of one turn are counted map-side, and the first turn of
each text is found in the same shuffle.

Nulls: a null id is a conversation of its own and stays null; null turns come
first and are no gap; null roles and texts count as one space (no valid role,
blank). Rows of one turn are taken in the order of a hash of role and text;
equal rows are repeats. Texts of any length are hashed and copied whole, one
batch at a time. An empty table gives an empty table. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.session import ensure_checkpoint_dir

from .common import NO_ID, bounded_batches, id_out
from .token_files import open_folder

#: White space of the contract, ends of sentences, costs.
SPACES = " \t\n\x0b\x0c\r"
STOPS = ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5

#: Positions in the structure: 0 start, 1 after the system row, 2 after a user row, 3 after an assistant row.
FITS = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
AT_END = (0, 10, 5, 0)
LETTERS = "DIKR"
LEGAL = {"su", "ua", "au"}
GONE, GOOD, CUT, REPEAT, BLANK = range(5)

EDITS = "conv_id long, position long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def advance(to_go: tuple[int, ...], initial: str, kind: int) -> tuple[tuple[int, ...], int]:
    """Cost to go before a row from the cost to go after it, and the best edits of the four positions in two bits each."""
    best = []
    for at in range(4):
        found = (DELETE + to_go[at], 0)
        if kind in (GOOD, CUT):
            stay = TRUNCATED if kind == CUT else 0
            if (at, initial) in KEEPS:
                found = min(found, (stay + to_go[KEEPS[at, initial]], 2))
            found = min(found, (REROLE + stay + to_go[FITS[at][1]], 3))
        best.append(found)
    # an inserted row leaves the row where it is; two in a row never pay between 2 and 3
    after = [min(best[at], (INSERT + best[FITS[at][1]][0], 1)) for at in range(4)]
    best = [min(best[at], (INSERT + after[FITS[at][1]][0], 1)) for at in range(4)]
    return tuple(c for c, _ in best), sum(letter << 2 * at for at, (_, letter) in enumerate(best))


class Pointers:
    """A stack of bytes; full chunks lie in the shared folder until they are read."""

    def __init__(self, folder: str, spill: int):
        self.folder, self.spill, self.held, self.files = folder, spill, bytearray(), []

    def push(self, byte: int) -> None:
        self.held.append(byte)
        if len(self.held) >= self.spill:
            fs, root = open_folder(self.folder)
            fs.create_dir(root, recursive=True)
            name = f"{root}/{uuid.uuid4().hex}"
            with fs.open_output_stream(name) as f:
                f.write(bytes(self.held))
            self.files.append(name)
            self.held = bytearray()

    def pop(self) -> int:
        if not self.held:
            fs, _ = open_folder(self.folder)
            with fs.open_input_stream(name := self.files.pop()) as f:
                self.held = bytearray(f.read())
            fs.delete_file(name)
        return self.held.pop()


class Conversation:
    """The two passes over one conversation."""

    def __init__(self, conv: int, folder: str, spill: int, memo: dict):
        self.conv, self.memo = conv, memo
        self.pointers = Pointers(folder, spill)
        self.to_go, self.base = AT_END, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.later, self.first, self.last = None, None, None
        self.at, self.position = 0, 0
        self.begun = False

    def back(self, turn: int | None, initial: str, kind: int) -> None:
        """A row of the pass from the last to the first."""
        if kind == GONE:
            return
        if turn is not None and turn != self.first:
            self.first, self.turns = turn, self.turns + 1
            self.last = turn if self.last is None else self.last
        self.blank += kind == BLANK
        self.duplicate += kind == REPEAT
        self.truncated += kind == CUT
        self.illegal += self.later is not None and initial + self.later not in LEGAL
        self.later = initial
        key = self.to_go, initial if initial in ("s", "u", "a") else "", kind
        found = self.memo.get(key)
        if found is None:
            to_go, byte = advance(*key)
            least = min(to_go)
            found = self.memo[key] = tuple(c - least for c in to_go), least, byte
        self.to_go, more, byte = found
        self.base += more
        self.pointers.push(byte)

    def head(self) -> tuple:
        """Faults and cost, known when the first pass is over."""
        self.begun = True
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv, 0, "", "", "", gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.base + self.to_go[0]

    def _edit(self, letter: str, role: str, text: str) -> tuple:
        self.position += 1
        return self.conv, self.position, letter, role, text, 0, 0, 0, 0, 0, 0

    def _insert(self) -> tuple:
        role, self.at = FITS[self.at]
        return self._edit("I", role, "")

    def forth(self, role: str, text: str) -> Iterator[tuple]:
        """Edits up to and with a row of the pass from the first to the last."""
        byte = self.pointers.pop()
        while (letter := LETTERS[byte >> 2 * self.at & 3]) == "I":
            yield self._insert()
        if letter == "R":
            role, self.at = FITS[self.at]
        elif letter == "K":
            self.at = KEEPS[self.at, role[:1]]
        yield self._edit(letter, role, text)

    def end(self) -> Iterator[tuple]:
        while AT_END[self.at]:
            yield self._insert()


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in EDITS.split(", ")])


def repair(turns: DataFrame, others: DataFrame | None = None, spill: int = 1 << 20) -> DataFrame:
    """Cheapest edits of every conversation of (conv_id, turn, role, text).

    The first row of a conversation (position 0, edit "") carries its faults and
    cost; the others are its edits in order, with the role and text that a row
    has then (for "D", those it had). `others` may name, in `conv_id`, further
    conversations that have no rows: they get a first row of zeros. Rows stay
    together by conversation and in order; `summarise` reads them as they come."""
    c = F.col
    rows = turns.select(
        F.coalesce(c("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), c("turn").isNotNull().cast("long").alias("known"),
        F.coalesce(c("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("hash", F.xxhash64("role", "text"))
    end = F.rtrim("text", F.lit(SPACES))
    kind = F.when(end == "", BLANK).when(F.instr(F.lit(STOPS), F.right(end, F.lit(1))) > 0, GOOD).otherwise(CUT)
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    narrow = rows.select("conv_id", "known", "turn", "hash", F.substring("role", 1, 1).alias("role"), kind.alias("kind"), digest.alias("digest"))
    narrow = narrow.repartition("conv_id", "digest").groupBy("conv_id", "digest", "known", "turn", "hash", "role", "kind").agg(F.count(F.lit(1)).cast("int").alias("n"))
    first = F.row_number().over(W.partitionBy("conv_id", "digest").orderBy("known", "turn")) == 1
    narrow = narrow.withColumn("first", first).withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    kind = F.when((c("kind") != BLANK) & ~(c("first") & (c("copy") == 1)), REPEAT).otherwise(c("kind"))
    flip = [F.bitwise_not(x).alias(f"o{i}") for i, x in enumerate(("known", "turn", "hash"))]
    narrow = narrow.select("conv_id", F.lit(0).alias("pass"), *flip, F.bitwise_not("copy").alias("o3"), "known", "turn", "role", F.lit("").alias("text"), kind.alias("kind"))
    full = rows.select("conv_id", F.lit(1), "known", "turn", "hash", F.lit(0), "known", "turn", "role", "text", F.lit(GOOD))
    both = narrow.union(full)
    if others is not None:
        gone = others.select(F.coalesce(c("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id")).distinct()
        zero = F.lit(0).cast("long")
        both = both.union(gone.select("conv_id", F.lit(0), zero, zero, zero, F.lit(0), zero, zero, F.lit(""), F.lit(""), F.lit(GONE)))
    bounded_batches(turns.sparkSession)
    folder = f"{ensure_checkpoint_dir(turns.sparkSession)}/pointers-{uuid.uuid4().hex}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, now, out = {}, None, []
        for f in frames:
            for conv, back, known, turn, role, text, kind in zip(*(f[x].tolist() for x in ("conv_id", "pass", "known", "turn", "role", "text", "kind")), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.extend([] if now.begun else [now.head()])
                        out.extend(now.end())
                    now = Conversation(conv, folder, spill, memo)
                if back == 0:
                    now.back(turn if known else None, role, kind)
                else:
                    if not now.begun:
                        out.append(now.head())
                    out.extend(now.forth(role, text))
            yield _frame(out)
            out = []
        if now is not None:
            out.extend([] if now.begun else [now.head()])
            out.extend(now.end())
            yield _frame(out)

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pass", "o0", "o1", "o2", "o3").mapInPandas(run, EDITS)


def summarise(edits: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost, audit (letters of the edits) and
    the hash of the repaired rows, `role:text` joined by line feeds. Takes the
    rows as `repair` leaves them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, audit, digest, some = None, bytearray(), None, False
        names = [x.split()[0] for x in SUMMARY.split(", ")]
        columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")

        for f in frames:
            out = []
            heads = iter(zip(*(f.loc[f["edit"] == "", x].tolist() for x in columns), strict=True))
            for edit, role, text in zip(f["edit"].tolist(), f["role"].tolist(), f["text"].tolist(), strict=True):
                if not edit:
                    if head is not None:
                        out.append((*head, audit.decode(), digest.hexdigest()))
                    head, audit, digest, some = next(heads), bytearray(), hashlib.sha256(), False
                    continue
                audit += edit.encode()
                if edit != "D":
                    digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                    some = True
            yield pd.DataFrame(out, columns=names)
        if head is not None:
            yield pd.DataFrame([(*head, audit.decode(), digest.hexdigest())], columns=names)

    return edits.mapInPandas(run, SUMMARY).withColumn("conv_id", id_out("conv_id"))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): every row after the damage that the crc32 of `conv_id:turn` modulo 20
    gives it (nulls: one space). 0 drops it, 1 empties the text, 2 takes ".!?" out of it, 3 repeats the row, 4 makes it a user's."""
    c = F.col
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    part = [F.coalesce(c(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")]
    lot = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), lot.alias("_lot"))
    text = F.when(c("_lot") == 1, "").when(c("_lot") == 2, F.translate("text", STOPS, "")).otherwise(c("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(c("_lot") == 3, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", F.when(c("_lot") == 4, "user").otherwise(c("role")).alias("role"), text.alias("text"), (c("_lot") == 0).alias("dropped"), copies.alias("_copy"))
    return rows.drop("_copy")
