"""Byte-pair encoding as a streaming transducer with bounded lookahead.

A merge list is *proper* when both parts of every merge are base symbols or
results of earlier merges. For such lists, how far the symbols to the right
can still change a token is bounded, and the bound follows from the list:

* A merge r = (u, v) is decided differently in two texts only if, earlier in
  merge order, something happened at the right end of v in one of them: a
  merge q = (c, d) with c on the right spine of v (v itself, its right part,
  the right part of that, ...) and q before the merge that consumes c.
* So `reach(r) = len(v) + max(reach(q))` over those q, a longest path in a
  graph without cycles (ranks fall along it), and the sufficient lookahead is
  `max(len(u) - 1 + reach(r))`.

Once that many symbols follow a position, every token that starts before the
position is final. `Transducer` keeps only the undecided tail and a block of
symbols, however long the word. Decoding is an incremental state machine
from ids to bytes to text.
"""

from __future__ import annotations

import codecs
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, documents, give_back, id_out, memo, slices

END = "</w>"


@lru_cache(1)
def byte_symbols() -> list[str]:
    """Printable stand-in of each byte: itself if printable Latin-1, else a character from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(hidden)) for b in range(256)]


class MergeTable:
    """A vocabulary with its merges: ranks of pairs, parts of tokens, lookahead.

    Symbols are single characters, the last one of a word carrying the
    end-of-word mark as a suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.rank = {(a, b): r for r, (a, b) in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in merges}
        made = set(vocab) - set(self.parts)
        for a, b in merges:
            if a not in made or b not in made:
                raise ValueError(f"the merge list is not proper at ({a!r}, {b!r})")
            made.add(a + b)
        sizes: dict[str, set[int]] = {}
        for t in vocab:
            sizes.setdefault(t[:3], {2, 1}).add(len(t.removesuffix(END)) if t != END else len(t))
        # by their first three characters, the sizes of the tokens, largest first
        self.sizes = {start: tuple(sorted(found, reverse=True)) for start, found in sizes.items()}
        self.names = {i: t for t, i in vocab.items()}
        self.follows = Memo(self._follows, 100_000)
        self.reachable = Memo(self._reachable, len(vocab) + 1)
        self.lookahead = self._lookahead(merges)

    def _spine(self, token: str) -> Iterator[tuple[str, int | None]]:
        """Right spine of a token with the rank of the merge that consumes each part."""
        consumed = None
        while True:
            yield token, consumed
            parts = self.parts.get(token)
            if parts is None:
                return
            consumed, token = self.rank[parts], parts[1]

    def _lookahead(self, merges) -> int:
        size = {t: len(t.removesuffix(END)) if t != END else len(t) for t in self.vocab}
        by_left: dict[str, list[tuple[int, int]]] = {}  # left part: (rank, longest reach so far), both rising
        most = 1
        for r, (u, v) in enumerate(merges):
            further = 0
            for part, consumed in self._spine(v):
                limit = r if consumed is None else consumed
                for rank, reach in reversed(by_left.get(part, ())):
                    if rank < limit:
                        further = max(further, reach)
                        break
            reach = size[v] + further
            known = by_left.setdefault(u, [])
            known.append((r, max(reach, known[-1][1]) if known else reach))
            most = max(most, size[u] - 1 + reach)
        return most

    def reduce(self, symbols: list[str]) -> list[str]:
        """The definition: all merges of a run of symbols, lowest rank first, left to right."""
        rank, out = self.rank, symbols
        while len(out) > 1:
            best = min(rank.get(p, 1 << 60) for p in zip(out, out[1:], strict=False))
            if best == 1 << 60:
                break
            merged, i, n = [], 0, len(out)
            while i < n:
                if i + 1 < n and rank.get((out[i], out[i + 1])) == best:
                    merged.append(out[i] + out[i + 1])
                    i += 2
                else:
                    merged.append(out[i])
                    i += 1
            out = merged
        return out

    def _reachable(self, token: str) -> bool:
        """Whether the merges of a token's own symbols give the token."""
        body = token.removesuffix(END) if token != END else token
        symbols = list(body)
        if body != token:
            symbols[-1] += END
        return self.reduce(symbols) == [token]

    def _stays(self, pair: tuple[str, str]) -> bool:
        """Whether two neighbouring tokens stay apart: no merge fits across
        their border before the merges that consume its two sides."""
        left, consumed = [], 1 << 60
        token = pair[0]
        while True:
            left.append((token, consumed))
            parts = self.parts.get(token)
            if parts is None:
                break
            consumed, token = self.rank[parts], parts[1]
        token, consumed = pair[1], 1 << 60
        while True:
            for other, limit in left:
                r = self.rank.get((other, token))
                # of two equal merges that overlap, the left one comes first
                if r is not None and r < limit and r <= consumed:
                    return False
            parts = self.parts.get(token)
            if parts is None:
                return True
            consumed, token = self.rank[parts], parts[0]

    def _follows(self, pair: tuple[int | None, int]) -> bool:
        """Whether a token is reachable and stays apart from the one before it, if any."""
        before, token = self.names.get(pair[0]), self.names[pair[1]]
        return self.reachable[token] and (before is None or self._stays((before, token)))

    def encode(self, symbols: list[str]) -> list[str]:
        """The same tokens as `reduce`, found left to right: the longest token
        that stays apart from the one before it, stepping back from dead ends.
        A sequence of reachable tokens whose neighbours all stay apart is the
        one result of the merges."""
        n, text = len(symbols), "".join(symbols)
        if n == 1:
            return [text]
        return [self.names[i] for i in self.split(text, n, text.endswith(END) and len(text) > n)]

    def split(self, text: str, n: int, ends: bool) -> list[int]:
        """As `encode`, ids for a text of n symbols; `ends`: the last one
        carries the end-of-word mark."""
        known, follows, sizes = self.vocab.get, self.follows, self.sizes
        if n == 1:
            return [self.vocab[text]]
        out: list[int] = []
        pos, dead, most, last = 0, (), n, None
        while pos < n:
            for size in sizes.get(text[pos : pos + 3], (2, 1)):
                if size > most:
                    continue
                stop = pos + size
                token = known(text[pos:stop] if stop < n or not ends else text[pos:])
                if token is not None and follows[last, token] and stop not in dead:
                    out.append(token)
                    pos, most, last = stop, n - stop, token
                    break
            else:
                dead = {*dead, pos}
                most = len(self.names[out.pop()]) - 1
                pos -= most + 1
                last = out[-1] if out else None
        return out


class Transducer:
    """Symbols in, tokens out, as soon as no continuation can change them.

    At most `lookahead + block` symbols and one token are held at any time."""

    def __init__(self, table: MergeTable, block: int = 64):
        self.table, self.tail = table, []
        self.room = table.lookahead + block

    def push(self, symbols: Iterable[str]) -> Iterator[str]:
        for s in symbols:
            self.tail.append(s)
            if len(self.tail) >= self.room:
                yield from self._settle(len(self.tail) - self.table.lookahead)

    def finish(self) -> Iterator[str]:
        yield from self.table.encode(self.tail)
        self.tail = []

    def _settle(self, before: int) -> Iterator[str]:
        """Tokens that start before a position with the full lookahead after it."""
        at = 0
        for token in self.table.encode(self.tail):
            if at >= before:
                break
            at += len(token)
            yield token
        self.tail = self.tail[at:]


class Tokenizer:
    """Reads a public tokenizer file (normaliser: composition, white space,
    lower case; words by pattern; end-of-word BPE on bytes) and encodes and
    decodes as the file prescribes. Special tokens in a text become their ids.

    A text is taken white-space-separated chunk by chunk: no rule of these
    files looks across white space. Chunks are remembered in a bounded memo.
    """

    def __init__(self, path: str, words: int = 60_000, chunks: int = 200_000):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("continuing_subword_prefix"):
            raise ValueError("only BPE files with the end-of-word mark are read")
        self.table = MergeTable(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.surface = {i: t for t, i in (self.table.vocab | self.special).items()}
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normalisers {kinds}")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.sign = next((c for c in "".join(self.special) if all(c in t for t in self.special)), None)  # no special token without it
        self.symbols = byte_symbols()
        self.room = Transducer(self.table).room
        self.word_ids = Memo(self._word, words)
        self.chunk_ids = Memo(self._chunk, chunks)
        self.utf8 = {i: t.encode() for i, t in self.surface.items()}

    def _word(self, word: str) -> bytes:
        return pack_ids(self._ids(word.encode().decode("latin-1").translate(self.symbols)))

    def _ids(self, symbols: str) -> list[int]:
        """Ids of a word given as byte symbols without the end-of-word mark."""
        if len(symbols) < self.room:  # all of it stays undecided up to its end
            return self.table.split(symbols + END, len(symbols), True)
        machine = Transducer(self.table)
        tokens = chain(machine.push([*symbols[:-1], symbols[-1] + END]), machine.finish())
        return [self.table.vocab[t] for t in tokens]

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        elif any(unicodedata.category(c) == "Cn" for c in text):
            return self._unknown(text)
        else:  # per character, as the file's library does: a final sigma is no special case
            text = compose(text).replace("Σ", "σ").lower()
        get = self.word_ids
        if len(text) < 64:
            if text.isalpha():
                return get[text]
            if text[:-1].isalpha() and text[-1:] in (",", "."):
                return get[text[:-1]] + get[text[-1]]
        return b"".join([get[w] for w in self.words.findall(text)])

    def _unknown(self, text: str) -> bytes:
        """Text with characters that Python's tables don't know: the library,
        whose tables are newer, says how they are composed, lower-cased and
        split into words; its words come as byte symbols."""
        if self.library is None:
            from tokenizers import Tokenizer as Library

            self.library = Library.from_file(self.path)
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return pack_ids([i for word, _ in words for i in self._ids(word)])

    def _chunk(self, chunk: str) -> bytes:
        if self.marks is None or (self.sign and self.sign not in chunk) or not self.marks.search(chunk):
            return self._plain(chunk)
        out, at = [], 0
        for m in self.marks.finditer(chunk):
            out += [self._plain(chunk[at : m.start()]), pack_ids([self.special[m[0]]])]
            at = m.end()
        return b"".join([*out, self._plain(chunk[at:])])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.chunk_ids.__getitem__, text.replace("\n", " ").split(" ")))


def pack_ids(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def compose(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


class Decoder:
    """Ids to text, incrementally: feed ids, get the text that is certain.

    `mode="surface"` writes token strings separated by one space, which is
    what a file without a decoder section prescribes; `mode="bytes"` maps the
    tokens back to bytes, ends words with a space and resolves UTF-8
    sequences that span tokens (invalid bytes become U+FFFD)."""

    def __init__(self, tokenizer: Tokenizer, mode: str = "surface"):
        self.mode, self.first = mode, True
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        if mode == "surface":
            self.pieces = tokenizer.utf8
        else:
            byte = {c: bytes([b]) for b, c in enumerate(tokenizer.symbols)}
            special = set(tokenizer.special.values())
            self.pieces = {}
            for i, t in tokenizer.surface.items():
                if i in special:
                    self.pieces[i] = t.encode()
                else:
                    body = t.removesuffix(END) if t != END else t
                    self.pieces[i] = b"".join(byte[c] for c in body) + (b" " if body != t else b"")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.mode == "surface":
            raw = b" ".join([self.pieces[i] for i in ids])
            raw, self.first = (raw if self.first else b" " + raw), False
        else:
            raw = b"".join([self.pieces[i] for i in ids])
        return self.state.decode(raw)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, once per Python worker."""
    return memo(("bpe", path), lambda: Tokenizer(path))


ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "surface", block: int = 65_536) -> DataFrame:
    """One row per document: (doc_id, n_tokens, ids, decoded).

    `ids` holds little-endian unsigned 32-bit numbers; `decoded` is the text
    that the incremental decoder makes of them. One narrow pass without a
    shuffle. Null and empty texts give no ids and an empty text; repeated rows
    stay; a null id stays null; an empty table gives an empty table."""

    def run(batches):
        t = tokenizer(path)
        for b in slices(batches):
            out = []
            for text in b.column(1).cast(pa.string()).to_pylist():
                ids = t.encode(text)
                decoder = Decoder(t, mode)
                numbers = np.frombuffer(ids, "<u4")
                pieces = [decoder.feed(numbers[i : i + block].tolist()) for i in range(0, len(numbers), block)]
                out.append((len(numbers), ids, "".join([*pieces, decoder.finish()])))
            n, ids, texts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
        give_back()

    return documents(df, id_col, text_col).mapInArrow(run, ENCODED).withColumn("doc_id", id_out())
