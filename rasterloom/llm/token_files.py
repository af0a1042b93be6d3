"""Token ids as Arrow IPC files of fixed-size lists.

A shard holds consecutive documents as one stream of ids, cut into sequences
of equal length. Its file is the Arrow stream format between a magic number
and a footer with the place of every batch, so sequence i is at a known
offset: opened through a memory map, ids and masks are views of the file
(no copy, no parsing). The last sequence of a shard is padded; the mask tells
real ids from padding. A second, small Arrow file lists the documents.

Shards are written by the tasks themselves into a shared folder. Every task
attempt writes files of its own name and reports them in its only result
row, so a lost or repeated task leaves at most files that no manifest names.
"""

from __future__ import annotations

import os
import unicodedata
import uuid
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, documents, give_back, id_out, memo, slices

MANIFEST = "path string, first_id long, last_id long, n_docs long, n_tokens long, n_sequences long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it; plain paths and file:/ are local."""
    if uri.startswith("file:"):
        uri = uri[5:]
        return pafs.LocalFileSystem(), "/" + uri.lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class LibraryEncoder:
    """Ids by the tokenizers library, which is asked once for every distinct
    word. Texts are taken chunk by chunk between spaces and line feeds, and a
    chunk of letters with a comma or full stop as the word and the sign: the
    word-end files split there in any case, so the ids are those of the whole
    text. Every other chunk goes to the library as it is."""

    LONG = 64  # longer chunks are not kept

    def __init__(self, path: str, size: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.size = size

    def _ask(self, words: list[str], whole: list[str]) -> None:
        """Learn words, each of which the file takes as one, and other pieces.
        Words go many to a text, and are told apart by their last tokens."""
        width, known, step = np.dtype(self.kind).itemsize, self.known, 512
        for at in range(0, len(words), step * 64):
            texts = [" ".join(words[i : i + step]) for i in range(at, min(at + step * 64, len(words)), step)]
            flat = np.fromiter(chain.from_iterable(e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)), self.kind)
            ends = ((np.flatnonzero(self.last[flat]) + 1) * width).tolist()
            raw = flat.tobytes()
            known.update(zip(words[at : at + step * 64], [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
        for at in range(0, len(whole), 20_000):
            part = whole[at : at + 20_000]
            known.update(zip(part, [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(part, add_special_tokens=False)], strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an array of strings), and where each text's start and end."""
        known = self.known
        if len(known) > self.size:
            known.clear()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        distinct, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        at = lists.offsets.to_numpy().astype(np.int64)
        found = list(map(known.get, distinct))
        new = [k for k, x in enumerate(found) if x is None]
        whole, words, signed, cased = [], set(), [], []
        for c in map(distinct.__getitem__, new):
            body, sign = (c[:-1], c[-1]) if c[-1:] in (",", ".") else (c, "")
            if body.isascii() and body.isalpha():
                word = body.lower()
            elif unicodedata.normalize("NFC", body).lower().isalpha():
                word = body
            else:
                whole.append(c)
                continue
            words.add(word)
            if sign:
                signed.append((c, word, sign))
            elif word != c:
                cased.append((c, word))
        self._ask([*words.difference(known)], [*whole, *(x for x in (",", ".") if x not in known)])
        for c, word in cased:
            known[c] = known[word]
        for c, word, sign in signed:
            known[c] = known[word] + known[sign]
        for k in new:
            found[k] = known[distinct[k]]
        table = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize
        for c in whole:
            if len(c) > self.LONG:
                known.pop(c, None)
        # ids of every place: those of its word, one run after the other
        n = sizes[codes]
        ends = np.r_[0, np.cumsum(n)]
        place = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], n)
        return table[place], ends[at - at[0]]


class ShardWriter:
    """Appends documents; holds one batch of sequences at most."""

    def __init__(self, folder: str, kind: str, length: int, rows: int, pad: int):
        self.fs, root = open_folder(folder)
        self.name = f"shard-{uuid.uuid4().hex}"
        self.fs.create_dir(root, recursive=True)
        self.length, self.rows, self.pad = length, rows, pad
        item = pa.uint16() if kind == "<u2" else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.item, self.kind = item, kind
        self.sinks = [self.fs.open_output_stream(f"{root}/{self.name}{x}.arrow") for x in ("", ".index")]
        self.data, self.index = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], INDEX)
        self.waiting, self.n_waiting, self.n_tokens, self.n_sequences, self.docs = [], 0, 0, 0, []
        self.first = self.last = None
        self.n_docs = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.first = doc_id if self.first is None else self.first
        self.last = doc_id
        self.docs.append((doc_id, self.n_tokens, len(ids)))
        self.n_docs += 1
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_tokens += len(ids)
        if self.n_waiting >= self.length * self.rows:
            self._flush(False)
        if len(self.docs) >= 50_000:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, self.kind)
        step = self.length * self.rows
        whole = len(flat) if last else len(flat) // step * step
        for at in range(0, whole, step):
            part = flat[at : min(at + step, whole)]
            short = -len(part) % self.length
            mask = np.ones(len(part) + short, bool)
            if short:
                mask[len(part) :] = False
                part = np.concatenate([part, np.full(short, self.pad, self.kind)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v, type=t), self.length) for v, t in ((part, self.item), (mask, pa.bool_()))]
            self.data.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
            self.n_sequences += len(part) // self.length
        self.waiting = [flat[whole:].copy()]
        self.n_waiting = len(flat) - whole

    def _flush_index(self) -> None:
        if self.docs:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*self.docs, strict=True)], schema=INDEX))
            self.docs = []

    def close(self) -> None:
        self._flush(True)
        self._flush_index()
        for x in (self.data, self.index, *self.sinks):
            x.close()


class Shard:
    """Random access to a shard. Local files are memory-mapped."""

    def __init__(self, path: str):
        fs, p = open_folder(path)
        self.local = isinstance(fs, pafs.LocalFileSystem)
        source = (lambda q: pa.memory_map(q)) if self.local else fs.open_input_file
        self.data, self.index = pa.ipc.open_file(source(f"{p}.arrow")), pa.ipc.open_file(source(f"{p}.index.arrow"))
        self.length = self.data.schema.field("ids").type.list_size
        self.batches: list = [None] * self.data.num_record_batches
        self.rows = self.data.get_batch(0).num_rows if self.batches else 1

    def _batch(self, i: int):
        if not self.local:  # without a map, hold one batch
            if self.batches[i] is None:
                self.batches = [None] * len(self.batches)
        if self.batches[i] is None:
            self.batches[i] = self.data.get_batch(i)
        return self.batches[i]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence i, as views of the file."""
        b, r = self._batch(i // self.rows), i % self.rows
        cut = slice(r * self.length, (r + 1) * self.length)
        return b.column("ids").flatten().to_numpy()[cut], b.column("mask").flatten()[cut]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the shard's stream; a view unless they span batches."""
        step, parts = self.length * self.rows, []
        while n > 0:
            flat = self._batch(start // step).column("ids").flatten().to_numpy()
            part = flat[start % step : start % step + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, "<u2")

    def documents(self):
        """(doc_id, start, n_tokens) of every document, in order."""
        for i in range(self.index.num_record_batches):
            b = self.index.get_batch(i)
            yield from zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)


def write_tokens(df: DataFrame, folder: str, path: str, end_id: int | None = 1, length: int = 2048, rows: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode documents with a public tokenizer file, `end_id` after each, into
    shards in ascending id order. Returns the manifest, one row per shard, in
    a written table. Texts are range-partitioned by id once; equal ids are
    ordered by text. Null texts are empty; null ids come first; an empty table
    gives an empty manifest."""
    def run(batches):
        writer = None
        for b in slices(batches, 1024):
            enc = memo(("library", path), lambda: LibraryEncoder(path))
            if b.num_rows and writer is None:
                writer = ShardWriter(folder, enc.kind, length, rows, end_id or 0)
            end = np.array([] if end_id is None else [end_id], enc.kind)
            flat, at = enc.encode(b.column(1).cast(pa.string()))
            for i, lo, hi in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                writer.add(i, np.concatenate([flat[lo:hi], end]))
        if writer:
            writer.close()
            w = writer
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (f"{folder}/{w.name}", w.first, w.last, w.n_docs, w.n_tokens, w.n_sequences)], ["path", "first_id", "last_id", "n_docs", "n_tokens", "n_sequences"])

    d = documents(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return checkpoint(d.mapInArrow(run, MANIFEST))


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document, read from the
    files. `start` counts the ids of all documents before it. One row per
    shard goes through one window; equal ids never span two shards, so the
    first ids order them."""
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("first_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("path", before.alias("base"))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard, rows, held = Shard(path), [], 0
                for doc, start, n in shard.documents():
                    ids = shard.tokens(start, n).astype("<u4").tobytes()
                    rows.append((doc, base + start, n, ids))
                    held += len(ids)
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    n = max(1, manifest.count())
    return shards.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary").withColumn("doc_id", id_out())


def _rows(rows: list) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
