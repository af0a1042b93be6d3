"""Text in compressed blocks, and packed exchanges between blocks and buckets.

Operators that compare every position of every text would drown in rows. So
documents are written once as blocks of about two megabytes, bucketed by
block id, and what positions have to say to each other travels as packed
arrays: one row for each (block, hash bucket) pair. The number of buckets is
the session's number of shuffle partitions, so what one task holds shrinks as
that number is raised with the data. What returns to the blocks meets them in
a join that does not move them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, documents, documents_columns, forget, give_back, pack, partitions, shared_folder, unpack

BLOCK_BYTES = 2 << 20
ASK, TELL = 0, 1  # kinds of exchange rows: for a bucket's reducer; for a block as it is
EXCHANGE = "bucket int, block long, kind int, data binary"
RETURN = "block long, data binary"


@dataclass
class Block:
    """Consecutive documents: ids, lengths in bytes, and their bytes together."""

    number: int
    ids: np.ndarray
    lengths: np.ndarray
    text: bytes
    rest: pa.RecordBatch | None = None  # carried columns

    def documents(self) -> Iterator[tuple[int, int, bytes]]:
        """(id, first byte, text) of every document."""
        at = 0
        for i, n in zip(self.ids.tolist(), self.lengths.tolist(), strict=True):
            yield i, at, self.text[at : at + n]
            at += n


def make_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Write the blocks as a bucketed table in the shared folder: (block, docs,
    text, rest), `rest` holding the columns named by `carry`. A document longer than `size` has a block of its own. Repeated
    rows, empty texts and missing ids have their place like any document."""
    spark = df.sparkSession

    def run(batches):
        forget()
        press = zstandard.ZstdCompressor(level=3)
        part, n, ids, texts, rest, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block():
            docs = pack(np.array(ids, np.int64), np.array([len(t) for t in texts], np.int64))
            rows = press.compress(_stream(pa.concat_batches(rest))) if carry else None
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), pa.array([docs], pa.binary()), pa.array([press.compress(b"".join(texts))], pa.binary()), pa.array([rows], pa.binary())], ["block", "docs", "text", "rest"])

        for b in batches:
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if texts and held + len(t) > size:
                    yield block()
                    n, ids, texts, rest, held = n + 1, [], [], [], 0
                if carry:
                    rest.append(b.slice(k, 1).select(carried))
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield block()
        del ids, texts, rest
        give_back()

    bounded_batches(spark)
    name, buckets = f"blocks_{uuid.uuid4().hex}", partitions(spark)
    named = documents(df, id_col, text_col)
    if carry:  # under names of their own, so that they clash with nothing
        named = df.select(*documents_columns(id_col, text_col), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)))
    carried = [f"_c{i}" for i in range(len(carry or ()))]
    blocks = named.mapInArrow(run, "block long, docs binary, text binary, rest binary")
    blocks.repartition(buckets, "block").write.bucketBy(buckets, "block").option("compression", "none").option("path", shared_folder(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def _stream(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[Block, list]]:
    unpress = zstandard.ZstdDecompressor()
    more = b.column("told") if "told" in b.schema.names else None
    rest = b.column("rest") if "rest" in b.schema.names else None
    for k in range(b.num_rows):
        ids, lengths = unpack(b.column(1)[k].as_py(), "<i8", "<i8")
        told = more[k].as_py() if more is not None else None
        yield Block(b.column(0)[k].as_py(), ids, lengths, unpress.decompress(b.column(2)[k].as_py()), pa.ipc.open_stream(unpress.decompress(rest[k].as_py())).read_next_batch() if rest is not None and rest[k].is_valid else None), told or []


def ask(blocks: DataFrame, speak: Callable[[Block, list, int], Iterator[tuple[int, int, bytes]]], told: DataFrame | None = None) -> DataFrame:
    """Let every block say something to the buckets: `speak(block, told, n)`
    yields (bucket, kind, data) for n buckets. `told` (block, data) is what
    came back to the blocks before."""
    n = partitions(blocks.sparkSession)

    def run(batches):
        for b in batches:
            for block, data in _blocks(b):
                rows = list(speak(block, data, n))
                if rows:
                    bucket, kind, packed = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([block.number] * len(rows), pa.int64()), pa.array(kind, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "block", "kind", "data"])
        give_back()

    source = blocks.select("block", "docs", "text") if told is None else with_told(blocks, told)
    return source.mapInArrow(run, EXCHANGE)


def answer(asked: DataFrame, decide: Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Bring the rows of a bucket together; `decide(rows)` gets its (block,
    data) questions and yields (block, data) answers. Rows of kind TELL pass
    as they are."""
    n = partitions(asked.sparkSession)

    def run(batches):
        questions = []
        for b in batches:
            told = []
            for block, kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                (told if kind == TELL else questions).append((block, data))
            if told:
                yield _returns(told)
        out, size = [], 0
        for row in decide(questions) if questions else ():
            out.append(row)
            size += len(row[1])
            if size > 4 << 20:
                yield _returns(out)
                out, size = [], 0
        if out:
            yield _returns(out)
        del questions, out
        give_back()

    return asked.repartitionById(n, F.col("bucket")).mapInArrow(run, RETURN)


def _returns(rows: list) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary())], ["block", "data"])


def with_told(blocks: DataFrame, told: DataFrame, *more: str) -> DataFrame:
    """(block, docs, text, *more, told): the answers of a block, bounded by its size, beside it."""
    gathered = told.groupBy("block").agg(F.collect_list("data").alias("told"))
    return blocks.join(gathered.hint("shuffle_hash"), "block", "left").select("block", "docs", "text", *more, "told")


def finish(blocks: DataFrame, told: DataFrame, schema: str, conclude: Callable[[Block, list], Iterator[tuple]], types: list[pa.DataType]) -> DataFrame:
    """Rows of `conclude(block, told)` over all blocks."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for block, data in _blocks(b):
                rows, size = [], 0
                for row in conclude(block, data):
                    rows.append(row)
                    size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
                    if size > 8 << 20:
                        yield _table(rows, types, names)
                        rows, size = [], 0
                if rows:
                    yield _table(rows, types, names)
        give_back()

    return with_told(blocks, told).mapInArrow(run, schema)


def finish_rows(blocks: DataFrame, told: DataFrame, schema: StructType, conclude: Callable[[Block, list], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Whole rows of `conclude(block, told)`, which finds the carried columns in `block.rest`."""
    names = schema.names

    def run(batches):
        for b in batches:
            for block, data in _blocks(b):
                for out in conclude(block, data):
                    yield out.rename_columns(names)
        give_back()

    return with_told(blocks, told, "rest").mapInArrow(run, schema)


def _table(rows, types, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices in order) of every bucket that occurs."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, order[edges[k] : edges[k + 1]]


def planes(a: np.ndarray) -> np.ndarray:
    """Differences, byte plane by byte plane: what the shuffle's compression handles well."""
    d = np.diff(a, prepend=a.dtype.type(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, a.dtype.itemsize).T)


def unplanes(raw: np.ndarray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel(), dtype=kind)


def runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covered by windows of one length at sorted starts."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return starts[np.r_[0, cut]], starts[np.r_[cut - 1, len(starts) - 1]] + length
