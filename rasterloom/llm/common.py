"""Small helpers shared by the text operators.

Row identity: operators name a document by an integer id. A null id is
carried internally as the smallest possible id (`NO_ID`) and comes back as
null. Null texts count as empty. Columns other than the id and the text are
ignored, so clashing names in the input do no harm.
"""

from __future__ import annotations

import ctypes
import gc
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import checkpoint, ensure_checkpoint_dir

NO_ID = -(2**63)
#: Bytes that separate words in every contract: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b" \t\n\r\x0b\x0c"
MASK64 = (1 << 64) - 1

__all__ = ["NO_ID", "WHITE", "checkpoint", "documents", "id_out", "Memo", "memo", "forget", "give_back", "bounded_batches", "slices", "split", "byte_runs", "hash_words", "shared_folder", "partitions", "mix64", "random_odd", "batch"]


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of 2 MB at most: what a task holds outside the heap and in
    Python follows the batch. A session's own setting stays."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "2m")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text binary): the UTF-8 bytes of every text, without nulls."""
    bounded_batches(df.sparkSession)
    return df.select(*documents_columns(id_col, text_col))


def documents_columns(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    return [
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
    ]


def id_out(name: str = "doc_id") -> Column:
    """The id as it came in: null where it was missing."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


class Memo(dict):
    """A dictionary that computes what is missing and holds at most about two
    generations of `size` entries, so its memory is bounded while frequent
    keys stay. Long keys are computed every time and not kept."""

    LONG = 64

    def __init__(self, compute, size: int = 200_000):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        if len(key) > self.LONG:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


_MEMOS: dict = {}


def memo(name, make) -> Memo:
    """One object per Python worker: it survives from task to task, until a
    task asks for another one or calls `forget`."""
    if name not in _MEMOS:
        _MEMOS.clear()
        give_back()  # also what earlier stages no longer use
        _MEMOS[name] = make()
    return _MEMOS[name]


def forget() -> None:
    """Drop what tasks of another operator remembered in this worker: a
    pipeline's later stages run in the workers of the earlier ones."""
    if _MEMOS:
        _MEMOS.clear()
        give_back()


def give_back() -> None:
    """Hand memory that Python and Arrow hold but no longer use back to the
    system. Workers are used again by later stages, whose executor would
    otherwise carry what the earlier ones once needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers in place (a bijection)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_odd(n: int, seed: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def slices(batches, rows: int = 256, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, of about `size` bytes of text (column 1) at most."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(at, to - at)
            at = to


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word at every place, and where each text starts and ends."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
    flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    some = pc.not_equal(flat, "")
    if not pc.all(some).as_py():
        keep = some.to_numpy(zero_copy_only=False)
        at = np.r_[0, np.cumsum(keep)][at]
        flat = flat.filter(some)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), at


def byte_runs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the words and the length of each."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.frombuffer(words.buffers()[1], np.int32)[words.offset] if len(words) else 0
    data = words.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[start : start + lengths.sum()] if data else np.empty(0, np.uint8)
    return flat, lengths


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words that are not empty, all at once."""
    flat, lengths = byte_runs(words)
    if not len(lengths):
        return np.empty(0, np.uint64)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(flat)) - np.repeat(begin, lengths)
    return mix64(np.add.reduceat((flat.astype(np.uint64) + np.uint64(1)) * (_PLACES[place & 255] + (place >> 8).astype(np.uint64)), begin))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PLACES = random_odd(256, 12)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays back to back, each after its byte length."""
    return b"".join(x for a in arrays for x in (struct.pack("<q", a.nbytes), a.tobytes()))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        (n,) = struct.unpack_from("<q", data, at)
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out
