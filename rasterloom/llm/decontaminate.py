"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into blocks of words. Hashed TF-IDF vectors of passages are
reduced by a distributed randomised SVD: every task multiplies its passages
with a random test matrix and back, partial products are summed in a tree, and
the driver factorises the small result. Overlapping windows, about as long as
the item and starting at every fourth word (at every word for items under ten
words), are compared with the items by cosine in the latent space, its axes
scaled to equal variance. Candidates are read word by word: the longest
common subsequence of item and neighbourhood, and whether the item's answer
is there, decide - so changed, dropped or added words do not hide an item.

The cut of the cosine is below nearly all that brute force calls a leak: see
COSINE and the README.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, checkpoint, documents, forget, give_back, hash_words, id_out, partitions, slices

FEATURES = 2048
RANK = 128
EXTRA = 8
BLOCK = 32  # words
PASSAGE = 4  # blocks in a passage of the decomposition
STEP = 4  # words between the starts of windows
SHORT = 10  # items under so many words are searched for at every word
LONGEST = 64  # words of a window; longer items are searched for in pieces
NEAR = 16  # words within which the starts of candidates are read together
RUN = 30  # words in a row that are a leak of any longer item
SPAN = 4096  # words compared at a time: their arrays stay in a core's cache
COSINE = 0.33  # no exact copy measured under 0.68, no other leak under 0.35 (items of 15 to 59 words)
ITEMS = 5_000  # items searched for in one pass
PUNCTUATION = ".,;:!?()[]{}\"'`«»„“”…-*_#/"
WORDS = "doc_id long, words binary"


def _hashes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words of all texts, without case and surrounding
    punctuation, and where each text starts and ends. Every distinct word is
    hashed once: neither case nor composition reaches across white space."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
    at = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = pc.utf8_trim(pc.utf8_lower(pc.utf8_normalize(coded.dictionary, "NFC")), PUNCTUATION)
    some = pc.not_equal(words, "")
    known = np.zeros(len(words), np.uint32)  # 0: nothing but punctuation
    known[some.to_numpy(zero_copy_only=False)] = (hash_words(words.filter(some)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    flat = known[coded.indices.to_numpy()]
    kept = np.r_[0, np.cumsum(flat != 0)]
    return flat[flat != 0], kept[at - at[0]]


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of one text."""
    return _hashes_of(pa.array([text], pa.binary()))[0]


def hashed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words): little-endian 32-bit word hashes of every whole text, written once."""
    def run(batches):
        forget()
        for b in slices(batches):
            flat, at = _hashes_of(b.column(1))
            ends = pa.py_buffer((at * 4).astype(np.int32).tobytes())
            rows = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, ends, pa.py_buffer(flat.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), rows], ["doc_id", "words"])
        give_back()

    return checkpoint(documents(df, id_col, text_col).mapInArrow(run, WORDS))


def _blocks(rows: list[bytes], size: int, features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of hashed words for up to 1024 blocks of `size` words at a time:
    (row of each block, its number in the row, float32 matrix)."""
    flat = np.frombuffer(b"".join(rows), "<u4")
    words = np.array([len(data) // 4 for data in rows], np.int64)
    blocks = -(-words // size)
    row = np.repeat(np.arange(len(rows)), blocks)
    number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    held = np.minimum(size, words[row] - number * size)
    ends = np.r_[0, np.cumsum(held)]
    for lo in range(0, len(row), 1024):
        hi = min(lo + 1024, len(row))
        cells = np.repeat(np.arange(hi - lo) * features, held[lo:hi]) + _bucket(flat[ends[lo] : ends[hi]], features)
        out = np.zeros((hi - lo) * features, np.float32)
        np.add.at(out, cells, np.float32(1))
        yield row[lo:hi], number[lo:hi], out.reshape(-1, features)


@dataclass
class Space:
    """`idf` of the hashed features and `axes`, which take counts to latent
    coordinates of equal variance (they hold the idf and 1 / singular value)."""

    idf: np.ndarray
    axes: np.ndarray
    values: np.ndarray


def _summed(df: DataFrame, width: int) -> np.ndarray | None:
    """Sum of one array of doubles per row, in a tree: about the square root of
    the number of partitions, then one. Each task holds two arrays, and no
    task runs two Python steps: that would leave it with two workers."""
    def add(batches):
        total = None
        for b in batches:
            for data in b.column(0).to_pylist():
                x = np.frombuffer(data, np.float64)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    half = max(1, math.isqrt(partitions(df.sparkSession)))
    rows = df.repartition(half).mapInArrow(add, "part binary").repartition(1).mapInArrow(add, "part binary").collect()
    return np.frombuffer(rows[0][0], np.float64) if rows else None


def document_frequencies(words: DataFrame, features: int = FEATURES) -> np.ndarray:
    """Passages that hold each feature, and at the end the number of passages, over all documents."""
    def run(batches):
        forget()
        total = np.zeros(features + 1)
        for b in batches:
            for _, _, m in _blocks(b.column(1).to_pylist(), BLOCK * PASSAGE, features):
                total[:-1] += (m > 0).sum(0)
                total[-1] += len(m)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])
        give_back()

    found = _summed(words.mapInArrow(run, "part binary"), features + 1)
    return np.zeros(features + 1) if found is None else found


def latent_space(words: DataFrame, features: int = FEATURES, rank: int = RANK, seed: int = 7) -> Space:
    """Randomised SVD of the TF-IDF matrix of all passages, one pass.

    With A the passages (rows of unit length) and W random, Y = A'(A W) gives
    the eigenvectors of A'A by the Nystrom formula with a small shift."""
    df = document_frequencies(words, features)
    idf = np.log((2 + df[-1]) / (1 + df[:-1])).astype(np.float32)  # above 0 even for words of every passage
    test = np.random.default_rng(seed).standard_normal((features, min(rank + EXTRA, features))).astype(np.float32)

    def run(batches):
        forget()
        total = np.zeros(test.shape)
        for b in batches:
            for _, _, m in _blocks(b.column(1).to_pylist(), BLOCK * PASSAGE, features):
                m *= idf
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                total += m.T @ (m @ test)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])
        give_back()

    y = _summed(words.mapInArrow(run, "part binary"), test.size)
    if y is None or not np.any(y):
        return Space(idf, np.zeros((features, 1), np.float32), np.zeros(1))
    y = y.reshape(test.shape)
    w = test.astype(np.float64)
    w, r = np.linalg.qr(w)
    y = np.linalg.solve(r.T, y.T).T  # as if the test matrix had been orthonormal
    shift = 1e-9 * np.linalg.norm(y)
    y = y + shift * w
    core = (w.T @ y + (w.T @ y).T) / 2
    lower = np.linalg.cholesky(core + 1e-12 * np.trace(core) * np.eye(len(core)))
    vectors, s, _ = np.linalg.svd(np.linalg.solve(lower, y.T).T, full_matrices=False)
    values = np.sqrt(np.maximum(s**2 - shift, 0))
    use = values[:rank] > 1e-6 * values[0]
    vectors, values = vectors[:, :rank][:, use], values[:rank][use]
    return Space(idf, (idf[:, None] * vectors / values).astype(np.float32), values)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with one bit per word of `a`."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@dataclass
class Item:
    id: int
    words: list[int]
    answer: list[int]

    @cached_property
    def distinct(self) -> set[int]:
        return set(self.words)

    @cached_property
    def places(self) -> dict[int, list[int]]:
        out: dict = {}
        for i, x in enumerate(self.words):
            out.setdefault(x, []).append(i)
        return out

    @cached_property
    def halves(self) -> set[bytes]:
        """All sequences of RUN / 2 words of the item."""
        raw = array("I", self.words).tobytes()
        return {raw[4 * i : 4 * i + 2 * RUN] for i in range(len(self.words) - RUN // 2 + 1)}

    def passage(self, near: list[int]) -> bool:
        """RUN words in a row of the item, or nearly all of one piece of a long one."""
        if len(self.words) < RUN:
            return False
        # RUN words in a row hold RUN / 2 that start at a multiple of RUN / 2
        raw = array("I", near).tobytes()
        if any(raw[at : at + 2 * RUN] in self.halves for at in range(0, len(raw), 2 * RUN)):
            runs: dict = {}
            for x in near:
                runs = {i: runs.get(i - 1, 0) + 1 for i in self.places.get(x, ())}
                if runs and max(runs.values()) >= RUN:
                    return True
        if len(self.words) <= LONGEST:
            return False
        pieces = (p.tolist() for p in _pieces(np.array(self.words, np.uint32)))
        parts = [near[lo : lo + 3 * LONGEST] for lo in range(0, len(near), LONGEST)]
        return any(common_subsequence(p, x) >= 0.8 * len(p) for p in pieces for x in parts)


def read_item(item_id: int, text: bytes) -> Item:
    """Words of an item. Its answer is what follows the last question mark or
    "answer:", else the last sentence, else (one sentence) the last third."""
    plain = text.decode("utf-8", "replace").strip()
    words = word_hashes(text)
    cut = max(plain.rfind("?"), plain.lower().rfind("answer:") + 6 if "answer:" in plain.lower() else -1)
    if cut < 0:
        cut = max(plain.rstrip(".! ").rfind(x) for x in (". ", ".\n", "! "))
    answer = word_hashes(plain[cut + 1 :].encode()) if cut >= 0 else words[-max(1, len(words) // 3) :]
    return Item(item_id, words.tolist(), (answer if len(answer) else words[-max(1, len(words) // 3) :]).tolist())


def judge(item: Item, near: list[int]) -> tuple[bool, float, float]:
    """Whether a neighbourhood repeats an item: nearly all of its words in
    order, or more than half of them and the answer, or RUN words in a row, or
    nearly all words of one piece of an item longer than a window. Items under
    eight words must be there whole."""
    n = len(item.words)
    share = 1 - len(item.distinct.difference(near)) / n  # at least the share in order, and quicker
    if share >= (0.55 if n >= 8 else 1.0):
        share = common_subsequence(item.words, near) / n
    if share >= (0.55 if n >= 8 else 1.0):
        answer = common_subsequence(item.answer, near) / len(item.answer)
        if share >= 0.8 or answer >= 0.8:
            return True, share, answer
    if not item.passage(near):
        return False, share, 0.0
    return True, common_subsequence(item.words, near) / n, common_subsequence(item.answer, near) / len(item.answer)


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, word, cosine, shared, answer): documents that repeat a
    benchmark item or a passage of it (see judge), one row for each such pair, with the best place.

    All documents are searched, ITEMS items at a time. Null and empty texts
    repeat nothing; items without words are never found; a missing id stays
    null; repeated rows of a document count once."""
    words = hashed_documents(docs, id_col, text_col)
    space = latent_space(words)
    items = documents(benchmark, item_col, item_text).dropDuplicates().where(F.length("text") > 0)
    numbered = checkpoint(items.withColumn("part", F.floor(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit((1 << 30) / max(1, -(-items.count() // ITEMS))))))
    out = None
    for (part,) in numbered.select("part").distinct().collect() or [(0,)]:
        table = [read_item(i, t) for i, t in numbered.where(F.col("part") == part).select("doc_id", "text").collect()]
        found = _search(words, space, [x for x in table if x.words], cosine)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("shared", "answer", "cosine", F.col("word").alias("w"))).alias("x"))
    return best.select(id_out().alias("doc_id"), F.when(F.col("item_id") != NO_ID, F.col("item_id")).alias("item_id"), F.col("x.w").alias("word"), "x.cosine", "x.shared", "x.answer")


def _queries(items: list[Item], space: Space) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """By step and number of steps in a window: latent directions, one a row, and the item of each."""
    found: dict = {}
    for k, item in enumerate(items):
        words = np.array(item.words, np.uint32)
        step = 1 if len(words) < SHORT else STEP
        for piece in _pieces(words):
            own, data = found.setdefault(step, {}).setdefault(round(len(piece) / step), ([], []))
            own.append(k)
            data.append(space.axes[_bucket(piece, len(space.idf))].sum(0))
    return {step: {k: (_unit(np.array(data)), np.array(own)) for k, (own, data) in by.items()} for step, by in found.items()}


def _pieces(words: np.ndarray) -> list[np.ndarray]:
    """The words, or windows of them that overlap by half and reach the end."""
    last = max(0, len(words) - LONGEST)
    return [words[lo : lo + LONGEST] for lo in [*range(0, last, LONGEST // 2), last]]


def _bucket(words: np.ndarray, features: int) -> np.ndarray:
    return (words >> np.uint32(8)) % np.uint32(features)


def _spans(rows: list[np.ndarray], step: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of about SPAN words: (row, first word, words). Parts of a long row overlap by a window."""
    out, n = [], 0
    for r, w in enumerate(rows):
        for lo in range(0, len(w), SPAN):
            out.append((r, lo, w[lo : lo + SPAN + LONGEST]))
            n += len(out[-1][2]) + LONGEST * step // STEP
            if n >= SPAN:
                yield out
                out, n = [], 0
    if out:
        yield out


def _candidates(rows: list[np.ndarray], queries: dict, table: np.ndarray, cosine: float) -> dict[tuple[int, int], list[tuple[int, int, float]]]:
    """By row and item: (first word, words, cosine) of the windows that reach the cut.
    `table` has the axes and a last row of zeros, which fills up what is behind a row's end."""
    found: dict = {}
    all_of = {step: np.concatenate([q for q, _ in by.values()]) for step, by in queries.items()}
    for step in sorted(queries):
        longest = max(queries[step])
        for span in _spans(rows, step):
            count = [-(-len(w) // step) + longest for _, _, w in span]  # windows never reach the next row
            begin = np.cumsum([0, *count])
            cells = np.full(begin[-1] * step, len(table) - 1, np.int64)
            for (_, _, w), b in zip(span, begin, strict=False):
                cells[b * step : b * step + len(w)] = _bucket(w, len(table) - 1)
            cells = cells.reshape(-1, step)
            x = table.take(cells[:, 0], axis=0, mode="clip")  # all are in range: no check for each
            more = np.empty_like(x)
            for c in cells.T[1:]:
                x += table.take(c, axis=0, out=more, mode="clip")
            sizes = _sizes(x, longest)
            products = all_of[step] @ x.T
            lo_q = 0
            for k, (q, owner) in queries[step].items():
                c, size = _sums(products[lo_q : lo_q + len(q)], k), sizes[k - 1]
                lo_q += len(q)
                hit = np.flatnonzero(c >= np.maximum(cosine * size, 1e-6).astype(np.float32))
                j, i = np.divmod(hit, c.shape[1])
                at = np.searchsorted(begin, i, "right") - 1
                for i, j, at, near in zip(i.tolist(), j.tolist(), at.tolist(), (c.reshape(-1)[hit] / size[i]).tolist(), strict=True):
                    row, lo, _ = span[at]
                    found.setdefault((row, int(owner[j])), []).append((lo + (i - int(begin[at])) * step, k * step, near))
    return found


def _sums(x: np.ndarray, k: int) -> np.ndarray:
    """Sums of k neighbouring columns, by doubling."""
    n, at, width, out = x.shape[1] - k + 1, 0, 1, None
    while k:
        if k & 1:
            out = x[:, at : at + n] if out is None else out + x[:, at : at + n]
            at += width
        k >>= 1
        if k:
            x = x[:, :-width] + x[:, width:]
            width *= 2
    return out


def _sizes(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """Length of the sum of 1, 2, ... `longest` neighbouring rows, from their
    products: a window's square is those of the two windows one row shorter,
    less what they share, and twice the product of its ends."""
    out = [np.einsum("ij,ij->i", x, x).astype(np.float64)]
    for k in range(2, longest + 1):
        shared = out[-2][1:-1] if k > 2 else 0.0
        out.append(out[-1][:-1] + out[-1][1:] - shared + 2.0 * np.einsum("ij,ij->i", x[: 1 - k], x[k - 1 :]))
    return [np.sqrt(np.maximum(s, 0)) for s in out]


def _table(space: Space) -> np.ndarray:
    """The axes and a last row of zeros, row by row in memory: the
    decomposition leaves them column by column, and then every look-up of
    rows would copy the whole table first."""
    return np.ascontiguousarray(np.vstack([space.axes, np.zeros((1, space.axes.shape[1]), np.float32)]))


def _search(words: DataFrame, space: Space, items: list[Item], cosine: float) -> DataFrame:
    queries = _queries(items, space)
    axes = _table(space)
    schema = "doc_id long, item_id long, word long, cosine double, shared double, answer double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        forget()
        for b in batches:
            ids, rows = b.column(0).to_pylist(), [np.frombuffer(x, "<u4") for x in b.column(1).to_pylist()]
            out = []
            for (r, k), places in sorted(_candidates(rows, queries, axes, cosine).items()):
                item, w = items[k], rows[r]
                for group in _near(sorted(places)):
                    first, end = group[0][0], max(p + n for p, n, _ in group)
                    near = w[max(0, first - len(item.words)) : end + len(item.words)].tolist()
                    leak, shared, answer = judge(item, near)
                    if leak:
                        place, _, best = max(group, key=lambda x: x[2])
                        out.append((ids[r], item.id, place, best, shared, answer))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.float64()) for i, c in enumerate(zip(*out, strict=True))], names)
        give_back()

    return words.mapInArrow(run, schema)


def _near(places: list) -> Iterator[list]:
    """Candidates whose starts lie within NEAR words."""
    group: list = []
    for x in places:
        if group and x[0] > group[0][0] + NEAR:
            yield group
            group = []
        group.append(x)
    if group:
        yield group


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that repeat no item. Rows are told
    apart by id; the ids to remove are a written table, which Spark sends out
    only if its size allows."""
    leaks = checkpoint(find_leaks(docs, benchmark, id_col=id_col, text_col=text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_leak")).distinct())
    return docs.join(leaks, F.coalesce(docs[f"`{id_col}`"].cast("long"), F.lit(NO_ID)) == leaks["_leak"], "left_anti")
