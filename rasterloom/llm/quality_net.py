"""Quality by random-indexing word vectors and a small network.

A word's vector has two parts. Its form: every run of one to three bytes of
the word, ends marked, has a sparse random vector of signs; they are summed.
Its use: words within two places of it in any document of the corpus have
sparse random vectors of signs too; their sum over all documents, less the
mean of all words, says what the word stands among (random indexing). Words
share `BUCKETS` rows of the second table by hash, so the table has one size
however large the vocabulary.

Per document the vectors are pooled: mean, spread, and likeness of neighbours.
A network of two layers learns labels from the pooled vectors; a temperature
fitted on labelled documents that it did not learn from makes its answers
probabilities.

Word tables of tasks are summed in a tree, in slices, so no task reads more
than the square root of their number. Scores need one narrow pass. Null and
empty texts have no words: their pooled vectors are zeros, which have a score
like any others. Texts of any length are read whole, 50 000 words at a time.
Repeated rows are scored and counted each. An empty table gives an empty
table. Only the id and the text are read; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_runs, checkpoint, documents, hash_words, id_out, mix64, random_odd, slices, split

FORM, USE = 64, 32  # widths of the two parts of a word's vector
GRAMS = (1, 2, 3)
SIGNS = 4  # non-zero entries of a random vector
BUCKETS, SLICES = 1 << 13, 8
WINDOW = 2
STEP = 50_000  # words pooled at a time
POOLED = 2 * (FORM + USE) + 3
THRESHOLD = 0.7
CLIP = 5.0  # deviations that a scaled input is held to
_POWERS = random_odd(len(GRAMS), 11)


def fold(id_col) -> F.Column:
    """crc32 of the id as text, modulo 4. Rows of fold 2 are never learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def _entries(codes: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, sign) of the non-zero entries of the random vectors of 64-bit codes."""
    for k in range(SIGNS):
        part = codes >> np.uint64(16 * k)
        yield ((part >> np.uint64(1)) & np.uint64(width - 1)).astype(np.int64), 1.0 - 2.0 * (part & np.uint64(1)).astype(np.float64)


def forms(words: pa.Array) -> np.ndarray:
    """Vectors of length one for the forms of words."""
    flat, lengths = byte_runs(words)
    n = len(lengths)
    padded = np.ones(len(flat) + 2 * n, np.uint64)  # 1 marks both ends
    word = np.repeat(np.arange(n), lengths)
    padded[np.arange(len(flat)) + 2 * word + 1] = flat
    owner = np.repeat(np.arange(n), lengths + 2)
    total = np.zeros(n * FORM)
    code = np.zeros(len(padded), np.uint64)
    for g in GRAMS:
        code = code[: len(padded) - g + 1] + (padded[g - 1 :] + np.uint64(1)) * _POWERS[g - 1]
        whole = owner[: len(code)] == owner[g - 1 :]
        mixed = mix64(code[whole] ^ _POWERS[-g])
        base = owner[: len(code)][whole] * FORM
        for place, sign in _entries(mixed, FORM):
            total += np.bincount(base + place, sign, minlength=n * FORM)
    out = total.reshape(n, FORM)
    return (out / np.maximum(1e-9, np.sqrt((out * out).sum(1)))[:, None]).astype(np.float32)


def buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row of the table and code of the random vector of each word, cases and signs at its end apart."""
    code = hash_words(words)
    return (code % np.uint64(BUCKETS)).astype(np.int64), mix64(code.copy())


def uses(words: pa.Array, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the random vectors around the words of each row of the table, and in the last column their number."""
    bucket, random = buckets(words)
    table = np.bincount(bucket[codes] * (USE + 1) + USE, minlength=BUCKETS * (USE + 1)).astype(np.float64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for gap in range(1, WINDOW + 1):
        same = owner[gap:] == owner[:-gap]
        left, right = codes[:-gap][same], codes[gap:][same]
        for place, sign in _entries(random, USE):
            table += np.bincount(bucket[left] * (USE + 1) + place[right], sign[right], minlength=len(table))
            table += np.bincount(bucket[right] * (USE + 1) + place[left], sign[left], minlength=len(table))
    return table.reshape(BUCKETS, USE + 1)


def word_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Use vectors of all rows of the table, from all documents."""
    rows = BUCKETS // SLICES

    def emit(table):
        parts = [table[k * rows : (k + 1) * rows].astype(np.int64).tobytes() for k in range(SLICES)]
        n = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([n] * SLICES, pa.int32()), pa.array(parts, pa.binary())], ["slice", "part", "data"])

    def count(batches):
        table = None
        for b in slices(batches):
            found = uses(*split(b.column(1)))
            table = found if table is None else table + found
        if table is not None:
            yield emit(table)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column("slice").to_pylist(), b.column("data").to_pylist(), strict=True):
                x = np.frombuffer(data, np.int64)
                sums[k] = x + sums[k] if k in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "part", "data"])

    schema = "slice int, part int, data binary"
    read = documents(docs, id_col, text_col)
    parts = checkpoint(read.mapInArrow(count, schema))
    fan = int(np.ceil(np.sqrt(parts.where("slice = 0").count()))) or 1
    half = parts.repartition(fan * SLICES, "slice", F.col("part") % fan).mapInArrow(add, schema)
    table = np.zeros((SLICES, rows, USE + 1), np.float64)
    for r in half.repartition(SLICES, "slice").mapInArrow(add, schema).collect():  # SLICES rows of one size
        table[r["slice"]] += np.frombuffer(r["data"], np.int64).reshape(rows, USE + 1)
    return directions(table.reshape(BUCKETS, USE + 1))


def directions(table: np.ndarray) -> np.ndarray:
    """What sets a row's surroundings apart from those of all words, as vectors of length one at most; rare rows are shorter."""
    n, total = table[:, USE:], table[:, :USE]
    mean = total / np.maximum(1, n) - total.sum(0) / max(1, n.sum())
    size = np.sqrt((mean * mean).sum(1, keepdims=True))
    return (mean / np.maximum(1e-9, size) * n / (n + 5)).astype(np.float32)


def pooled(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """One row per text: mean and spread of its words' vectors, likeness of neighbours one and two places apart, and the size of the text."""
    words, codes, at = split(texts)
    n, width = len(at) - 1, FORM + USE
    out = np.zeros((n, POOLED))
    sizes = np.diff(at)
    out[:, -1] = np.log1p(sizes)
    if not len(codes):
        return out
    vectors = np.concatenate([forms(words), table[buckets(words)[0]]], axis=1)
    sums = np.zeros((n, 2 * width + 2))
    owner = np.repeat(np.arange(n), sizes)
    for lo in range(0, len(codes), STEP):
        hi = min(lo + STEP, len(codes))
        v = vectors[codes[lo : hi + 2]]  # with the next two, for neighbours
        own = owner[lo : hi + 2]
        begin = np.flatnonzero(np.r_[True, np.diff(own[: hi - lo]) > 0])
        rows = own[begin]
        sums[rows, :width] += np.add.reduceat(v[: hi - lo], begin, axis=0)
        for gap in (1, 2):
            pair = own[gap : hi - lo + gap] == own[: min(hi - lo, len(own) - gap)]
            a, b = v[: len(pair), :FORM], v[gap : gap + len(pair), :FORM]
            like = np.einsum("ij,ij->i", a, b) * pair
            sums[:, 2 * width + gap - 1] += np.bincount(own[: len(pair)], like, minlength=n)
        v *= v
        sums[rows, width : 2 * width] += np.add.reduceat(v[: hi - lo], begin, axis=0)
    times = np.maximum(1, sizes)[:, None]
    mean = sums[:, :width] / times
    out[:, :width] = mean
    out[:, width : 2 * width] = np.sqrt(np.maximum(0, sums[:, width : 2 * width] / times - mean**2))
    out[:, 2 * width : 2 * width + 2] = sums[:, 2 * width :] / np.maximum(1, sizes[:, None] - [1, 2])
    return out


@dataclass
class Network:
    """Two layers on scaled inputs, and the temperature of the answer."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        return np.maximum(0, z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def gradients(net: Network, z: np.ndarray, y: np.ndarray, decay: float) -> list:
    """Of the mean cross-entropy with weight decay, for w1, b1, w2, b2; z is scaled input."""
    h = np.maximum(0, z @ net.w1 + net.b1)
    g = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -500, 500))) - y) / len(y)
    back = np.outer(g, net.w2) * (h > 0)
    return [z.T @ back + decay * net.w1, back.sum(0), h.T @ g + decay * net.w2, g.sum()]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one temperature with the least cross-entropy, by golden section on its
    logarithm. Targets are a little short of 0 and 1, by the number of rows
    with that label, so rows that are told apart without fault don't make it 0."""
    ones = y.sum()
    aim = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))

    def loss(t):
        z = logits / np.exp(t)
        return (np.logaddexp(0, z) - aim * z).mean()

    lo, hi, ratio = np.log(0.05), np.log(100.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 64, rate: float = 3e-3, decay: float = 1e-3, seed: int = 1) -> Network:
    """Fit on four fifths of the rows, the temperature on the rest. With one
    label only, or none, every answer is the smoothed share of label 1."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    centre, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(d), np.ones(d))
    net = Network(centre, scale, rng.normal(size=(d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.normal(size=hidden) * np.sqrt(1 / hidden), 0.0)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        net.w2[:], net.b2 = 0, float(np.log(share / (1 - share)))
        return net
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2:
        held[:] = False
    z, t = np.clip((x[~held] - centre) / scale, -CLIP, CLIP), y[~held].astype(float)
    first, second, step = [0.0] * 4, [0.0] * 4, 0
    for epoch in range(epochs):
        order = rng.permutation(len(t))
        speed = rate * (1 - epoch / epochs)
        for at in range(0, len(t), batch):
            rows = order[at : at + batch]
            step += 1
            new = []
            for k, (w, g) in enumerate(zip((net.w1, net.b1, net.w2, net.b2), gradients(net, z[rows], t[rows], decay), strict=True)):
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                new.append(w - speed * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = new
    check = held if held.any() else ~held
    net.temperature = temperature(net.logits(x[check]), y[check].astype(float))
    return net


def vectors(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, vector) of every document."""

    def run(batches):
        for b in slices(batches):
            x = pooled(b.column(1), table).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, POOLED, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "vector"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, vector array<float>")


def fit(docs: DataFrame, labels: DataFrame, table: np.ndarray, most: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Train on a bounded sample of labelled documents outside fold 2.

    At most `most` documents, in an order that depends on a hash of the id
    alone; the pooled vectors are made where the texts are, so at most `most`
    rows of fixed size reach the driver (6 MB). Several labels of one id: the
    largest counts. Null labels are ignored."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.where(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most * 5 // 4)  # a margin for labels whose document is missing
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(picked), "doc_id")
    chosen = vectors(texts.drop("quality"), table).join(F.broadcast(picked), "doc_id")
    rows = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "vector").limit(most).toArrow()
    flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return train(flat.astype(float).reshape(-1, POOLED), rows.column("quality").to_numpy())


def score_documents(docs: DataFrame, table: np.ndarray, net: Network, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every document, whole texts."""

    def run(batches):
        for b in slices(batches):
            p = net.score(pooled(b.column(1), table))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int").withColumn("doc_id", id_out())
