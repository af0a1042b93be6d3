"""Near-duplicate groups from bottom-k sketches of one hash function.

1. Each text becomes its set of hashed word shingles; the k smallest hashes
   are its sketch. Texts with equal sets are one node from here on.
2. Retained values form inverted lists. Two sets that are similar enough share
   a known number of retained values, so it suffices to list each sketch under
   its rarest values, as many as can be missed plus one (prefix filter):
   values of common passages hardly ever count.
3. Pairs from short lists are estimated on the k smallest values of the union
   of both sketches; what could still reach the threshold is verified on the
   full sets.
4. Long lists (large groups of copies, as a rule) would make very many pairs.
   Nodes that long lists connect form clusters; a cluster is cut into blocks of
   bounded size, and each pair of blocks is verified at once on the full sets,
   as a product of two incidence matrices. It answers with a spanning forest
   of its links: rows grow with the cluster, not with its pairs, and no task
   holds more than two blocks. No pair is dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, checkpoint, documents, give_back, id_out, memo, mix64, random_odd
from .graph import connected_components

SHINGLE = 5
SKETCH = 64
SHORT = 8  # lists up to this length form all their pairs
BLOCK = 200_000  # shingles in a block of a cluster
CELLS = 4_000_000  # of an incidence matrix at a time
HELD = 1_000_000  # shingles of earlier texts that a task keeps while it verifies
SIGMAS = 6  # the estimate may fall this many standard deviations short


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer words the whole
    sequence is one shingle, without words there is none. A-Z are lower-cased."""
    known = memo("word-hash", lambda: Memo(xxhash.xxh3_64_intdigest, 200_000))
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    width = min(size, n)
    out = np.full(n - width + 1, (size - width) * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
    for k, c in enumerate(random_odd(width, 40)):
        out += h[k : n - width + 1 + k] * c
    return np.unique(mix64(out))


def needed_overlap(n: int, k: int, similarity: float) -> int:
    """How many retained values a set of n shingles shares at least with any
    set that is similar enough. Up to k shingles it is exact: of the other
    set's values, at most what exceeds k can be missing. Beyond, the number
    follows a hypergeometric law and is taken SIGMAS deviations below its mean."""
    if n <= k:
        return max(1, min(math.ceil(similarity * max(n, m) - 1e-9) - max(0, m - k) for m in range(n, int(n / similarity) + 1)))
    union = n / similarity
    sigma = math.sqrt(k * similarity * (1 - similarity) * (union - k) / (union - 1))
    return max(1, math.floor(k * similarity - SIGMAS * sigma))


def _sketches(df: DataFrame, k: int, size: int) -> DataFrame:
    def run(batches):
        for b in batches:
            n, digests, sketches = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketches.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sketch"])
        give_back()

    return df.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def _lists(nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """(v, node, n, members): every sketch under its rarest values that others have too."""
    values = nodes.select("node", "n", F.explode("sketch").alias("v"))
    counts = values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    shared = values.join(counts, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("s"))  # k at most
    sizes = F.lit([needed_overlap(n, k, similarity) for n in range(1, 40 * k)])
    size = F.least("n", F.lit(k))
    overlap = F.get(sizes, (F.least("n", F.lit(40 * k - 1)) - 1).cast("int"))
    # what nobody else has comes first in the order and takes up places
    places = size - overlap + 1 - (size - F.size("s"))
    rows = shared.select("node", "n", F.explode(F.slice("s", 1, F.greatest(places, F.lit(0)).cast("int"))).alias("x")).select("node", "n", "x.v")
    return checkpoint(rows)


def _pairs(lists: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs a < b of fitting sizes from short lists."""
    c = F.col
    other = lists.select("v", F.struct("node", "n").alias("o"))
    p = lists.join(other, "v").where((c("node") < c("o.node")) & (c("n") >= similarity * c("o.n")) & (c("o.n") >= similarity * c("n")))
    return p.select(c("node").alias("a"), c("o.node").alias("b")).distinct()


def _matrix(lists: pa.ListArray, k: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows, filled up with values that no hash and no other side has."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.full((len(sizes), k), 2**64 - 1 - fill, np.uint64)
    out[np.arange(k) < sizes[:, None]] = lists.flatten().to_numpy().view(np.uint64)
    return out, sizes


def _estimated(pairs: DataFrame, nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b, estimate) of the pairs whose union sketch can still reach the threshold."""
    slack = SIGMAS * math.sqrt(similarity * (1 - similarity) / k)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x, m = _matrix(part.column(2), k, 0)
                y, n = _matrix(part.column(3), k, 1)
                both = np.sort(np.concatenate([x, y], axis=1), axis=1)
                same = both[:, 1:] == both[:, :-1]
                rank = np.arange(1, 2 * k) - np.cumsum(same, axis=1)  # of the distinct value, from 0 on
                exact = (part.column(4).to_numpy() <= k) & (part.column(5).to_numpy() <= k)
                size = np.where(exact, m + n - same.sum(axis=1), k)
                share = np.where(exact, same.sum(axis=1), (same & (rank < k)).sum(axis=1)) / np.maximum(size, 1)
                keep = share >= similarity - np.where(exact, 1e-9, slack)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(keep)) for c in part.columns[:2]), pa.array(share[keep])], ["a", "b", "estimate"])
        give_back()

    one = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("m"))
    two = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x"), "n")
    joined = pairs.join(one, "b").join(two, "a").select("a", "b", "x", "y", F.col("n").alias("m1"), F.col("m").alias("n1"))
    return checkpoint(joined.mapInArrow(run, "a long, b long, estimate double"))


def _verified(pairs: DataFrame, texts: DataFrame, share: tuple[int, int], size: int) -> DataFrame:
    """The pairs whose full sets fulfil share[1] * intersection >= share[0] * union."""
    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        known, held = {}, 0  # sets of texts seen before, up to a bound

        def words(packed: bytes) -> np.ndarray:
            nonlocal held
            found = known.get(packed)
            if found is None:
                found = shingle_set(unpress.decompress(packed), size)
                if held > HELD:
                    known.clear()
                    held = 0
                known[packed] = found
                held += len(found)
            return found

        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                left, right = words(x), words(y)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if share[1] * both >= share[0] * (len(left) + len(right) - both):
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64())).select(["a", "b"])
        known.clear()
        give_back()

    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a")
    return checkpoint(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _cluster_links(lists: DataFrame, texts: DataFrame, share: tuple[int, int], size: int) -> DataFrame:
    """Links (a, b) that connect whatever the full sets of long lists' members
    link: of every two blocks of a cluster, a spanning forest."""
    heads = lists.groupBy("v").agg(F.min("node").alias("b"))
    clusters = connected_components(lists.join(heads, "v").select(F.col("node").alias("a"), "b")).withColumnRenamed("component", "cluster")
    members = checkpoint(lists.select("node", "n").distinct().join(clusters, "node"))
    total = members.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.join(total, "cluster").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("node", "cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block").join(texts, "node")

    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        key, nodes, blocks, sets = None, [], [], []
        for b in batches:
            for node, cluster, lo, hi, block, packed in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (cluster, lo, hi) != key:
                    if key:
                        yield from _forest(key, nodes, blocks, sets, share)
                    key, nodes, blocks, sets = (cluster, lo, hi), [], [], []
                nodes.append(node)
                blocks.append(block)
                sets.append(shingle_set(unpress.decompress(packed), size))
        if key:
            yield from _forest(key, nodes, blocks, sets, share)
        del nodes, blocks, sets
        give_back()

    sorted_rows = placed.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "node")
    return checkpoint(sorted_rows.mapInArrow(run, "a long, b long"))


def _forest(key: tuple, nodes: list, blocks: list, sets: list, share: tuple[int, int]):
    """Spanning forest of the links between the two blocks (or inside the one) of a key."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # shingles of one member alone link nothing
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count[column] > 1
    row, column = row[shared], number[column[shared]]
    inside = np.array(blocks) == key[1]
    left = np.flatnonzero(inside)
    right = left if key[1] == key[2] else np.flatnonzero(~inside)
    both = np.zeros((len(left), len(right)), np.float32)
    width = max(64, CELLS // len(sets))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (lo, lo + width))
        m = np.zeros((len(sets), width), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        both += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None] - both
    linked = np.zeros((len(sets), len(sets)), bool)
    linked[np.ix_(left, right)] = share[1] * both >= share[0] * union
    linked |= linked.T
    waiting = np.ones(len(sets), bool)
    a, b = [], []
    for start in range(len(sets)):
        if waiting[start]:
            waiting[start] = False
            queue = [start]
            for u in queue:
                found = np.flatnonzero(linked[u] & waiting).tolist()
                waiting[found] = False
                queue += found
                a += [nodes[u]] * len(found)
                b += [nodes[x] for x in found]
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _packed(batches):
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress(t) for t in b.column(1).to_pylist()], pa.binary())], ["node", "packed"])


def near_duplicates(df: DataFrame, share: tuple[int, int] = (85, 100), k: int = SKETCH, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document row.

    Documents are linked if share[1] * |intersection| >= share[0] * |union| of
    their shingle sets; component_id is the smallest id that links reach, and
    kept marks it. Documents without words are linked with nothing; rows with
    one id are one document; missing ids count as one smallest id."""
    similarity = share[0] / share[1]
    docs = documents(df, id_col, text_col)
    sketches = checkpoint(_sketches(docs, k, size))
    nodes = checkpoint(sketches.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    heads = nodes.select("digest", "node")
    # an id with several different texts ties their nodes together
    several = sketches.where("n_shingles > 0").groupBy("doc_id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).where("d1 <> d2").select("doc_id")
    links = [checkpoint(sketches.join(several, "doc_id", "left_semi").join(heads, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))]

    lists = _lists(nodes, k, similarity)
    lengths = lists.groupBy("v").agg(F.count("*").alias("members")).where("members > 1")
    lists = checkpoint(lists.join(lengths, "v"))
    short, long = lists.where(F.col("members") <= SHORT), lists.where(F.col("members") > SHORT)
    pairs = _estimated(_pairs(short, similarity), nodes, k, similarity)
    seen = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(long.select("node")).distinct()
    texts = checkpoint(docs.mapInArrow(_packed, "node long, packed binary").join(seen, "node", "left_semi"))
    links += [_verified(pairs.select("a", "b"), texts, share, size), _cluster_links(long, texts, share, size)]
    groups = checkpoint(connected_components(_all(links)))

    out = sketches.select("doc_id", "n_shingles", "digest").join(heads, "digest", "left").join(groups, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    kept: Column = F.col("doc_id") == component
    return out.select(id_out().alias("doc_id"), "n_shingles", F.when(component != F.lit(-(2**63)), component).alias("component_id"), kept.alias("kept"))


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out
