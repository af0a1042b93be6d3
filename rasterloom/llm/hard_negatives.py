"""Hard negatives by segment summary filtering.

A vector is cut into segments; of each the mean m and the deviation s (the
norm of what is left after the mean) are kept. The inner product of two
segments of length n lies in n m m' -+ s s', so sums over segments bound a
score. A pair is looked at in four segments first, in sixteen if it is still
in question, and only then is its exact score computed. A whole block of rows
is passed over when the range of its summaries already rules it out.

How it runs: rows are sorted by label and signs of segment means and written
as packed blocks. The queries (anchors) are packed into tiles; every tile
meets every group of blocks in one task, which streams the blocks past the
tile and keeps the best few of each anchor. Best lists of the groups are
merged by (anchor), so no task depends on the frequency of a label. Two such
passes: one finds each anchor's positives, one its negatives, whose windows of
scores follow from the positives.

Rows with a null label, a null vector, or any null or non-finite component
take no part. Components are floor(scale * x), held to +-2^24; a shorter
vector counts as filled up with zeros. A row with a null id is a row like any
other, ordered before all ids; an empty vector scores 0 with everything. Rows
that repeat an id, label and vector are rows of their own: each is an anchor,
and another copy may be its positive. Other columns are ignored. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, bounded_batches, checkpoint, id_out, pack, partitions, unpack

BLOCK, STEP = 2048, 2048  # rows of a block; anchors compared with it at a time
LEVELS = (4, 16)
LIMIT = 1 << 24
NONE, NO_ROW = -(1 << 62), (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Packed:
    """Rows side by side: keys, ids, labels, vectors, and their summaries."""

    def __init__(self, keys, ids, labels, vectors):
        self.keys, self.ids, self.labels = keys, ids, labels
        width = -(-max(1, vectors.shape[1]) // LEVELS[-1]) * LEVELS[-1]
        self.vectors = np.zeros((len(ids), width), vectors.dtype)
        self.vectors[:, : vectors.shape[1]] = vectors
        self.most = int(np.abs(self.vectors).max(initial=0))

    def summaries(self) -> None:
        """Scaled means and deviations of every level, so that products are plain inner products."""
        x = self.vectors.astype(np.float64)
        self.norm = np.sqrt((x * x).sum(1))
        self.mean, self.deviation = [], []
        for n in LEVELS:
            parts = x.reshape(len(x), n, -1)
            mean = parts.mean(2)
            self.mean.append((mean * np.sqrt(parts.shape[2])).astype(np.float32))
            self.deviation.append(np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2)).astype(np.float32))

    def widen(self, width: int) -> None:
        if width > self.vectors.shape[1]:
            self.vectors = np.pad(self.vectors, ((0, 0), (0, width - self.vectors.shape[1])))

    def data(self) -> bytes:
        small = np.int16 if self.most < 1 << 15 else np.int32
        return pack(self.keys, self.ids, self.labels, np.array([self.vectors.shape[1]], np.int64), np.array([small == np.int16], np.int64)) + pack(self.vectors.astype(small))

    @staticmethod
    def read(data: bytes) -> Packed:
        *head, width, small = unpack(data, "<i8", "<i8", "<i8", "<i8", "<i8")
        at = sum(x.nbytes for x in head) + 16 + 5 * 8
        (flat,) = unpack(data[at:], "<i2" if small[0] else "<i4")
        return Packed(*head, flat.reshape(-1, int(width[0])))

    @staticmethod
    def joined(parts: list[Packed]) -> Packed:
        width = max(p.vectors.shape[1] for p in parts)
        for p in parts:
            p.widen(width)
        return Packed(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("keys", "ids", "labels", "vectors")))

    def picked(self, rows: np.ndarray) -> Packed:
        return Packed(self.keys[rows], self.ids[rows], self.labels[rows], self.vectors[rows])


def prepared(df: DataFrame, scale: int, anchor: Column, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, anchor, code, vector array<int>) of the rows that take part."""
    v, x = F.col(f"`{vector_col}`"), F.col("vector")
    fine = F.forall(v, lambda y: y.isNotNull() & ~F.isnan(y.cast("double")) & (F.abs(y.cast("double")) < float("inf")))
    held = F.transform(v, lambda y: F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(y.cast("double") * scale).cast("double"))).cast("int"))
    rows = df.where(F.col(f"`{label_col}`").isNotNull() & v.isNotNull() & fine).select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), held.alias("vector"),
    )
    step = F.greatest(F.lit(1), F.ceil(F.size(x) / 8).cast("int"))
    total = lambda i: F.aggregate(F.slice(x, i * step + 1, step), F.lit(0).cast("long"), lambda a, y: a + y)
    code = sum((F.when(total(i) > 0, 1 << (7 - i)).otherwise(0) for i in range(8)), F.lit(0))
    return rows.withColumn("code", code)


def _blocks(rows: DataFrame, groups: int) -> DataFrame:
    """Blocks of like rows, written: (group, data, anchors data of the block)."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                s = b.slice(at, BLOCK)
                lists = s.column("vector").combine_chunks() if isinstance(s.column("vector"), pa.ChunkedArray) else s.column("vector")
                sizes = np.diff(lists.offsets.to_numpy())
                vectors = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int32)
                vectors[np.arange(vectors.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
                keys = (np.int64(part) << np.int64(40)) + np.arange(n, n + len(sizes))
                n += len(sizes)
                p = Packed(keys, s.column("id").to_numpy(), s.column("label").to_numpy(), vectors)
                chosen = np.flatnonzero(s.column("anchor").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([p.data()], pa.binary()), pa.array([p.picked(chosen).data() if len(chosen) else None], pa.binary()), pa.array([len(chosen)], pa.int64())], ["group", "data", "anchors", "n"])

    sorted_rows = rows.repartitionByRange(groups, "label", "code", "id").sortWithinPartitions("label", "code", "id")
    return checkpoint(sorted_rows.mapInArrow(run, "group int, data binary, anchors binary, n long"))


def _tiles(blocks: DataFrame, tiles: int) -> DataFrame:
    """Anchors of all blocks in `tiles` packs: (tile, data)."""

    def run(batches):
        parts = [Packed.read(x) for b in batches for x in b.column(0).to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([Packed.joined(parts).data()], pa.binary())], ["tile", "data"])

    # keys say where the anchors were, so neighbours share a tile
    found = blocks.where("anchors IS NOT NULL").select("anchors", "group", F.monotonically_increasing_id().alias("at"))
    return checkpoint(found.repartitionByRange(tiles, "group", "at").select("anchors").mapInArrow(run, "tile int, data binary"))


def merge(scores: np.ndarray, ids: np.ndarray, a: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
    """Put candidates (row, score, id) into the best lists of the rows; higher scores first, then smaller ids."""
    if not len(a):
        return
    k = scores.shape[1]
    rows = np.unique(a)
    a = np.concatenate([np.repeat(rows, k), a])
    s, i = np.concatenate([scores[rows].ravel(), s]), np.concatenate([ids[rows].ravel(), i])
    order = np.lexsort((i, -s, a))
    a, s, i = a[order], s[order], i[order]
    begin = np.searchsorted(a, rows)
    take = (begin[:, None] + np.arange(k)).ravel()
    scores[rows], ids[rows] = s[take].reshape(-1, k), i[take].reshape(-1, k)


class Tile:
    """Anchors with the scores that may still matter to them: from `least` to `most`."""

    def __init__(self, anchors: Packed, same: bool):
        anchors.summaries()
        self.a, self.same = anchors, same
        n = len(anchors.ids)
        self.least, self.most = np.full(n, float(NONE)), np.full(n, np.inf)
        self.counts = np.zeros(4, np.int64)  # pairs, and those left after each level and the exact score

    def candidates(self, block: Packed) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, row, score) of the pairs that no bound rules out."""
        width = max(self.a.vectors.shape[1], block.vectors.shape[1])
        if width != block.vectors.shape[1] or width != self.a.vectors.shape[1]:
            block.widen(width)
            if width != self.a.vectors.shape[1]:
                self.a.widen(width)
                self.a.summaries()
        block.summaries()
        largest = block.norm.max(initial=0)
        mean, dev = block.mean[0], block.deviation[0]
        lo, hi, top = mean.min(0), mean.max(0), dev.max(0)
        bound = np.maximum(self.a.mean[0], 0) @ hi + np.minimum(self.a.mean[0], 0) @ lo + self.a.deviation[0] @ top
        slack = 1e-4 * self.a.norm * largest + 1
        alive = (bound + slack >= self.least) & (self.least <= self.most)
        one = block.labels[0] == block.labels[-1] and (block.labels == block.labels[0]).all()
        if one:
            alive &= (self.a.labels == block.labels[0]) == self.same
        alive = np.flatnonzero(alive)
        for at in range(0, len(alive), STEP):
            yield from self._pairs(alive[at : at + STEP], block, slack, one)

    def _pairs(self, rows: np.ndarray, block: Packed, slack: np.ndarray, one: bool):
        a, least = self.a, (self.least[rows] - slack[rows])
        most = self.most[rows] + slack[rows]
        open_above = np.isinf(most).all()
        self.counts[0] += len(rows) * len(block.ids)
        mask, pairs = None, None
        for level in range(len(LEVELS)):
            m, s, bm, bs = a.mean[level][rows], a.deviation[level][rows], block.mean[level], block.deviation[level]
            if pairs is None:
                middle, reach = m @ bm.T, s @ bs.T
                keep = middle + reach >= least[:, None]
                if not open_above:
                    keep &= middle - reach <= most[:, None]
                mask = keep if mask is None else mask & keep
                if level == 0 and not one:
                    mask &= (a.labels[rows][:, None] == block.labels) == self.same
                left = np.count_nonzero(mask)
            else:
                i, j = pairs
                middle, reach = np.einsum("ij,ij->i", m[i], bm[j]), np.einsum("ij,ij->i", s[i], bs[j])
                keep = (middle + reach >= least[i]) & (middle - reach <= most[i])
                pairs = i[keep], j[keep]
                left = len(pairs[0])
            self.counts[level + 1] += left
            if not left:
                return
            if pairs is None and left * 16 < mask.size:
                pairs = np.nonzero(mask)
        size = a.most * block.most * a.vectors.shape[1]
        kind = np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64
        x, y = a.vectors[rows].astype(kind), block.vectors.astype(kind)
        if pairs is None:
            exact = x @ y.T
            mask &= (exact >= self.least[rows][:, None]) & (exact <= self.most[rows][:, None])
            best = self.k + 1  # with the anchor itself
            if self.same and best * 4 < len(block.ids):  # no more than the best of the block can matter
                shown = np.where(mask, exact, exact.dtype.type(NONE))
                mask &= exact >= np.partition(shown, -best, axis=1)[:, -best, None]
            i, j = np.nonzero(mask)
            score = exact[i, j]
        else:
            i, j = pairs
            score = np.concatenate([np.einsum("ij,ij->i", x[i[at : at + 65_536]], y[j[at : at + 65_536]]) for at in range(0, len(i), 65_536)])
        score = score.astype(np.int64)
        keep = (score >= self.least[rows][i]) & (score <= self.most[rows][i])
        self.counts[3] += np.count_nonzero(keep)
        yield rows[i[keep]], j[keep], score[keep]


class Positives(Tile):
    """The best rows of the anchor's own label, without itself."""

    def __init__(self, anchors: Packed, k: int):
        super().__init__(anchors, True)
        self.k = k
        self.scores, self.ids = np.full((len(anchors.ids), k), NONE), np.full((len(anchors.ids), k), NO_ROW)

    def see(self, block: Packed) -> None:
        for a, j, s in self.candidates(block):
            other = self.a.keys[a] != block.keys[j]
            merge(self.scores, self.ids, a[other], s[other], block.ids[j[other]])
            rows = np.unique(a)
            self.least[rows] = self.scores[rows, -1]

    def rows(self) -> list:
        a, j = np.nonzero(self.scores != NONE)
        return [self.a.keys[a], self.a.ids[a], self.ids[a, j], self.scores[a, j]]


class Negatives(Tile):
    """The best rows of other labels in the window of each positive."""

    def __init__(self, anchors: Packed, positives: list[np.ndarray], k: int, window: tuple[int, int, int]):
        super().__init__(anchors, False)
        key, place, ids, scores = positives
        n, width = len(anchors.ids), int(place.max(initial=0)) + 1
        self.k = k
        self.positive, self.positive_id = np.full((n, width), NONE), np.zeros((n, width), np.int64)
        order = np.argsort(anchors.keys)
        at = order[np.searchsorted(anchors.keys[order], key)]
        self.positive[at, place], self.positive_id[at, place] = scores, ids
        whole, low, high = window
        some = self.positive != NONE
        self.low = np.where(some, -((-low * self.positive) // whole), 1 << 62).astype(np.float64)
        self.high = np.where(some, (high * self.positive) // whole, NONE).astype(np.float64)
        self.low[self.low > self.high] = np.inf
        self.high[np.isinf(self.low)] = -np.inf
        self.scores, self.ids = np.full((n * width, k), NONE), np.full((n * width, k), NO_ROW)
        self.width = width
        self._narrow(np.arange(n))

    def _narrow(self, rows: np.ndarray) -> None:
        self.least[rows], self.most[rows] = self.low[rows].min(1), self.high[rows].max(1)

    def see(self, block: Packed) -> None:
        for a, j, s in self.candidates(block):
            for p in range(self.width):
                fits = (s >= self.low[a, p]) & (s <= self.high[a, p])
                at = a[fits] * self.width + p
                merge(self.scores, self.ids, at, s[fits], block.ids[j[fits]])
                rows = np.unique(a[fits])
                # a full list raises what a row must score to matter
                last = self.scores[rows * self.width + p, -1]
                self.low[rows, p] = np.maximum(self.low[rows, p], last)
            self._narrow(np.unique(a))

    def rows(self) -> list:
        at, j = np.nonzero(self.scores != NONE)
        a, p = np.divmod(at, self.width)
        return [self.a.keys[a], p, self.a.ids[a], self.positive_id[a, p], self.positive[a, p], self.ids[at, j], self.scores[at, j]]


def _meet(blocks: DataFrame, tiles: DataFrame, positives: DataFrame | None, groups: int, n_tiles: int, make, schema: str) -> DataFrame:
    """Every tile against every group of blocks, one task each."""
    c = F.col
    first = tiles.select(c("tile"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("kind"), "data")
    both = first
    if positives is not None:
        both = both.unionByName(positives.select(c("tile"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), "data"))
    both = both.unionByName(blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("tile"), "group", F.lit(2).alias("kind"), "data"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        now = tile = anchors = None
        found: list = []

        def results():
            if tile is None:
                return
            columns = tile.rows()
            for at in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000], pa.int64()) for x in columns], names)

        for b in batches:
            for k in range(b.num_rows):
                slot, kind, data = (b.column(0)[k].as_py(), b.column(1)[k].as_py()), b.column(2)[k].as_py(), b.column(3)[k].as_py()
                if slot != now:
                    yield from results()
                    now, tile, anchors, found = slot, None, None, []
                if kind == 0:
                    anchors = Packed.read(data)
                elif kind == 1:
                    found.append(unpack(data, "<i8", "<i8", "<i8", "<i8"))
                elif anchors is not None:
                    if tile is None:
                        tile = make(anchors, [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 4)
                    tile.see(Packed.read(data))
        yield from results()

    return both.repartitionByRange(groups * n_tiles, "tile", "group").sortWithinPartitions("tile", "group", "kind").mapInArrow(run, schema)


def _pack_positives(found: DataFrame, tiles: DataFrame) -> DataFrame:
    """Positives of each tile in packs of bounded size: (tile, data)."""

    def keys(batches):
        for b in batches:
            for tile, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = Packed.read(data).keys
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), tile, np.int32)), pa.array(k)], ["tile", "key"])

    def run(batches):
        for b in batches:
            tile = b.column(0).to_numpy()
            for t in np.unique(tile):
                r = tile == t
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([pack(*(b.column(i).to_numpy()[r] for i in range(1, 5)))], pa.binary())], ["tile", "data"])

    of = tiles.mapInArrow(keys, "tile int, key long")
    rows = found.join(of, "key").select("tile", "key", "place", "positive_id", "positive_score")
    return rows.repartition("tile").mapInArrow(run, "tile int, data binary")


def mine(df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int, int] = (100, 50, 95), scale: int = 256,
         tile: int = 200_000, group: int = 2_000_000, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` says which rows ask. An anchor's positives are its `positives`
    best other rows of the same label; for each, the `negatives` best rows of
    other labels whose score n has low * positive <= whole * n <= high *
    positive, with window = (whole, low, high). Every anchor is compared with every row;
    a task holds one tile of about `tile` anchors and one block of rows. Rows are
    dealt into groups of at most about `group` rows, two dozen at least where
    there are as many partitions. Work is anchors times rows, thinned by the
    bounds: each further level is computed for pairs that are left."""
    bounded_batches(df.sparkSession)
    rows = prepared(df, scale, anchor, id_col, label_col, vector_col)
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("anchor"), 1))).first()
    groups = max(min(partitions(df.sparkSession), 24, -(-n // BLOCK) or 1), -(-n // group))
    n_tiles = max(1, -(-asked // tile))
    blocks = _blocks(rows, groups)
    tiles = _tiles(blocks, n_tiles)
    data = blocks.select("group", "data")
    best = _meet(data, tiles, None, groups, n_tiles, lambda a, _: Positives(a, positives), "key long, anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")) - 1
    best = checkpoint(best.withColumn("place", place.cast("long")).where(F.col("place") < positives))
    names = "key long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _meet(data, tiles, _pack_positives(best, tiles), groups, n_tiles, lambda a, p: Negatives(a, p, negatives, window), names)
    rank = F.row_number().over(W.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives)
    return found.select(id_out("anchor_id").alias("anchor_id"), id_out("positive_id").alias("positive_id"), "rank", id_out("negative_id").alias("negative_id"), "positive_score", "negative_score")
