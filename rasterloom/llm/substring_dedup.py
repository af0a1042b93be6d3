"""Removal of repeated word windows by fixed-block anchors.

A window of `window` words contains a whole block of `window // 2` words of
any reference, wherever the reference is cut. So non-overlapping blocks of
every document are indexed, every rolling block-sized window probes the
index, and a hit is extended: all windows around it are candidates, whose
full fingerprints meet in one place, where the earliest keeps its words.
Neighbouring windows that repeat merge into maximal repeats.

Nothing is emitted per pair: equal fingerprints meet once per text block,
which has already reduced its own copies, so a passage in a third of all
documents costs one entry for each two megabytes of text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .blocks import ASK, TELL, Block, answer, ask, by_bucket, finish, make_blocks, planes, unplanes
from .common import Memo, id_out, memo, mix64, pack, random_odd, unpack

WINDOW = 20


def _words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of a block, and how many words each document has."""
    known = memo("word-hash", lambda: Memo(xxhash.xxh3_64_intdigest, 200_000))
    parts, counts = [], []
    for _, _, text in block.documents():
        words = text.split()
        counts.append(len(words))
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(counts, np.int64)


def _rolling(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of the n words from every place, across document borders too."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k, c in enumerate(random_odd(n, seed)):
        out += words[k : k + len(out)] * c
    return mix64(out)


def _fits(counts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Places where n words of one document begin."""
    ends = np.repeat(np.cumsum(counts), counts)
    return np.flatnonzero(np.arange(total) + n <= ends)


def _probe(window: int):
    size = window // 2

    def speak(block: Block, told: list, n: int):
        words, counts = _words(block)
        places = _fits(counts, size, len(words))
        if not len(places):
            return
        firsts = np.repeat(np.cumsum(counts) - counts, counts)
        is_ref = (places - firsts[places]) % size == 0
        h = _rolling(words, size, 10)[places]
        order = np.argsort(h, kind="stable")
        head = np.r_[True, h[order][1:] != h[order][:-1]]
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(head) - 1
        many = np.bincount(group) > 1
        refs = np.bincount(group, is_ref) > 0
        # a probe that meets a reference of the same block is a hit already
        hit = (many & refs)[group]
        if hit.any():
            yield block.number % n, TELL, pack(planes(places[hit].astype(np.uint32)))
        # one entry speaks for all equal windows of the block; 1: reference, 2: several
        first = order[head]
        first.sort()
        flag = (refs + 2 * many).astype(np.uint8)[group[first]]
        # several windows without a reference here may meet one elsewhere: each of them asks
        lone = np.flatnonzero((many & ~refs)[group])
        asking = np.union1d(first, lone)
        flags = np.zeros(len(h), np.uint8)
        flags[lone] = 2
        flags[first] = flag
        a = h[asking]
        for bucket, i in by_bucket((a % np.uint64(n)).astype(np.int64), n):
            yield bucket, ASK, pack((a[i] >> np.uint64(32)).astype(np.uint32), planes(places[asking[i]].astype(np.uint32)), flags[asking[i]])

    return speak


def _index(rows):
    """Entries whose block content is indexed somewhere and occurs more than once."""
    parts = [unpack(data, "<u4", "u1", "u1") for _, data in rows]
    check = np.concatenate([p[0] for p in parts])
    flag = np.concatenate([p[2] for p in parts])
    _, group = np.unique(check, return_inverse=True)
    count = np.bincount(group) + np.bincount(group, flag >= 2)
    hit = ((count > 1) & (np.bincount(group, flag & 1) > 0))[group] & (flag != 3)
    at = 0
    for (block, _), p in zip(rows, parts, strict=True):
        mine = hit[at : at + len(p[0])]
        at += len(p[0])
        if mine.any():
            yield block, pack(planes(unplanes(p[1], "<u4")[mine]))


def _extend(window: int):
    size = window // 2

    def speak(block: Block, told: list, n: int):
        if not told:
            return
        words, counts = _words(block)
        hits = np.zeros(len(words) + 1, np.int64)
        for data in told:
            hits[unplanes(unpack(data, "u1")[0], "<u4")] = 1
        before = np.r_[0, np.cumsum(hits)]
        places = _fits(counts, window, len(words))
        places = places[before[places + window - size + 1] > before[places]]
        if not len(places):
            return
        doc = np.repeat(np.arange(len(counts)), counts)[places]
        start = places - (np.cumsum(counts) - counts)[doc]
        ids = block.ids[doc]
        h, h2 = _rolling(words, window, 20)[places], _rolling(words, window, 21)[places]
        # the earliest (id, start) of equal windows asks for itself, later ones go in any case
        order = np.lexsort((start, ids, h2, h))
        head = np.r_[True, (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])]
        lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        later = (ids[order] != ids[lead]) | (start[order] != start[lead])
        if later.any():
            yield block.number % n, TELL, pack(planes(np.sort(places[order[later]]).astype(np.uint32)))
        mine = np.sort(order[~later])
        for bucket, i in by_bucket((h2[mine] % np.uint64(n)).astype(np.int64), n):
            k = mine[i]
            yield bucket, ASK, pack(h[k], planes(places[k].astype(np.uint32)), planes(ids[k]), planes(start[k].astype(np.uint32)))

    return speak


def _earliest(rows):
    """Places of windows that also start earlier."""
    parts = [unpack(data, "<u8", "u1", "u1", "u1") for _, data in rows]
    h = np.concatenate([p[0] for p in parts])
    ids = np.concatenate([unplanes(p[2], "<i8") for p in parts])
    start = np.concatenate([unplanes(p[3], "<u4") for p in parts])
    order = np.lexsort((start, ids, h))
    head = np.r_[True, h[order][1:] != h[order][:-1]]
    lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    gone = np.zeros(len(h), bool)
    gone[order] = (ids[order] != ids[lead]) | (start[order] != start[lead])
    at = 0
    for (block, _), p in zip(rows, parts, strict=True):
        mine = gone[at : at + len(p[0])]
        at += len(p[0])
        if mine.any():
            yield block, pack(planes(unplanes(p[1], "<u4")[mine]))


def _kept(window: int, with_text: bool):
    def conclude(block: Block, told: list):
        counts = [len(t.split()) for _, _, t in block.documents()]
        total = sum(counts)
        edge = np.zeros(total + window + 1, np.int64)
        for data in told:
            np.add.at(edge, (p := unplanes(unpack(data, "u1")[0], "<u4").astype(np.int64)), 1)
            np.add.at(edge, p + window, -1)
        gone = np.cumsum(edge)[:total] > 0
        at = 0
        for (doc, _, text), n in zip(block.documents(), counts, strict=True):
            mine = gone[at : at + n]
            at += n
            words, removed = text.split(), int(mine.sum())
            kept = b" ".join([w for w, x in zip(words, mine.tolist(), strict=True) if not x] if removed else words)
            yield (doc, n, removed, kept) if with_text else (doc, n, removed, hashlib.sha256(kept).hexdigest())

    return conclude


def remove_repeats(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every document, without the words
    covered by a window whose words also start earlier: in a document with a
    smaller id, or in the same one (the same id) further left. Windows are
    judged on the input. Kept words are joined by one space; with `digest`
    their SHA-256 (`kept_sha256`) stands for them.

    Texts without a whole window (null and empty ones too) keep their words.
    Two rows with the same id and the same start count as one place. Windows
    are compared by a 64-bit hash inside the bucket of a second hash."""
    blocks = make_blocks(df, id_col, text_col)
    hits = answer(ask(blocks, _probe(window)), _index)
    gone = answer(ask(blocks, _extend(window), hits), _earliest)
    last = "kept_sha256 string" if digest else "text binary"
    out = finish(blocks, gone, f"doc_id long, n_words long, n_removed long, {last}", _kept(window, not digest), [pa.int64()] * 3 + [pa.string() if digest else pa.binary()])
    if not digest:
        out = out.withColumn("text", out["text"].cast("string"))
    return out.withColumn("doc_id", id_out())
