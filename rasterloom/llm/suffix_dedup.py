"""Removal of repeated byte strings with sorted suffixes.

Suffixes that may repeat are brought together by content and sorted in two
stages: only suffixes smaller than their successor (their first byte is not
larger than the next) are sorted directly; a suffix that is larger than its
successor is put in place by scanning the buckets of first bytes in order.
Adjacent common prefixes then give the groups of equal `length`-byte strings,
and the smallest document id of a group keeps it.

Content partitioning: every string of `length` bytes is named by the smallest
hash among its 20-byte pieces, its anchor. Equal strings have equal anchors.
A first exchange finds anchors that occur more than once; only strings with
such anchors travel, together with their neighbours of the same anchor as one
fragment. A text block sends equal fragments once, and a bucket keeps one of
equal fragments before it sorts: a dictionary takes out whole copies, the
sort decides among fragments that differ but share strings. A bucket is
sorted in PARTS parts, by anchor, one after the other.

Null and empty texts and texts under `length` bytes stay as they are; a text
larger than a block is a block of its own; rows that repeat an id are one
document to each other; a missing id is the smallest; other columns are not
read (or carried along unread); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import ASK, TELL, Block, answer, ask, by_bucket, finish, finish_rows, make_blocks, planes, unplanes
from .common import forget, id_out, mix64, pack, random_odd, unpack

LENGTH = 50
PIECE = 20
SEGMENT = 1 << 18
PARTS = 8  # a bucket's strings are sorted in so many parts, one after the other
_FIRST = np.array([1 << 8 * k for k in range(8)], np.uint64)


def two_stage_suffix_array(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes of `text` (bytes) in order of their first `depth` bytes at least.

    A suffix with text[i] > text[i+1] is larger than its successor; all other
    suffixes are sorted directly. Ties up to the depth stay adjacent. The end
    of the text is smaller than any byte."""
    n = len(text)
    if not len(wanted):
        return wanted
    ahead = np.zeros(n + 1, np.int16)
    ahead[:n] = text.astype(np.int16) + 1
    larger = ahead[:n] > ahead[1:]
    # induced suffixes need their successors, down to one that is sorted directly
    need = np.zeros(n + 1, bool)
    need[wanted] = True
    chain = wanted[larger[wanted]] + 1
    while len(chain):
        chain = chain[~need[chain]]
        need[chain] = True
        chain = chain[chain < n]
        chain = chain[larger[chain]] + 1
    direct = np.flatnonzero(need[:n] & ~larger)
    direct = _sort_directly(text, direct, depth)
    induced = need.copy()
    induced[:n] &= larger
    induced[n] = False
    first = ahead[direct]
    edges = np.searchsorted(first, np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(258)]

    def scan(part: np.ndarray) -> None:
        """Hand the induced predecessors of a sorted run to their buckets."""
        before = part[part > 0] - 1
        before = before[induced[before]]
        if len(before):
            symbol = ahead[before].astype(np.uint16)
            order = np.argsort(symbol, kind="stable")
            s = symbol[order]
            cuts = np.flatnonzero(np.diff(s)) + 1
            for k, piece in zip(s[np.r_[0, cuts]].tolist(), np.split(before[order], cuts), strict=True):
                waiting[k].append(piece)

    out = []
    if need[n]:
        scan(np.array([n]))
    for c in range(1, 257):
        # larger than its successor: the second byte is smaller, so these precede the bucket's others
        for part in (*waiting[c], direct[edges[c] : edges[c + 1]]):
            if len(part):
                scan(part)
                out.append(part)
    order = np.concatenate(out) if out else wanted[:0]
    keep = np.zeros(n + 1, bool)
    keep[wanted] = True
    return order[keep[order]]


def _words_at(padded: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Eight bytes from every place as a number whose order is theirs."""
    out = np.zeros(len(places), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[places + k]
    return out


def _sort_directly(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Sort by the first `depth` bytes, eight at a time; only ties go on."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    key = _words_at(padded, places)
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    tied, at = np.zeros(len(places), bool), 8
    same = key[1:] == key[:-1]
    group = np.r_[0, np.cumsum(~same)]
    while at < depth and same.any():
        tied[:] = False
        tied[1:] |= same
        tied[:-1] |= same
        i = np.flatnonzero(tied)
        key = _words_at(padded, places[i] + at)
        o = np.lexsort((key, group[i]))
        places[i] = places[i][o]
        key, g = key[o], group[i]
        new = np.r_[True, (key[1:] != key[:-1]) | (g[1:] != g[:-1])]
        # groups keep their order; new borders are counted over all suffixes
        border = np.ones(len(places), bool)
        border[1:] = ~same
        border[i] |= new
        same = ~border[1:]
        group = np.cumsum(border) - 1
        at += 8
    return places


def adjacent_common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of what each suffix of a sorted list has in common with the one before it, up to `depth` bytes."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    left, right = order[:-1], order[1:]
    out = np.zeros(len(left), np.int64)
    i = np.arange(len(left))
    for at in range(0, depth, 8):
        apart = _words_at(padded, left[i] + at) ^ _words_at(padded, right[i] + at)
        alike = apart == 0
        # bytes before the first that differs, of eight
        k = np.searchsorted(_FIRST, apart[~alike], side="right")
        out[i[~alike]] = at + 8 - k
        i = i[alike]
        out[i] = at + 8
    ends = len(text) - np.maximum(left, right)  # a text's end is part of no prefix
    return np.minimum(np.minimum(out, depth), ends)


# ------------------------------------------------------------------ anchors

def _anchors(data: np.ndarray, starts_fit: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor hash) of every run of consecutive
    fitting starts whose strings have the same anchor."""
    pieces = length - PIECE + 1
    c = random_odd(3, 30)
    firsts, counts, hashes = [], [], []
    total = len(data)
    for lo in range(0, max(0, total - length + 1), SEGMENT):
        hi = min(total, lo + SEGMENT + length - 1)
        part = data[lo:hi].astype(np.uint64)
        w = part.copy()
        for k in (1, 2, 4):
            w = w[:-k] | (w[k:] << np.uint64(8 * k))
        m = len(part) - PIECE + 1
        h = mix64(w[:m] * c[0] + w[8 : m + 8] * c[1] + w[12 : m + 12] * c[2])
        # smallest of `pieces` neighbouring hashes; the leftmost among equal ones
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(m, dtype=np.uint64)
        size = 1
        low = key
        while size * 2 <= pieces:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        rest = pieces - size
        if rest:
            low = np.minimum(low[: len(low) - rest], low[rest:])
        fit = starts_fit[lo : lo + len(low)]
        start = np.flatnonzero(fit[: min(SEGMENT, len(low))])
        if not len(start):
            continue
        place = (low[start] & np.uint64(0xFFFFFF)).astype(np.int64)
        new = np.r_[True, (np.diff(start) != 1) | (place[1:] != place[:-1])]
        head = np.flatnonzero(new)
        firsts.append(start[head] + lo)
        counts.append(np.diff(np.r_[head, len(start)]))
        hashes.append(h[place[head]])
    if not firsts:
        e = np.empty(0, np.int64)
        return e, e, e.astype(np.uint64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(hashes)


def _fragments(block: Block, length: int):
    data = np.frombuffer(block.text, np.uint8)
    ends = np.cumsum(block.lengths)
    fit = np.zeros(len(data), bool)
    for lo, hi in zip((ends - block.lengths).tolist(), ends.tolist(), strict=True):
        fit[lo : max(lo, hi - length + 1)] = True
    return _anchors(data, fit, length)


def _seen(length: int):
    def speak(block: Block, told: list, n: int):
        forget()
        first, _, h = _fragments(block, length)
        if not len(first):
            return
        _, group, count = np.unique(h, return_inverse=True, return_counts=True)
        many = (count > 1)[group]
        # anchors that recur in the block are known; one entry tells the others
        if many.any():
            yield block.number % n, TELL, pack(planes(first[many].astype(np.uint32)))
        lead = np.zeros(len(h), bool)
        lead[np.unique(group, return_index=True)[1]] = True
        i = np.flatnonzero(lead)
        for bucket, k in by_bucket((h[i] % np.uint64(n)).astype(np.int64), n):
            j = i[k]
            yield bucket, ASK, pack((h[j] >> np.uint64(32)).astype(np.uint32), planes(first[j].astype(np.uint32)), many[j].astype(np.uint8))

    return speak


def _recurring(rows):
    forget()
    parts = [unpack(data, "<u4", "u1", "u1") for _, data in rows]
    check, many = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    _, group = np.unique(check, return_inverse=True)
    hit = ((np.bincount(group) + np.bincount(group, many)) > 1)[group] & (many == 0)
    at = 0
    for (block, _), p in zip(rows, parts, strict=True):
        mine = hit[at : at + len(p[0])]
        at += len(p[0])
        if mine.any():
            yield block, pack(planes(unplanes(p[1], "<u4")[mine]))


def _send(length: int):
    def speak(block: Block, told: list, n: int):
        forget()
        if not told:
            return
        first, count, h = _fragments(block, length)
        keep = np.isin(first, np.concatenate([unplanes(unpack(d, "u1")[0], "<u4") for d in told]).astype(np.int64))
        first, count, h = first[keep], count[keep], h[keep]
        ids = block.ids[np.searchsorted(np.cumsum(block.lengths), first, side="right")]
        same: dict[bytes, list[int]] = {}
        text = block.text
        for k, (lo, c) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
            same.setdefault(text[lo : lo + c + length - 1], []).append(k)
        asking, gone = [], []
        for fragment, where in same.items():
            least = min(ids[k] for k in where) if len(where) > 1 else ids[where[0]]
            for k in where:
                (asking if ids[k] == least else gone).append(k)
        if gone:
            k = np.sort(np.array(gone))
            yield block.number % n, TELL, _intervals(first[k], first[k] + count[k] - 1 + length)
        k = np.sort(np.array(asking))
        for bucket, i in by_bucket((h[k] % np.uint64(n)).astype(np.int64), n):
            j = k[i]
            body = b"".join([text[lo : lo + c + length - 1] for lo, c in zip(first[j].tolist(), count[j].tolist(), strict=True)])
            part = ((h[j] >> np.uint64(40)) % np.uint64(PARTS)).astype(np.uint8)
            yield bucket, ASK, pack(count[j].astype(np.uint8), planes(first[j].astype(np.uint32)), planes(ids[j]), part, np.frombuffer(body, np.uint8))

    return speak


def _intervals(lo: np.ndarray, hi: np.ndarray) -> bytes:
    return pack(planes(lo.astype(np.uint32)), planes(hi.astype(np.uint32)))


def _decide(length: int):
    def decide(rows):
        forget()
        asked = []
        for block, data in rows:
            c, f, i, part, body = unpack(data, "u1", "u1", "u1", "u1", "u1")
            size = c.astype(np.int64) + length - 1
            # the strings end the row; they are taken from it where they are
            asked.append((block, c.astype(np.int64), unplanes(f, "<u4").astype(np.int64), unplanes(i, "<i8"), part, np.cumsum(size) - size + len(data) - len(body), data))
        for p in range(PARTS):
            yield from decide_part([(block, c[k], f[k], i[k], at[k], raw) for block, c, f, i, part, at, raw in asked if len(k := np.flatnonzero(part == p))])

    def decide_part(rows):
        """Fragments of some anchors only: equal strings have equal anchors, so no other part matters."""
        if not rows:
            return
        number: dict[bytes, int] = {}
        who = []
        for _, c, _, _, at, raw in rows:
            who.append(np.array([number.setdefault(raw[a : a + k + length - 1], len(number)) for a, k in zip(at.tolist(), c.tolist(), strict=True)], np.int64))
        sizes = [len(w) for w in who]
        who, count, first, ids = (np.concatenate(x) for x in (who, *zip(*((c, f, i) for _, c, f, i, _, _ in rows), strict=True)))
        text = np.frombuffer(b"".join(number), np.uint8)
        starts = np.zeros(len(number), np.int64)
        span = np.zeros(len(number), np.int64)
        span[who] = count
        owner = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(owner, who, ids)
        del number
        np.cumsum(span[:-1] + length - 1, out=starts[1:])
        # all starts of the distinct fragments, in order
        base = np.repeat(np.cumsum(span) - span, span)
        wanted = np.repeat(starts, span) + np.arange(len(base)) - base
        order = two_stage_suffix_array(text, wanted, length)
        border = np.r_[True, adjacent_common_prefixes(text, order, length) < length]
        group = np.cumsum(border) - 1
        fragment = np.repeat(np.arange(len(span)), span)
        slot = np.searchsorted(wanted, order)  # place of each sorted suffix among the starts
        least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, owner[fragment[slot]])
        least_at = np.empty(len(wanted), np.int64)
        least_at[slot] = least[group]
        offset = np.cumsum(span) - span
        at = 0
        for (block, *_), size in zip(rows, sizes, strict=True):
            w, c, f, i = (x[at : at + size] for x in (who, count, first, ids))
            at += size
            base = np.repeat(np.cumsum(c) - c, c)
            inside = np.arange(len(base)) - base
            gone = least_at[np.repeat(offset[w], c) + inside] < np.repeat(i, c)
            if gone.any():
                p = (np.repeat(f, c) + inside)[gone]
                cut = np.flatnonzero(np.diff(p) != 1) + 1
                yield block, _intervals(p[np.r_[0, cut]], p[np.r_[cut - 1, len(p) - 1]] + length)

    return decide


def _kept(with_text: bool):
    def conclude(block: Block, told: list):
        forget()
        edge = np.zeros(len(block.text) + 1, np.int32)
        for data in told:
            lo, hi = (unplanes(x, "<u4").astype(np.int64) for x in unpack(data, "u1", "u1"))
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
        gone = np.cumsum(edge)[: len(block.text)] > 0
        data = np.frombuffer(block.text, np.uint8)
        for doc, at, text in block.documents():
            mine = gone[at : at + len(text)]
            removed = int(mine.sum())
            spans = int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()) if removed else 0
            kept = data[at : at + len(text)][~mine].tobytes() if removed else text
            yield (doc, len(text), removed, spans, kept) if with_text else (doc, len(text), removed, spans, hashlib.sha256(kept).hexdigest())

    return conclude


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every document:
    without each byte covered by a string of `length` bytes (up to 255) that
    also starts in a document with a smaller id. Strings are judged on the
    input and never cross documents. With `digest`, `kept_sha256` stands for
    the remaining bytes.

    Rows with the same id are one document to each other: they remove nothing
    from one another. A missing id is the smallest. Texts shorter than
    `length`, empty and null ones are kept as they are."""
    blocks = make_blocks(df, id_col, text_col)
    gone = _removed(blocks, length)
    last = "kept_sha256 string" if digest else "kept binary"
    out = finish(blocks, gone, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}", _kept(not digest), [pa.int64()] * 4 + [pa.string() if digest else pa.binary()])
    return out.withColumn("doc_id", id_out())



def cut_texts(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns, with only the remaining text. Pieces of
    characters that a cut leaves behind are dropped; null texts become empty."""
    others = [c for c in df.columns if c != text_col]
    blocks = make_blocks(df, id_col, text_col, carry=others)
    at = df.columns.index(text_col)

    def conclude(block: Block, told: list):
        texts = [row[-1].decode("utf-8", "ignore") for row in _kept(True)(block, told)]
        yield block.rest.add_column(at, pa.field(text_col, pa.string()), pa.array(texts, pa.string()))

    return finish_rows(blocks, _removed(blocks, length), df.schema, conclude)


def _removed(blocks: DataFrame, length: int) -> DataFrame:
    """(block, data): packed intervals to remove."""
    if not PIECE < length <= 255 - PIECE:
        raise ValueError("length must lie between the piece and 235 bytes")
    recurring = answer(ask(blocks, _seen(length)), _recurring)
    return answer(ask(blocks, _send(length), recurring), _decide(length))
