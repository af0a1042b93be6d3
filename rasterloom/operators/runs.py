"""Straight runs of the pixels of one tile, along all lines through it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd

ANGLES = 180
PIECE = "t int, rho int, p1 double, r1 int, c1 int, p2 double, r2 int, c2 int, n_px bigint"
OWNED = "t int, rho int, r1 int, c1 int, r2 int, c2 int, n_px bigint, own bigint"


class Pieces(NamedTuple):
    """Pieces of runs at one angle, ordered by line and position. Pixels are
    numbers of rows; `member`, `piece` and `nth` are aligned, one entry for
    each pixel of a piece (nth: which of the pixel's lines this one is)."""
    t: int
    rho: np.ndarray
    first: np.ndarray
    last: np.ndarray
    p1: np.ndarray
    p2: np.ndarray
    n_px: np.ndarray
    open: np.ndarray
    member: np.ndarray
    piece: np.ndarray
    nth: np.ndarray


def _pieces(row: np.ndarray, col: np.ndarray, weight: np.ndarray, core: np.ndarray, gap: float, width: float) -> Iterator[Pieces]:
    """Longest successions of core pixels along each line that neither a gap
    nor a pixel of the halo breaks; open if a pixel of the halo goes on with
    the run. Pixels are distinct and ordered by row and column."""
    for t in range(ANGLES):
        a = math.radians(t - 90.0)
        cos, sin = math.cos(a), math.sin(a)
        d = col * cos + row * sin
        pos = np.rint((row * cos - col * sin) * 1e6) / 1e6
        low = np.ceil(np.rint((d - width) * 1e9) / 1e9).astype(np.int64)
        lines = np.floor(np.rint((d + width) * 1e9) / 1e9).astype(np.int64) - low + 1
        along = np.argsort(pos, kind="stable")
        pix = np.repeat(along, lines[along])
        size = lines[along]
        nth = np.arange(len(pix)) - np.repeat(np.cumsum(size) - size, size)
        rho = low[pix] + nth
        offset = rho - low.min()
        if offset.max(initial=0) < 1 << 16:
            offset = offset.astype(np.uint16)  # sorted by radix
        order = np.argsort(offset, kind="stable")
        pix, nth, rho = pix[order], nth[order], rho[order]
        p, own = pos[pix], core[pix]
        linked = (rho[1:] == rho[:-1]) & ~(p[1:] - p[:-1] > gap)
        before, after = np.append(False, linked), np.append(linked, False)
        inner = linked & own[1:] & own[:-1]
        start = np.flatnonzero(own & ~np.append(False, inner))
        end = np.flatnonzero(own & ~np.append(inner, False))
        total = np.append(0, np.cumsum(weight[pix]))
        member = np.flatnonzero(own)
        yield Pieces(
            t, rho[start], pix[start], pix[end], p[start], p[end], total[end + 1] - total[start], before[start] | after[end],
            pix[member], np.repeat(np.arange(len(start)), end - start + 1), nth[member],
        )


def _sorted(pdf: pd.DataFrame, tr: int, tc: int, tile: int) -> tuple[np.ndarray, ...]:
    pdf = pdf.sort_values(["row", "col"])
    row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
    return row, col, pdf["_n"].to_numpy(np.int64), (row // tile == tr) & (col // tile == tc)


def open_pieces(pdf: pd.DataFrame, tr: int, tc: int, tile: int, gap: float, width: float) -> pd.DataFrame:
    """The pieces of a tile that go on in another."""
    row, col, weight, core = _sorted(pdf, tr, tc, tile)
    parts = []
    for q in _pieces(row, col, weight, core, gap, width):
        k = q.open
        a, b = q.first[k], q.last[k]
        parts.append(pd.DataFrame({
            "t": np.full(len(a), q.t), "rho": q.rho[k], "p1": q.p1[k], "r1": row[a], "c1": col[a],
            "p2": q.p2[k], "r2": row[b], "c2": col[b], "n_px": q.n_px[k],
        }))
    return pd.concat(parts)


def owned_runs(
    pdf: pd.DataFrame, joined: pd.DataFrame, tr: int, tc: int, tile: int, gap: float, width: float, min_length: float,
) -> pd.DataFrame:
    """Runs of at least `min_length` with the number of the tile's pixels that
    count for them. `joined` gives for the tile's open pieces (t, rho, first
    pixel r1, c1) the whole run (_a, _b, _length, _total), if it is long
    enough. A run within the tile that too few pixels count for is left out."""
    row, col, weight, core = _sorted(pdf, tr, tc, tile)
    n = len(row)
    low, wide = col.min(), int(col.max() - col.min()) + 1
    code = (row - row.min()) * wide + (col - low)
    j = joined.assign(_pix=np.searchsorted(code, (joined["r1"].to_numpy(np.int64) - row.min()) * wide + (joined["c1"].to_numpy(np.int64) - low)))
    j = j.sort_values(["t", "rho", "_pix"])
    j_t, j_key = j["t"].to_numpy(), j["rho"].to_numpy(np.int64) * n + j["_pix"].to_numpy(np.int64)
    whole = {c: j[c].to_numpy() for c in ("ra", "ca", "rb", "cb", "_length", "_total")}
    best_length, best_n, best_run = np.full(n, -1.0), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    runs, known = [], 0
    for q in _pieces(row, col, weight, core, gap, width):
        length, n_px, keep = np.rint((q.p2 - q.p1) * 1e6) / 1e6, q.n_px.copy(), ~q.open
        ends = [row[q.first], col[q.first], row[q.last], col[q.last]]
        lo, hi = np.searchsorted(j_t, [q.t, q.t + 1])
        if hi > lo:
            opened = np.flatnonzero(q.open)
            at = lo + np.searchsorted(j_key[lo:hi], q.rho[opened] * n + q.first[opened])
            hit = (at < hi) & (j_key[np.minimum(at, hi - 1)] == q.rho[opened] * n + q.first[opened])
            opened, at = opened[hit], at[hit]
            keep[opened] = True
            length[opened], n_px[opened] = whole["_length"][at], whole["_total"][at]
            for e, c in zip(ends, ("ra", "ca", "rb", "cb")):
                e[opened] = whole[c][at]
        keep &= length >= min_length
        number = np.cumsum(keep) - 1 + known
        long = keep[q.piece]
        member, piece, nth = q.member[long], q.piece[long], q.nth[long]
        # smaller angles and rhos come first, so only a better run replaces one
        for k in range(nth.max(initial=-1) + 1):
            m, g = member[nth == k], piece[nth == k]
            better = (length[g] > best_length[m]) | ((length[g] == best_length[m]) & (n_px[g] > best_n[m]))
            m, g = m[better], g[better]
            best_length[m], best_n[m], best_run[m] = length[g], n_px[g], number[g]
        known += int(keep.sum())
        runs.append([np.full(keep.sum(), q.t), q.rho[keep], *(e[keep] for e in ends), n_px[keep], q.open[keep]])
    t, rho, r1, c1, r2, c2, n_px, opened = (np.concatenate(c) for c in zip(*runs))
    own = np.bincount(best_run[best_run >= 0], minlength=known)
    k = (own > 0) & (opened | (2 * own >= n_px))
    return pd.DataFrame({"t": t[k], "rho": rho[k], "r1": r1[k], "c1": c1[k], "r2": r2[k], "c2": c2[k], "n_px": n_px[k], "own": own[k]})
