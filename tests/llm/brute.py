"""Plain versions of the contracts, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def suffix_dedup(docs, length=50):
    """docs: (id, text or None) -> sorted rows of the digest."""
    least = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def substring_dedup(docs, window=20):
    first = {}
    words = [(i, WORD.findall((t or "").encode())) for i, t in docs]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i, k):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def shingles(text, size=5):
    b = (text or "").encode()
    w = WORD.findall(bytes(x + 32 if 65 <= x <= 90 else x for x in b))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def near_duplicates(docs, num=85, den=100):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(set)
    for n, (_, s) in enumerate(sets):
        for x in s:
            index[x].add(n)
    for n, (i, s) in enumerate(sets):
        for m in {m for x in s for m in index[x] if m > n}:
            j, r = sets[m]
            both = len(s & r)
            if den * both >= num * (len(s) + len(r) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)
