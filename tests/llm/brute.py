"""Plain Python versions of the contracts, for small tables of (doc_id, text)."""

import hashlib
from collections import Counter

import numpy as np
import xxhash

LAST = 2**63 - 1


def words(text):
    return (text or "").encode().split()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def substring(rows, n=13):
    first = {}
    for i, t in rows:
        w, i = words(t), LAST if i is None else i
        for s in range(len(w) - n + 1):
            g = tuple(w[s:s + n])
            first[g] = min(first.get(g, LAST), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s:s + n])] < (LAST if i is None else i):
                gone[s:s + n] = [True] * n
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), sha(b" ".join(kept))))
    return out


def suffixes(rows, n=200):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[s:s + n] for t in texts for s in range(len(t) - n + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - n + 1):
            if times[t[s:s + n]] > 1:
                gone[s:s + n] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())))
    return out


def simhash(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[j:j + 4]) for j in range(max(1, len(w) - 3))] if w else []
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g, seed=42).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams)) if grams else 0


def linked(values, bits=4):
    """Index of the component of each 64-bit value."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x in range(len(values)):
        for y in range(x):
            if (values[x] ^ values[y]).bit_count() <= bits:
                root[find(x)] = find(y)
    return [find(x) for x in range(len(values))]


def near_groups(rows):
    fps = [simhash(t) for _, t in rows]
    groups = linked(fps)
    low = {}
    for (i, _), g in zip(rows, groups, strict=True):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return [(i, f"{f:016x}", low.get(g)) for (i, _), f, g in zip(rows, fps, groups, strict=True)]


def base_counts(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.encode().split(b"\n") if x.split()]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    inside = {i + d for i, g in enumerate(grams) if times[g] > 1 for d in range(3)}
    n, rep = len(w), len(inside)
    return (n, sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), rep,
            n < 50 or 100 * rep > 50 * n)


def fill(total, weights, caps):
    """Water filling by bisection on the level."""
    live = [(w, c) for w, c in zip(weights, caps, strict=True) if w > 0]
    total = min(total, sum(c for _, c in live))
    lo, hi = 0.0, max([c / w for w, c in live], default=0.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, mid * w) for w, c in live) < total else (lo, mid)
    return [min(c, hi * w) if w > 0 else 0.0 for w, c in zip(weights, caps, strict=True)]
