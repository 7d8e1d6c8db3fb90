"""Anchored fixed-length windows: where can a repeated window of L symbols be?

Substring dedup (words) and suffix-array dedup (bytes) both ask which windows
of exactly L symbols recur.  Shuffling every window would move each symbol many
times over, so a document is cut into *runs*: consecutive window starts whose
leftmost smallest k-gram hash is the same k-gram (the anchor).  The anchor is a
function of the window's content alone, so equal windows always lie in runs
with equal anchor keys, at equal distance from the anchor.  About 2/(L-k+2) of
the positions become runs; each window start is in exactly one run.

Words become symbols by XXH3; runs of symbols are hashed by polynomial prefix
sums modulo 2**64 over a chunk of documents, finished with a bit mixer.  Keys choose candidates, whose symbols
the operators compare afterwards, except where runs are alike in key and digest
(taken as copies) and in the hot keys of the word operator (128-bit hashes).
"""

from __future__ import annotations

import numpy as np
import xxhash

_B1 = np.uint64(0x9E3779B97F4A7C15 | 1)
_B2 = np.uint64(0xD6E8FEB86659FD93 | 1)
_POS_BITS = np.uint64(24)
_POS_MASK = np.uint64((1 << 24) - 1)
#: Symbols of one chunk; longer documents are cut into overlapping pieces.
CHUNK = 1 << 20

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n + 1 each."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) <= n:
        m = max(n + 1, 1 << 16)
        inv = pow(int(base), -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.full(m, base, np.uint64)
            down = np.full(m, np.uint64(inv), np.uint64)
            up[0] = down[0] = 1
            have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        _POWERS[int(base)] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Prefix:
    """Polynomial prefix hash of a symbol array: any slice's hash in O(1)."""

    def __init__(self, symbols: np.ndarray, base: np.uint64):
        up, self.down = _powers(base, len(symbols))
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum((symbols + np.uint64(1)) * up[: len(symbols)], dtype=np.uint64, out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.down[start]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words ``[^\\x20\\x09-\\x0D]+`` of a byte array."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    return edge[0::2], edge[1::2]


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit symbol per word: XXH3 of its bytes, as a polynomial over the
    letters would give unlike long words the same symbol."""
    out, raw = np.zeros(len(starts), np.uint64), data.data
    for s in range(0, len(starts), 1 << 16):
        e = min(s + (1 << 16), len(starts))
        words = bytes(raw[starts[s]:ends[e - 1]]).split()
        out[s:e] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, e - s)
    return out


def runs(symbols: np.ndarray, bounds: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """Runs of window starts of one chunk.

    ``bounds`` holds the sequences' ends as offsets into ``symbols`` (first 0).
    Returns arrays: seq (index of the sequence), lo (first start, chunk
    offset), n (starts in the run), off (anchor minus lo), key, digest (of the
    symbols lo .. lo + n + length - 1 and off).
    """
    none = {c: np.zeros(0, np.int64) for c in ("seq", "lo", "n", "off", "key", "digest")}
    if len(symbols) < length:
        return none
    first = Prefix(symbols, _B1)
    at = np.arange(len(symbols) - k + 1)
    grams = mix(first.slices(at, at + k))
    best = (grams & ~_POS_MASK) | at.astype(np.uint64)
    span, want = 1, length - k + 1
    while span * 2 <= want:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < want:
        best = np.minimum(best[: len(best) - (want - span)], best[want - span:])
    anchor = (best & _POS_MASK).astype(np.int64)  # of the window that starts here
    start = np.arange(len(anchor))
    seq = np.searchsorted(bounds, start, side="right") - 1
    inside = start + length <= bounds[seq + 1]
    start, anchor, seq = start[inside], anchor[inside], seq[inside]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (seq[1:] != seq[:-1])
    lead = np.flatnonzero(new)
    n = np.diff(np.append(lead, len(start)))
    lo, a = start[lead], anchor[lead]
    second = Prefix(symbols, _B2)
    with np.errstate(over="ignore"):
        # two polynomials, mixed one into the other: what makes one collide does not make both
        digest = mix(second.slices(lo, lo + n + length - 1) + mix(first.slices(lo, lo + n + length - 1) + mix(((a - lo) * 65536 + n).astype(np.uint64))))
    return {"seq": seq[lead], "lo": lo, "n": n, "off": a - lo, "key": grams[a].view(np.int64), "digest": digest.view(np.int64)}


def pieces(n: int, length: int):
    """(first symbol, end symbol) of the pieces of a sequence of n symbols; the
    window starts of the pieces partition those of the sequence."""
    s = 0
    while True:
        if n - s <= CHUNK + length - 1:
            yield s, n
            return
        yield s, s + CHUNK + length - 1
        s += CHUNK
