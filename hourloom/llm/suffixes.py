"""Suffix-array dedup: blockwise sorting with a difference-cover sample.

A byte is removed when a 200-byte string that covers it also starts anywhere
else, in the same document or another; strings never cross documents and are
judged on the input.

Suffixes that can begin with the same 200 bytes share an anchor key (see
``repeats``); a batch of whole keys is one task's text ``T``, its classes laid
so that anchors fall on multiples of the period.  Within it:

* a difference cover of period 31 (six residues) is sampled and ranked by its
  first 248 bytes, by doubling: 31, 62, 124, 248 bytes;
* the window starts are sorted one bucket of leading bytes at a time, by their
  first 31 bytes; longer ties are settled by the ranks of the sample positions
  that follow both suffixes at equal distance, never by reading on;
* neighbours in a bucket whose first 200 bytes agree are repeats.

Memory per task: the batch, its sample ranks and one bucket's keys, whatever
the length of the matches.  A key whose runs are all alike (one class, many
copies) has nothing to sort: all its suffixes tie by construction.  A key with
more than ``HOT_CLASSES`` classes (a frequent passage met by ever new
neighbours) is cut up by content before it is sorted (``cut_hot``): first by
ranges of 13 distances to the anchor and the bytes that all windows of a range
share; parts that still have too many classes, into single windows.  So a batch
is ``BATCH_BYTES`` and at most one key of ``HOT_CLASSES`` classes more.

Defined cases: null is empty; a text under 200 bytes is kept whole; repeated
rows are places of their own, so both lose their repeated bytes.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import keyed, land, plain_columns, replaced, sized, texts
from hourloom.llm.repeats import class_texts, classes_of_parts, cut_hot, judged, lo, per_document, repeated_runs, starts_of_run
from hourloom.llm.substring import cover_spans

MIN_BYTES = 200
ANCHOR_BYTES = 32
#: Period and residues of the difference cover: every difference modulo 31 occurs.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes of text per batch of keys, and suffixes sorted at once.
BATCH_BYTES = 2_000_000
BUCKET = 1 << 16


def cover_steps() -> np.ndarray:
    """[r, s]: least d with r + d and s + d both in the cover, modulo the period."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    r = np.arange(PERIOD)
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for i in range(PERIOD):
        for j in range(PERIOD):
            out[i, j] = next(d for d in r if inside[(i + d) % PERIOD] and inside[(j + d) % PERIOD])
    return out


_STEPS = cover_steps()


def _lead(eights: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The first 31 bytes at the positions as four numbers in byte order."""
    parts = [eights[at + 8 * i] for i in range(4)]
    parts[3] = parts[3] >> np.uint64(8)
    return parts


def _dense_rank(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks (from 1) of rows by their keys, first key first; equal rows tie."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new) + 1
    return ranks


def cover_ranks(eights: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Rank of every cover position of the text by at least its first ``depth``
    bytes (0 elsewhere and past the end)."""
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    table = np.zeros(n + 8 * PERIOD + depth, np.int64)
    table[at] = _dense_rank(_lead(eights, at))
    seen = PERIOD
    while seen < depth:
        table[at] = _dense_rank([table[at], table[at + seen]])
        seen *= 2
    return table


def sorted_suffixes(eights: np.ndarray, starts: np.ndarray, ranks: np.ndarray) -> Iterator[np.ndarray]:
    """The suffixes at ``starts`` in order, one bucket of leading bytes at a time."""
    first = eights[starts]
    buckets = max(1, len(starts) // (BUCKET // 2))
    cuts = np.unique(np.quantile(first[:: max(1, len(first) // 4096)], np.arange(1, buckets) / buckets, method="nearest")) if buckets > 1 else np.zeros(0, np.uint64)
    bucket = np.searchsorted(cuts, first, side="right")
    for b in range(len(cuts) + 1):
        at = starts[bucket == b]
        if not len(at):
            continue
        lead, residue = _lead(eights, at), at % PERIOD
        order = np.lexsort([ranks[at + _STEPS[residue, residue]], residue, *lead[::-1]])
        at, residue = at[order], residue[order]
        tie = np.ones(len(at), bool)
        tie[0] = False
        for k in lead:
            k = k[order]
            tie[1:] &= k[1:] == k[:-1]
        mixed = np.flatnonzero(tie[1:] & (residue[1:] != residue[:-1])) + 1
        group = np.cumsum(~tie)
        for g in np.unique(group[mixed]):  # ties of different residues: compare by common cover positions
            s, e = np.searchsorted(group, [g, g + 1])

            def cmp(i: int, j: int) -> int:
                d = _STEPS[i % PERIOD, j % PERIOD]
                return int(ranks[i + d] - ranks[j + d])
            at[s:e] = sorted(at[s:e].tolist(), key=functools.cmp_to_key(cmp))
        yield at


def _agree(eights: np.ndarray, i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """Which pairs of positions have the same first ``length`` bytes?"""
    same = np.ones(len(i), bool)
    steps = [*range(0, length - 7, 8), length - 8]
    for d in steps:
        same &= eights[i + d] == eights[j + d]
    return same


def _spans(group: list[tuple], length: int) -> Iterator[tuple]:
    """(key, digest, spans of repeated starts) of the classes of whole keys."""
    offs, at = [], 0
    for row in group:
        at += -(at + row[4]) % PERIOD  # the anchor on a multiple of the period
        offs.append(at)
        at += len(row[6]) + 1
    n = at
    text = np.zeros(n + 2 * length + 16, np.uint8)
    for o, row in zip(offs, group, strict=True):
        text[o:o + len(row[6])] = np.frombuffer(row[6], np.uint8)
    eights = np.zeros(len(text) - 8, np.uint64)
    for i in range(8):
        eights |= text[i:len(text) - 8 + i].astype(np.uint64) << np.uint64(8 * (7 - i))
    counts = np.array([row[5] for row in group], np.int64)
    owner = np.repeat(np.arange(len(group)), counts)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(np.array(offs), counts)
    repeated = np.zeros(n + 1, bool)
    ranks = cover_ranks(eights, n, length)
    for order in sorted_suffixes(eights, starts, ranks):
        same = _agree(eights, order[:-1], order[1:], length)
        repeated[order[:-1][same]] = True
        repeated[order[1:][same]] = True
    for o, row in zip(offs, group, strict=True):
        if row[3] > 1:
            yield row[0], row[1], [0, row[5] - 1]
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], repeated[o:o + row[5]], [False])).view(np.int8)))
        if len(edges):
            edges[1::2] -= 1
            yield row[0], row[1], edges.tolist()


def _judge(group: list[tuple], length: int) -> Iterator[tuple]:
    """As ``_spans``; a key with one class has nothing to sort."""
    times = Counter(row[0] for row in group)
    for row in group:
        if times[row[0]] == 1 and row[3] > 1:
            yield row[0], row[1], [0, row[5] - 1]
    several = [row for row in group if times[row[0]] > 1]
    if several:
        yield from _spans(several, length)


def verdicts(classes: DataFrame, length: int, widths: list[int]) -> DataFrame:
    """(key, digest, spans of repeated starts) of the classes; those of hot keys
    from their parts, ever narrower."""
    cold, parts = cut_hot(classes, length, widths[0], "suffixes") if widths else (classes, None)
    found = judged(cold, lambda g: _judge(g, length), "key long, digest long, spans array<int>", [pa.int64(), pa.int64(), pa.list_(pa.int32())], BATCH_BYTES)
    if parts is None:
        return found
    inner = verdicts(classes_of_parts(parts, "suffixes"), length, widths[1:])
    back = parts.select("of_key", "of_digest", "j", "key", "digest").join(inner, ["key", "digest"])
    back = back.groupBy(F.col("of_key").alias("key"), F.col("of_digest").alias("digest")).agg(F.flatten(F.collect_list(F.transform("spans", lambda x: x + F.col("j")))).alias("spans"))
    return land(found.unionByName(back), "verdicts")


@plain_columns
def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES,
                          anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """The operator: input rows plus ``n_bytes``, ``n_removed``, ``removed_spans``
    (list of [first byte, byte after the last]) and ``kept_bytes`` (binary)."""
    own = ["n_bytes", "n_removed", "removed_spans", "kept_bytes"]
    keep = replaced(docs, own)
    base = keyed(docs.select(*[F.col(f"`{c}`") for c in keep]), id_col, text_col)
    runs = repeated_runs(base, "bytes", min_bytes, anchor_bytes, [F.count(F.lit(1)).alias("times")], F.col("times") > 1, "suffixes")
    several = runs.where(~F.col("same")).drop("times")
    classes, _ = class_texts(base, several, "bytes", min_bytes, "suffixes", deal_hot=False)
    spans = verdicts(classes, min_bytes, [math.isqrt(min_bytes - anchor_bytes) + 1, 1])
    all_same = runs.where("same").select("_c_id", "_c_hash", F.array(lo(), lo() + starts_of_run() - 1).alias("s"))
    some = several.join(spans, ["key", "digest"]).select("_c_id", "_c_hash", F.transform("spans", lambda x: lo() + x).alias("s"))
    rows = per_document(base, all_same.unionByName(some), "s").select(*[F.col(f"`{c}`") for c in keep], "_c_text", "_c_marks")
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept_bytes", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "_c_text"):
            marks = b.column("_c_marks")
            cols: list[list] = [[], [], [], []]
            for i, raw in enumerate(texts(b, "_c_text")):
                m = marks[i].as_py() or []
                removed = merge_spans(sorted((s, e + min_bytes) for s, e in zip(m[0::2], m[1::2], strict=True)))
                at, kept = 0, []
                for s, e in removed:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                left = b"".join(kept)
                for col, v in zip(cols, (len(raw), len(raw) - len(left), removed, left), strict=True):
                    col.append(v)
            ints = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(cols[0], ints), pa.array(cols[1], ints), pa.array(cols[2], pa.list_(pa.list_(ints))), pa.array(cols[3], pa.binary())],
                names=[*keep, *own])

    return rows.mapInArrow(cut, schema)


def merge_spans(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal spans of sorted, possibly overlapping or touching ones."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


__all__ = ["remove_repeated_bytes"]
