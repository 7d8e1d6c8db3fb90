"""Shared plan of the two substring operators: from documents to repeated windows.

1. Each document is cut into anchored runs of window starts (``windows64``).
2. Anchor keys that recur are kept (partial aggregation, then a join that
   adaptive execution can split when a key is hot).
3. Runs with equal key and content digest are one *class*; classes, not
   copies, go on, each with its text taken from one of its documents.
4. The operator judges the classes of keys that have several, a bounded batch
   of whole keys at a time; a key with one class needs no comparison.
5. Verdicts go back to all runs of a class and are gathered per document.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm import windows64 as w64
from hourloom.llm.common import CHUNK_BYTES, keyed, land, sized, texts

_RUNS = "key long, digest long, _c_id long, _c_hash long, place long"
_BITS = 12  # of off and n within a place
#: Classes of one key that are compared in one task; a key with more is dealt out by its windows (words) or cut up (bytes).
HOT_CLASSES = 1_000


def lo() -> Column:
    """First window start of a run, in symbols of the document."""
    return F.shiftright("place", 2 * _BITS)


def starts_of_run() -> Column:
    """Number of window starts of a run."""
    return F.col("place").bitwiseAND(F.lit((1 << _BITS) - 1))


def runs_of(docs: DataFrame, unit: str, length: int, k: int) -> DataFrame:
    """Anchored runs of all windows of ``length`` units (``words`` or ``bytes``;
    under 4,096); ``place`` packs the first start, the anchor's offset and the
    number of starts."""
    if length >= 1 << _BITS:
        raise ValueError(f"windows of {length} {unit} are too long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "_c_text"):
            raw = texts(b, "_c_text")
            ids, hashes = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_c_id", "_c_hash"))
            if unit == "words":
                data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
                starts, ends = w64.word_bounds(data)
                symbols = w64.word_symbols(data, starts, ends)
                bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw]))))
            else:
                symbols = np.frombuffer(b"".join(raw), np.uint8)
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
            del raw
            cuts = w64.pieces(len(symbols), length) if len(ids) == 1 else [(0, len(symbols))]
            for s, e in cuts:
                r = w64.runs(symbols[s:e].astype(np.uint64), bounds if len(ids) > 1 else np.array([0, e - s]), length, k)
                first = r["lo"] + s - bounds[r["seq"]]
                place = (first << (2 * _BITS)) | (r["off"] << _BITS) | r["n"]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r["key"], r["digest"], ids[r["seq"]], hashes[r["seq"]], place)],
                                                 names=["key", "digest", "_c_id", "_c_hash", "place"])

    return docs.select("_c_id", "_c_hash", "_c_text").mapInArrow(cut, _RUNS)


def repeated_runs(docs: DataFrame, unit: str, length: int, k: int, measures: list[Column], recurs: Column, name: str) -> DataFrame:
    """Runs whose anchor key recurs (``recurs`` over the ``measures`` of a key),
    with ``same`` (all runs of the key are of one class) and the first of the
    measures; written."""
    runs = runs_of(docs, unit, length, k)
    keys = runs.groupBy("key").agg(*measures, F.min("digest").alias("d0"), F.max("digest").alias("d1")).where(recurs)
    keys = land(keys.select("key", keys.columns[1], (F.col("d0") == F.col("d1")).alias("same")), f"{name}-keys")
    return land(runs.join(keys, "key"), f"{name}-runs")  # two plain exchanges: Spark can split a hot key


def class_texts(docs: DataFrame, runs: DataFrame, unit: str, length: int, name: str, deal_hot: bool = True) -> tuple[DataFrame, DataFrame]:
    """The classes of the runs, written, in two tables.

    Keys with up to ``HOT_CLASSES`` classes: key, digest, first (smallest id),
    times, off, n and the class's text (words: joined by one space) from one of
    its documents.  Hot keys (a common phrase met by ever new neighbours): one
    row per window, with its offset ``j`` in the run and a 128-bit hash of its
    symbols (h1, h2), so that a hot key is dealt out by its windows.  Without
    ``deal_hot`` the second table is empty."""
    spot = F.struct("_c_id", "_c_hash", "place")
    classes = land(runs.groupBy("key", "digest").agg(F.min(spot).alias("p"), F.count(F.lit(1)).alias("times")), f"{name}-classes")
    hot = classes.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_CLASSES).select("key", F.lit(True).alias("hot"))
    if deal_hot:  # at most one row per HOT_CLASSES classes
        classes = classes.join(land(hot, f"{name}-hot-keys"), "key", "left")
    else:
        classes = classes.withColumn("hot", F.lit(False))
    wanted = classes.groupBy(F.col("p._c_id").alias("_c_id"), F.col("p._c_hash").alias("_c_hash")).agg(
        F.collect_list(F.struct("key", "digest", "times", F.col("p.place").alias("place"), F.coalesce("hot", F.lit(False)).alias("hot"))).alias("_c_want"))
    rows = docs.select("_c_id", "_c_hash", "_c_text").dropDuplicates(["_c_id", "_c_hash"]).join(wanted, ["_c_id", "_c_hash"])  # repeated rows: one text
    mask = (1 << _BITS) - 1

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "_c_text"):
            ids = b.column("_c_id").to_numpy(zero_copy_only=False)
            want = b.column("_c_want")
            out: list[tuple] = []
            size = 0
            for i, raw in enumerate(texts(b, "_c_text")):
                parts = raw.split() if unit == "words" else raw
                first = int(ids[i])
                for c in want[i].as_py():
                    at, off, n = c["place"] >> (2 * _BITS), (c["place"] >> _BITS) & mask, c["place"] & mask
                    for j, (s, e) in enumerate(zip(range(at, at + n), range(at + length, at + n + length), strict=True)) if c["hot"] else ((None, (at, at + n + length - 1)),):
                        body = b" ".join(parts[s:e]) if unit == "words" else parts[s:e]
                        h1, h2 = (None, None) if j is None else _hash128(body)
                        out.append((c["key"], c["digest"], first, c["times"], off, n, body if j is None else None, j, h1, h2))
                        size += len(body) if j is None else 64
                    if size > 4 * CHUNK_BYTES:
                        yield _batch(out)
                        out, size = [], 0
            if out:
                yield _batch(out)

    schema = "key long, digest long, first long, times long, off int, n int, body binary, j int, h1 long, h2 long"
    found = land(rows.mapInArrow(fetch, schema), f"{name}-texts")
    return (found.where("body is not null").select("key", "digest", "first", "times", "off", "n", "body"),
            found.where("body is null").select("key", "digest", "first", "times", "j", "h1", "h2"))


def cut_hot(classes: DataFrame, length: int, width: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """The classes of keys with up to ``HOT_CLASSES`` classes, and the parts of
    the others (none: None), written.

    A part holds the consecutive window starts of a class (columns ``of_key``,
    ``of_digest``, first start ``j``) whose distance to the anchor lies in one
    range of ``width``.  All windows of such a range have ``length - width + 1``
    bytes in common (the core); key, range and core make the part's key, so
    equal windows still meet and unlike neighbours part.  With a width of 1 the
    core is the window, and a key has one class."""
    hot = classes.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_CLASSES).select("key", F.lit(True).alias("hot"))
    hot = land(hot, f"{name}-hot-keys")  # at most one row per HOT_CLASSES classes
    if hot.isEmpty():
        return classes, None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "body"):
            out: list[tuple] = []
            for key, digest, times, off, n, body in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for r in range((off - n + 1) // width, off // width + 1):
                    s, e = max(0, off - (r + 1) * width + 1), min(n - 1, off - r * width)
                    part = body[s:e + length]
                    core = body[off - r * width:off - (r + 1) * width + 1 + length]
                    own = struct.pack("<qi", key, r)
                    out.append((key, digest, s, _hash128(own + core)[0], _hash128(struct.pack("<ii", off - s, e - s + 1) + part)[0], times, off - s, e - s + 1, part))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                             names=["of_key", "of_digest", "j", "key", "digest", "times", "off", "n", "body"])

    marked = classes.join(hot, "key", "left")
    parts = marked.where("hot").select("key", "digest", "times", "off", "n", "body").mapInArrow(
        cut, "of_key long, of_digest long, j int, key long, digest long, times long, off int, n int, body binary")
    return marked.where(F.col("hot").isNull()).drop("hot"), land(parts, f"{name}-parts")


def classes_of_parts(parts: DataFrame, name: str) -> DataFrame:
    """Parts alike are one class; columns as of ``class_texts``, without its ``first``
    (0)."""
    found = parts.groupBy("key", "digest").agg(F.sum("times").alias("times"), F.first("off").alias("off"), F.first("n").alias("n"), F.first("body").alias("body"))
    return land(found.select("key", "digest", F.lit(0).cast("long").alias("first"), "times", "off", "n", "body"), f"{name}-part-classes")


def _hash128(body: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(body)
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = {"key": pa.int64(), "digest": pa.int64(), "first": pa.int64(), "times": pa.int64(), "off": pa.int32(), "n": pa.int32(),
             "body": pa.binary(), "j": pa.int32(), "h1": pa.int64(), "h2": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), names.values(), strict=True)], names=list(names))


def key_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows (key, digest, first, times, off, n, body) sorted by key, in lists of
    whole keys with at least ``most`` bytes of text each (the last may have
    fewer).  Rows alike in key and digest are one."""
    held: list[tuple] = []
    size, last = 0, None
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if last is not None and row[:2] == last:
                continue
            if held and row[0] != last[0] and size >= most:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[6])
            last = row[:2]
    if held:
        yield held


def judged(classes: DataFrame, judge: Callable[[list[tuple]], Iterator[tuple]], schema: str, types: list, most: int) -> DataFrame:
    """Runs ``judge`` over lists of whole keys; one task holds one list at a time."""
    names = [x.split()[0] for x in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, most):
            cols = list(zip(*judge(group), strict=True))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return land(classes.repartition("key").sortWithinPartitions("key", "digest").mapInArrow(go, schema), "verdicts")


def per_document(docs: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """Documents with the gathered lists ``value`` of their marks; none: null.
    Repeated rows bring the same lists, which are gathered once, so the marks
    are bounded by the document's own length."""
    got = marks.groupBy("_c_id", "_c_hash").agg(F.flatten(F.collect_set(value)).alias("_c_marks"))
    return docs.join(got, ["_c_id", "_c_hash"], "left")


__all__ = ["class_texts", "classes_of_parts", "cut_hot", "judged", "key_groups", "keyed", "lo", "per_document", "repeated_runs", "runs_of", "starts_of_run"]
