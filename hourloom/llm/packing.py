"""Packing: order-preserving dynamic programming over window cuts.

The documents, in order of id, form one stream of tokens per range partition
(a document: its ids, then the end id 0).  Cuts may fall at document ends
(free), sentence ends (small penalty) and, so that a cut always exists, on
every 16th token inside a sentence (larger penalty).  The cuts chosen
minimise total padding plus truncation penalties under the window length:

    cost(j) = penalty(j) + min over i with pos(j) - pos(i) <= window of
              cost(i) + window - (pos(j) - pos(i))

The candidates i form a sliding window over positions, and pos(i) + cost(i)
is kept in a monotone queue, so every candidate enters and leaves it once.
The stream is solved in blocks that end with a document, so memory is bounded;
a block's last window is the only one without a choice.

A cut inside a sentence costs more than most paddings, so sentences are cut
only where no boundary lies near (some long documents have none for pages).

Defined cases: a null or empty text is the end id alone; repeated rows are
packed each; null ids come last; an empty table gives no piece.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import LAST_ID, plain_columns, replaced, sized
from hourloom.llm.tokens import loaded, strings

WINDOW = 1024
SENTENCE_PENALTY, INSIDE_PENALTY = 2, 96
INSIDE_STEP = 16
#: Tokens of a block of whole documents that is solved at once.
BLOCK_TOKENS = 400_000
_SEQUENCE_BITS = 36


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Indices of the cuts from the first position to the last (both included)
    at least total padding plus penalty; neighbours lie at most ``window`` apart."""
    pos, pen = positions.tolist(), penalties.tolist()
    n = len(pos)
    value = [0] * n  # cost(i) + pos(i): what a later window adds to
    back = [0] * n
    value[0] = pos[0]
    queue: deque[int] = deque([0])
    for j in range(1, n):
        p = pos[j]
        while p - pos[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        v = value[i] + window + pen[j]
        value[j] = v
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


@functools.lru_cache(maxsize=2)
def sentence_flags(tok) -> tuple[np.ndarray, np.ndarray]:
    """Per id: does it end a sentence; does it begin with a blank?"""
    size = tok.library.get_vocab_size()
    names = [tok.library.id_to_token(i) or "" for i in range(size)]
    ends = np.array([x[-1:] in ".!?" and x != "" or "Ċ" in x for x in names])  # Ċ: a line end in byte-level vocabularies
    blank = np.array([x[:1] in ("Ġ", "Ċ", "▁") for x in names])
    return ends, blank


def candidates(docs: list[np.ndarray], ends: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a block (0 and the end included) and their penalties."""
    stream = np.concatenate(docs)
    n = len(stream)
    pen = np.full(n + 1, -1, np.int64)
    pen[INSIDE_STEP::INSIDE_STEP] = INSIDE_PENALTY
    pen[1:n][ends[stream[:-1]] & blank[stream[1:]]] = SENTENCE_PENALTY
    pen[np.cumsum([len(d) for d in docs])] = 0
    pen[0] = pen[n] = 0
    at = np.flatnonzero(pen >= 0)
    return at, pen[at]


@plain_columns
def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator: one row per piece, with the documents' other columns plus
    ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``
    (the piece's token ids) and ``ids_crc32`` (CRC-32 of them as little-endian
    unsigned 32-bit numbers, taken by Spark from the same bytes)."""
    own = ["start", "length", "doc_tokens", "sequence_id", "offset", "ids", "_c_bytes"]
    keep = [c for c in replaced(docs, [*own, "ids_crc32"]) if c != text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_c_text"))
    rows = rows.withColumn("_c_id", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))).withColumn("_c_hash", F.xxhash64("_c_text"))
    rows = rows.withColumn("_c_row", F.monotonically_increasing_id())  # parts equal rows
    order = ["_c_id", "_c_hash", "_c_row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_c_part", F.spark_partition_id().cast("long"))
    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name in own:
        schema = schema.add(name, T.ArrayType(T.IntegerType()) if name == "ids" else T.BinaryType() if name == "_c_bytes" else T.LongType())

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(tokenizer)
        ends, blank = sentence_flags(tok)
        held: list[np.ndarray] = []
        kept: list[pa.RecordBatch] = []
        size = done = part = 0

        def solve() -> pa.RecordBatch:
            nonlocal done
            pos, pen = candidates(held, ends, blank)
            cuts = pos[choose_cuts(pos, pen, window)]
            bounds = np.concatenate(([0], np.cumsum([len(d) for d in held])))
            marks = np.union1d(cuts, bounds)
            s, e = marks[:-1], marks[1:]
            doc = np.searchsorted(bounds, s, side="right") - 1
            seq = np.searchsorted(cuts, s, side="right") - 1
            stream = np.concatenate(held)
            table = pa.Table.from_batches(kept).take(pa.array(doc)).combine_chunks()
            cols = [s - bounds[doc], e - s, np.diff(bounds)[doc], (part << _SEQUENCE_BITS) + done + seq, s - cuts[seq]]
            ends_at, raw = np.append(s, e[-1]).astype(np.int32), stream.astype("<i4")
            cols.append(pa.ListArray.from_arrays(pa.array(ends_at), pa.array(raw)))
            cols.append(pa.BinaryArray.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends_at * np.int32(4)), pa.py_buffer(raw)]))
            done += len(cuts) - 1
            arrays = [table.column(c).combine_chunks() for c in keep]
            return pa.RecordBatch.from_arrays([*arrays, *(x if isinstance(x, pa.Array) else pa.array(x) for x in cols)], names=[*keep, *own])

        for b in sized(batches, "_c_text"):
            part = b.column("_c_part")[0].as_py()
            found = tok.ids(strings(b, "_c_text"))
            held += [np.append(x, np.uint32(0)) for x in found]
            kept.append(b.select(keep))
            size += sum(len(x) for x in found)
            if size >= BLOCK_TOKENS:
                yield solve()
                held, kept, size = [], [], 0
        if held:
            yield solve()

    return rows.mapInArrow(go, schema).withColumn("ids_crc32", F.crc32("_c_bytes")).drop("_c_bytes")
