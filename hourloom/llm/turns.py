"""Turns of conversations: numbering and digests that survive a hot conversation.

A conversation may hold a third of all rows, so nothing here groups or windows
the rows of one conversation: rows are range-partitioned by (conversation,
order) and numbered by the partition pieces' sizes, and digests of ordered
lines are streamed with constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.common import land

#: The blanks of the contracts: everything outside ``[^\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def conversation_key(conv: Column) -> Column:
    """A key that is never null: a null id is a conversation of its own."""
    return F.when(conv.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), conv.cast("string")))


def numbered(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` landed with ``_c_pos`` (place in the conversation, from 0) and
    ``_c_total`` (its rows).  Rows alike in key and order may swap places."""
    rows = rows.withColumn("_c_salt", F.monotonically_increasing_id())  # splits many rows alike
    by = [F.col(key), *order, F.col("_c_salt")]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = land(rows.withColumns({"_c_part": F.spark_partition_id(), "_c_row": F.monotonically_increasing_id()}).drop("_c_salt"), name)
    pieces = rows.groupBy(key, "_c_part").agg(F.min("_c_row").alias("_c_first"), F.count(F.lit(1)).alias("_c_n"))
    before = Window.partitionBy(key).orderBy("_c_part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row per partition
    pieces = pieces.select(key, "_c_part", (F.coalesce(F.sum("_c_n").over(before), F.lit(0)) - F.col("_c_first")).alias("_c_shift"),
                           F.sum("_c_n").over(Window.partitionBy(key)).alias("_c_total"))
    pieces = land(pieces, f"{name}-pieces")  # a plain table: a hot piece's rows can be split
    return rows.join(pieces, [key, "_c_part"]).withColumn("_c_pos", F.col("_c_row") + F.col("_c_shift")).drop("_c_part", "_c_row", "_c_shift")


def streamed_sha256(lines: DataFrame, keys: list[str], order: list[str], line: str, separator: str) -> DataFrame:
    """``keys`` and ``sha256`` of each group's lines in order, joined by the
    separator.  A digest has to read its lines one after the other, so a group
    is one task's stream; of it only the running digest is held."""
    lines = lines.select(*keys, *order, F.col(line).cast("string").alias("_c_line")).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "_c_line")
    gap = separator.encode()
    schema = lines.select(*keys).schema

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*[(*k, h) for k, h in done], strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=False)), pa.array(cols[-1], pa.string())], names=[*keys, "sha256"])

        kinds: list[pa.DataType] = []
        for b in batches:
            kinds = [b.schema.field(k).type for k in keys]
            done = []
            named = zip(*[b.column(k).to_pylist() for k in keys], strict=True)
            for k, x in zip(named, b.column("_c_line").cast(pa.binary()).to_pylist(), strict=True):
                if k != held:
                    if held is not None:
                        done.append((held, digest.hexdigest()))
                    held, digest = k, hashlib.sha256(x)
                else:
                    digest.update(gap)
                    digest.update(x)
            if done:
                yield out(done)
        if held is not None:
            yield out([(held, digest.hexdigest())])

    return lines.mapInArrow(go, schema.add("sha256", "string"))


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, and the end."""
    new = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], new, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
