"""Shared helpers of the corpus operators.

Null rules used throughout: a null text is the empty text, a null document id
is kept in the output and ordered after every id (before every id in
descending order).  Internal columns start with ``_c_``; an input column of
such a name, or of a name that an operator adds, is replaced.
"""

from __future__ import annotations

import functools
import gc
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.session import materialize

#: A null id as a number: after every other id.
LAST_ID = 2**63 - 1
#: Text bytes that a Python worker handles at once (a longer text stands alone).
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def land(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back: cuts
    the lineage, survives lost executors and gives Spark the table's size."""
    out = materialize(df, f"llm-{name}")
    free_shuffles(df.sparkSession)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Spark removes the shuffle files of finished jobs when the driver collects
    its garbage; asked for between the phases of a long operator, the disks hold
    one phase's shuffles at a time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``_c_id`` (id, null last), ``_c_text`` (null: empty) and ``_c_hash``
    (of the text).  (id, hash) names a row; rows alike in both are repeats of
    one row and get the same verdict."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (docs.withColumn("_c_text", text)
            .withColumn("_c_id", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)))
            .withColumn("_c_hash", F.xxhash64("_c_text")))


def sized(batches: Iterator[pa.RecordBatch], col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of ``col`` each."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, col: str) -> list[bytes]:
    """The texts as UTF-8 bytes; null: empty."""
    return [x or b"" for x in batch.column(col).cast(pa.binary()).to_pylist()]


def replaced(docs: DataFrame, names: list[str]) -> list[str]:
    """Input columns that stay beside an operator's own columns ``names``."""
    return [c for c in docs.columns if c not in names and not c.startswith("_c_")]


def columns(docs: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def plain_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Runs an operator on input columns renamed by position, and names them
    back: names with dots or spaces, or like an operator's own, do no harm.  Of
    an input column named like one that the operator adds, the operator's stays."""
    signature = inspect.signature(operator)

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        given = signature.bind(docs, *args, **named)
        given.apply_defaults()
        plain = {c: f"_p{i}" for i, c in enumerate(docs.columns)}
        for name, value in given.arguments.items():
            if name.endswith("_col"):
                given.arguments[name] = plain[value]
        given.arguments[next(iter(given.arguments))] = docs.toDF(*plain.values())
        out = operator(*given.args, **given.kwargs)
        names = {p: c for c, p in plain.items()}
        added = {c for c in out.columns if c not in names}
        return out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns if names.get(c) not in added])

    return run


def id_steps(df: DataFrame, col: str, blocks: int) -> list[int]:
    """Split points of a long column, at most ``blocks - 1`` (one small aggregate
    with bounded state); a value that fills several steps comes several times."""
    if blocks < 2:
        return []
    at = [i / blocks for i in range(1, blocks)]
    return df.agg(F.percentile_approx(col, at, max(10_000, 20 * blocks)).alias("b")).first()["b"] or []


def block_of(col: str, bounds: list[int]) -> Column:
    """How many bounds lie below the value: coarse steps first, then the fine
    ones, so that about 2 * sqrt(blocks) comparisons are made."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    v = F.col(col)
    coarse = F.size(F.filter(F.array(*[F.lit(g[-1]).cast("long") for g in groups]), lambda b: b < v))
    nested = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups], F.array().cast("array<bigint>"))
    fine = F.size(F.filter(F.get(nested, coarse), lambda b: b < v))
    return coarse * F.lit(step) + fine
