"""Time-chunk halo: window functions over long series without a hot task.

A window partitioned only by ``series_id`` puts a whole series into one task;
one station holding a third of all rows would then be one task.  Instead the
ordered position ``idx`` is cut into chunks of ``chunk_rows`` and every row is
also copied into the neighbouring chunk when it lies within ``before`` rows
of its end (look-back) or ``after`` rows of its start (look-ahead).  Windows
then run per ``(series_id, chunk)``; copies are dropped afterwards.  The
replication factor is ``1 + (before + after) / chunk_rows``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DEFAULT_CHUNK_ROWS = 8760  # one year of hours


def chunked_window(df: DataFrame, key_cols: list[str], order_col: str, before: int, after: int,
                   build: Callable[[WindowSpec], list[Column]] | list[Callable[[WindowSpec], list[Column]]],
                   chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add the columns returned by ``build(window_spec)``; ``order_col`` must be
    a dense LONG position (0, 1, 2, ... per key), such as the grid ``idx``.

    ``build`` may be a list of stages: each stage may use the previous
    stage's columns, and all stages share one exchange and one sort (stacked
    Window operators on the same partitioning).  ``before`` must then cover
    the sum of the stages' look-backs."""
    if before >= chunk_rows or after >= chunk_rows:
        raise ValueError("halo must be shorter than a chunk")
    c = F.lit(chunk_rows)
    home = F.floor(F.col(order_col) / c).cast("long")
    pos = F.col(order_col) - home * c
    parts = F.array_compact(F.array(
        home,
        F.when(pos >= F.lit(chunk_rows - before), home + 1) if before > 0 else F.lit(None).cast("long"),
        F.when(pos < F.lit(after), home - 1) if after > 0 else F.lit(None).cast("long"),
    ))
    expanded = df.withColumn("_home", home).withColumn("_part", F.explode(parts))
    spec = Window.partitionBy(*key_cols, "_part").orderBy(order_col)
    out = expanded
    for stage in (build if isinstance(build, list) else [build]):
        out = out.select("*", *stage(spec))
    return out.where(F.col("_part") == F.col("_home")).drop("_home", "_part")
