"""Regularisation: duplicate mean (A1), gap-filling grid (J1), non-finite
nulling (P8), limited causal forward fill (W1) and the audit (A2).

Input: observations ``(series_id, ts TIMESTAMP_NTZ, <value columns> DOUBLE)``.
Output ``hourly``: ``(series_id, idx LONG, ts, <value columns>)``, one row per
grid step from each series' first to last timestamp.

Plan shape: one tiny aggregate for per-series bounds; a row's grid position is
then arithmetic.  The grid's empty rows, generated in chunks from the bounds,
are added to the observations before A1, whose partial + final aggregate on
``(series_id, idx)`` (spread by time, so a hot series is not one task) both
averages duplicates and leaves one row per grid step: no join, one shuffle, and
duplicates shrink before it.  The windows that follow take one more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.cols import qc
from ..functions.numeric import nonfinite_to_null
from ..functions.timecols import US_PER_SECOND, floor_to_step, from_micros, step_seconds, to_micros
from .halo import DEFAULT_CHUNK_ROWS, chunked_window

SERIES = "series_id"


def align_times(obs: DataFrame, step: str | int = "hour", align: str = "exact") -> DataFrame:
    """``exact`` keeps timestamps (rows off the series' own grid are lost in
    J1, as in the reference); ``floor`` truncates to the step first."""
    if align == "exact":
        return obs
    if align == "floor":
        return obs.withColumn("ts", floor_to_step("ts", step))
    raise ValueError(f"unknown align {align!r}")


def series_bounds(obs: DataFrame, step: str | int = "hour") -> DataFrame:
    """Per series: first/last timestamp, grid length ``n`` (arithmetic, the
    grid is never counted) and raw row count."""
    step_us = step_seconds(step) * US_PER_SECOND
    b = obs.groupBy(SERIES).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"),
                                F.count(F.lit(1)).alias("raw_rows"))
    n = F.floor((to_micros("t1") - to_micros("t0")) / F.lit(step_us)).cast("long") + 1
    return b.withColumn("n", n)


def grid(bounds: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """J1 grid positions ``(series_id, t0, idx)``.  Generated in two explode
    steps (chunks, then positions) so no single row carries a whole series."""
    c = F.lit(chunk_rows)
    chunks = bounds.select(SERIES, "t0", "n",
                           F.explode(F.sequence(F.lit(0).cast("long"),
                                                F.floor((F.col("n") - 1) / c).cast("long"))).alias("_chunk"))
    # chunk rows are few (total steps / chunk_rows); spread them before expanding
    chunks = chunks.repartition(SERIES, "_chunk")
    last = F.least(c, F.col("n") - F.col("_chunk") * c) - 1
    rows = chunks.select(SERIES, "t0", "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_pos"))
    return rows.select(SERIES, "t0", (F.col("_chunk") * c + F.col("_pos")).alias("idx"))


def on_grid(obs: DataFrame, bounds: DataFrame, value_cols: list[str], step: str | int = "hour",
            chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """A1 + J1: ``(series_id, idx, ts, values)``, one row per grid step; the mean
    of rows sharing an exact timestamp (NULLs skipped; +-inf kept until after
    the grid, so mean{inf, 5} ends NULL as in the reference).  Rows between
    grid steps are lost, as in the reference."""
    step_us = F.lit(step_seconds(step) * US_PER_SECOND)
    at = to_micros("ts") - to_micros("t0")
    placed = obs.join(bounds.select(SERIES, "t0"), SERIES).where(at % step_us == 0)
    placed = placed.select(SERIES, "t0", F.floor(at / step_us).cast("long").alias("idx"), *[qc(c) for c in value_cols])
    steps = placed.unionByName(grid(bounds, chunk_rows), allowMissingColumns=True)
    rows = steps.groupBy(SERIES, "t0", "idx").agg(*[F.avg(qc(c)).alias(c) for c in value_cols])
    return rows.select(SERIES, "idx", from_micros(to_micros("t0") + F.col("idx") * step_us).alias("ts"), *[qc(c) for c in value_cols])


def forward_fill(hourly: DataFrame, cols: list[str], limit: int = 3,
                 chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Fill at most ``limit`` consecutive gaps from the last observed value
    (causal; range identical to pandas ``ffill(limit=...)``)."""
    if not cols or limit <= 0:
        return hourly

    def build(w: WindowSpec):
        frame = w.rowsBetween(-limit, 0)
        return [F.last(qc(c), ignorenulls=True).over(frame).alias(f"_ff{i}") for i, c in enumerate(cols)]

    out = chunked_window(hourly, [SERIES], "idx", before=limit, after=0, build=build, chunk_rows=chunk_rows)
    keep = [F.col(f"_ff{cols.index(c)}").alias(c) if c in cols else qc(c) for c in hourly.columns]
    return out.select(*keep)


def regularize(obs: DataFrame, target: str, predictors: list[str], step: str | int = "hour",
               align: str = "exact", ffill_limit: int = 3, chunk_rows: int = DEFAULT_CHUNK_ROWS,
               keep: Callable[[DataFrame], DataFrame] = lambda df: df,
               admitted: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """A1 -> J1 -> P8 -> W1.  Returns ``(hourly, bounds)``; ``keep`` may land the
    bounds (one row per series, used twice), and ``admitted`` says which of them
    get a grid: rows of the others meet none, and no grid row is made for them."""
    value_cols = [target] + [p for p in predictors if p != target]
    obs = align_times(obs.select(SERIES, "ts", *[qc(c) for c in value_cols]).where(F.col("ts").isNotNull()), step, align)
    bounds = keep(series_bounds(obs, step))
    hourly = on_grid(obs, admitted(bounds), value_cols, step, chunk_rows)
    hourly = hourly.select(SERIES, "idx", "ts", *[nonfinite_to_null(qc(c)).alias(c) for c in value_cols])
    hourly = forward_fill(hourly, [p for p in value_cols if p != target], ffill_limit, chunk_rows)
    return hourly, bounds


def audit(hourly: DataFrame, bounds: DataFrame, target: str, step: str | int = "hour", source: str | None = None,
          timestamp_col: str = "ts", predictors: list[str] = ()) -> DataFrame:
    """A2: one row per series, with what it was made from."""
    step_us = step_seconds(step) * US_PER_SECOND
    obs_t = hourly.groupBy(SERIES).agg(F.count(qc(target)).alias("valid_target_values"))
    b = bounds.select(SERIES, "raw_rows", "n", "t0")
    return (b.join(obs_t, SERIES, "left")
             .select(SERIES, F.lit(source).cast("string").alias("source"), F.lit(timestamp_col).alias("timestamp_column"),
                     F.lit(target).alias("target_column"), F.lit(", ".join(predictors)).alias("predictor_columns"),
                     F.col("raw_rows").alias("rows_after_timestamp_filter"),
                     F.col("n").alias("hourly_grid_rows"),
                     F.col("t0").alias("hourly_start"),
                     from_micros(to_micros("t0") + (F.col("n") - 1) * F.lit(step_us)).alias("hourly_end"),
                     F.coalesce("valid_target_values", F.lit(0)).alias("valid_target_values"),
                     (F.col("n") - F.coalesce("valid_target_values", F.lit(0))).alias("target_missing_after_reindex")))
