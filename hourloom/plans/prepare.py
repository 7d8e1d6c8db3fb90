"""The data plane as one plan: observations -> hourly grid -> features ->
train-only parameters -> windows + labels + split, with audit and gates.

Lineage is cut by writing one table to the checkpoint folder right after the
single window pass: every grid row with its filled features (read, column
pruned, by the parameter fit and the audit) and the unscaled arrays of the
complete windows (read by every model fit and evaluation, scaled on read by a
map-only projection).  The small per-series parameter table is written too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import regularize as reg
from ..operators import windows as win
from ..operators.halo import DEFAULT_CHUNK_ROWS
from ..session import materialize

SERIES = "series_id"


@dataclass
class Gates:
    """P12 thresholds (reference defaults)."""

    min_observed_targets: int = 500
    min_train_targets: int = 100
    min_windows_per_split: int = 80
    max_grid_rows: int = 2_000_000   # span gate (J1): grid steps of one series
    max_grid_ratio: float = 1_000.0  # and grid steps per observed row: one wrong year shows here


class GateError(ValueError):
    """Raised by ``on_fail="raise"``; ``failed`` is the table of failed checks of all series."""

    def __init__(self, failed: DataFrame, message: str):
        super().__init__(message)
        self.failed = failed


@dataclass
class Prepared:
    hourly: DataFrame
    bounds: DataFrame
    params: DataFrame
    windows: DataFrame
    layout: feat.FeatureLayout
    audit: DataFrame
    quality: DataFrame
    window_size: int = 8
    horizon: int = 1
    extras: dict = field(default_factory=dict)

    @property
    def feature_params(self) -> DataFrame:
        return feat.feature_params_long(self.params, self.layout)

    @property
    def target_params(self) -> DataFrame:
        return feat.target_params(self.params)

    @property
    def feature_names(self) -> list[str]:
        return self.layout.names


def _persist(df: DataFrame, how: str, name: str) -> DataFrame:
    if how == "write":
        return materialize(df, name)
    if how == "cache":
        return df.cache()
    return df


def span_plausible(gates: Gates, n: Column, raw_rows: Column) -> Column:
    """Is the grid neither too long nor far longer than the data?  Known from
    the bounds alone, before any grid row is made."""
    return (n <= F.lit(gates.max_grid_rows)) & (n <= F.lit(gates.max_grid_ratio) * F.greatest(raw_rows, F.lit(1)))


def quality_report(audit: DataFrame, params: DataFrame, counts: DataFrame | None, gates: Gates,
                   window: int) -> DataFrame:
    """P12 as a table ``(series_id, check, observed, threshold, passed)``."""
    a = audit.select(SERIES, F.col("valid_target_values").cast("double").alias("v"))
    rows = [a.select(SERIES, F.lit("observed_targets").alias("check"), F.col("v").alias("observed"),
                     F.lit(float(gates.min_observed_targets)).alias("threshold"))]
    # span: 1 when plausible (reported, never clipped)
    span = span_plausible(gates, F.col("hourly_grid_rows"), F.col("rows_after_timestamp_filter"))
    rows.append(audit.select(SERIES, F.lit("span_plausible").alias("check"), span.cast("double").alias("observed"),
                             F.lit(1.0).alias("threshold")))
    p = params.select(SERIES, "n", "train_end", "val_end", "train_targets")
    valid = (F.lit(window) < F.col("train_end")) & (F.col("train_end") < F.col("val_end")) & (F.col("val_end") < F.col("n"))
    rows.append(p.select(SERIES, F.lit("split_valid").alias("check"), valid.cast("double").alias("observed"),
                         F.lit(1.0).alias("threshold")))
    rows.append(p.select(SERIES, F.lit("train_targets").alias("check"),
                         F.col("train_targets").cast("double").alias("observed"),
                         F.lit(float(gates.min_train_targets)).alias("threshold")))
    if counts is not None:
        splits = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
        per = (p.select(SERIES, F.explode(splits).alias("split"))
               .join(counts, [SERIES, "split"], "left")
               .groupBy(SERIES).agg(F.min(F.coalesce("windows", F.lit(0))).cast("double").alias("observed")))
        rows.append(per.select(SERIES, F.lit("windows_per_split").alias("check"), "observed",
                               F.lit(float(gates.min_windows_per_split)).alias("threshold")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("passed", F.col("observed") >= F.col("threshold"))


def prepare(obs: DataFrame, target: str, predictors: list[str], step: str | int = "hour",
            align: str = "exact", window: int = 8, horizon: int = 1, train_fraction: float = 0.70,
            validation_fraction: float = 0.15, ffill_limit: int = 3, gates: Gates | None = None,
            on_fail: str = "report", chunk_rows: int = DEFAULT_CHUNK_ROWS, persist: str = "write",
            current_name: str = feat.CURRENT_NAME, feature_order: list[str] | None = None,
            source: str | None = None, timestamp_col: str = "ts") -> Prepared:
    """E3.  ``on_fail``: ``report`` (keep every series, quality table only),
    ``exclude`` (drop failing series from the windows) or ``raise``.

    Unless series are only reported, the span is judged on the bounds, one row
    per series: an implausible one (a single wrong year would stretch it over
    millennia) gets no grid, no parameters and no windows; its row in the
    quality table stays, its other checks count nothing observed."""
    if on_fail not in ("report", "exclude", "raise"):
        raise ValueError(f"unknown on_fail {on_fail!r}")
    gates = gates or Gates()
    spans = span_plausible(gates, F.col("n"), F.col("raw_rows"))

    def admitted(bounds: DataFrame) -> DataFrame:
        if on_fail == "report":
            return bounds
        if on_fail == "raise":
            far = bounds.where(~spans).select(SERIES, F.lit("span_plausible").alias("check"), F.lit(0.0).alias("observed"), F.lit(1.0).alias("threshold"), F.lit(False).alias("passed"))
            if not far.isEmpty():
                raise GateError(far, f"{far.count()} series span implausibly many steps; all are in .failed")
        return bounds.where(spans)

    # feature order: file order with the target in place (ingest), else target first
    value_cols = list(feature_order) if feature_order else [target] + [p for p in predictors if p != target]
    # A1 + J1 + P8 (the fill runs in the window pass below)
    grid_rows, bounds = reg.regularize(obs, target, predictors, step, align, 0, chunk_rows,
                                       lambda b: _persist(b, persist, "bounds"), admitted)  # one row per series
    layout = feat.feature_layout(value_cols, target, current_name)
    fill_idx = [i for i, c in enumerate(layout.value_cols) if c != target]
    # W1 + W2-W4 + P11: one exchange on (series_id, chunk), two stacked Window operators;
    # every grid row (filled) plus the unscaled arrays of complete windows, written once
    rows = win.fill_and_window(feat.feature_frame(grid_rows, layout), len(layout.names), fill_idx,
                               ffill_limit, window, horizon, chunk_rows)
    rows = _persist(rows, persist, "hourly")
    feats = rows.select(SERIES, "idx", "ts", "target", *[f"_f{i}" for i in range(len(layout.names))])
    hourly = rows.select(SERIES, "idx", "ts",
                         *[F.col(f"_f{i}").alias(c) for i, c in enumerate(layout.value_cols)])
    splits = feat.split_points(bounds, train_fraction, validation_fraction)
    params = _persist(feat.fit_params(feats, splits, layout), persist, "params")
    # J2 + F3-F6 + W5: map-only scaling of the collected arrays, applied on read
    # (the arrays are written once, unscaled, in `rows`)
    windows = win.scale_windows(rows, params, horizon)
    audit = reg.audit(hourly, bounds, target, step, source, timestamp_col, [c for c in value_cols if c != target])
    counts = win.window_counts(windows)
    quality = quality_report(audit, params, counts, gates, window)
    if on_fail != "report":
        failed = quality.where(~F.col("passed")).select(SERIES).distinct()
        if on_fail == "raise":
            if not failed.isEmpty():
                failed = _persist(quality.where(~F.col("passed")), persist, "failed-gates")
                raise GateError(failed, f"{failed.select(SERIES).distinct().count()} series failed data-quality gates; all are in .failed")
        else:
            windows = windows.join(failed, [SERIES], "left_anti")
    return Prepared(hourly, bounds, params, windows, layout, audit, quality, window, horizon)


def windows_with(params: DataFrame, obs: DataFrame, target: str, predictors: list[str], step: str | int = "hour",
                 align: str = "exact", window: int = 8, horizon: int = 1, ffill_limit: int = 3,
                 chunk_rows: int = DEFAULT_CHUNK_ROWS, current_name: str = feat.CURRENT_NAME,
                 feature_order: list[str] | None = None) -> DataFrame:
    """S4 in use: windows of new observations under saved parameters
    (``sources.sinks.load_params``); series without parameters have none."""
    value_cols = list(feature_order) if feature_order else [target] + [p for p in predictors if p != target]
    layout = feat.feature_layout(value_cols, target, current_name)
    grid_rows, _ = reg.regularize(obs, target, predictors, step, align, 0, chunk_rows)
    fill_idx = [i for i, c in enumerate(layout.value_cols) if c != target]
    rows = win.fill_and_window(feat.feature_frame(grid_rows, layout), len(layout.names), fill_idx, ffill_limit, window, horizon, chunk_rows)
    return win.scale_windows(rows, params, horizon)


__all__ = ["GateError", "Gates", "Prepared", "prepare", "quality_report", "windows_with"]
