"""Sliding windows with a next-step label and a chronological split.

W2 sequence (rows t-7..t, oldest first), W3 history completeness, W4 label
value/time ``horizon`` rows ahead, W5 split by label position, P11 filter,
A7 counts.  All in one chunked window pass keyed by ``(series_id, chunk)``;
the 8xF arrays are filtered (P11) right after the window so they never enter
another shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.scaling import standard_scale
from .halo import DEFAULT_CHUNK_ROWS, chunked_window

SERIES = "series_id"


def split_label(label_pos, train_end, val_end):
    """The label's position decides; windows may straddle a boundary."""
    return (F.when(label_pos < train_end, F.lit("train"))
             .when(label_pos < val_end, F.lit("val"))
             .otherwise(F.lit("test")))


def fill_and_window(feats: DataFrame, n_features: int, fill_idx: list[int], ffill_limit: int = 3,
                    window: int = 8, horizon: int = 1, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """W1 + W2-W4 + P11 in one exchange.

    ``feats``: grid rows ``(series_id, idx, ts, target, _f0.._fk)`` before the
    forward fill.  Stage 1 fills the features in ``fill_idx`` (at most
    ``ffill_limit`` steps), stage 2 collects the unscaled feature vectors of
    rows t-7..t over the filled values.  Returns every grid row with filled
    ``_f*`` (for the parameter fit) and, on complete windows only, ``seq_raw``,
    ``hist``, ``y_raw``, ``target_ts`` and ``complete = true``."""
    fill_set = set(fill_idx) if ffill_limit > 0 else set()

    def fill(w: WindowSpec):
        frame = w.rowsBetween(-ffill_limit, 0)
        return [F.last(f"_f{i}", ignorenulls=True).over(frame).alias(f"_ff{i}") for i in sorted(fill_set)]

    def collect(w: WindowSpec):
        frame = w.rowsBetween(-(window - 1), 0)
        vec = F.array(*[F.col(f"_ff{i}") if i in fill_set else F.col(f"_f{i}") for i in range(n_features)])
        return [F.collect_list(vec).over(frame).alias("_seq"),
                F.collect_list("target").over(frame).alias("_hist"),
                F.count("target").over(frame).alias("_n_hist"),
                F.lead("target", horizon).over(w).alias("_y_next"),
                F.lead("ts", horizon).over(w).alias("_ts_next")]

    stages = ([fill] if fill_set else []) + [collect]
    out = chunked_window(feats, [SERIES], "idx", before=window - 1 + (ffill_limit if fill_set else 0),
                         after=horizon, build=stages, chunk_rows=chunk_rows)
    complete = (F.col("idx") >= window - 1) & (F.col("_n_hist") == window) & F.col("_y_next").isNotNull()
    on = lambda c: F.when(complete, F.col(c))
    feats_out = [F.col(f"_ff{i}" if i in fill_set else f"_f{i}").alias(f"_f{i}") for i in range(n_features)]
    return out.select(SERIES, "idx", "ts", "target", *feats_out, on("_seq").alias("seq_raw"),
                      on("_hist").alias("hist"), on("_y_next").alias("y_raw"), on("_ts_next").alias("target_ts"),
                      complete.alias("complete"))


def scale_windows(rows: DataFrame, params: DataFrame, horizon: int = 1) -> DataFrame:
    """J2/F3-F6 on the collected arrays after the parameter fit: a map-only
    pass as long as Spark can broadcast the written per-series params."""
    w = rows.where(F.col("complete")).join(params, [SERIES])
    scale_step = lambda step: F.transform(
        step, lambda v, i: (F.coalesce(v, F.element_at("fill_medians", i + 1), F.lit(0.0))
                            - F.element_at("centers", i + 1)) / F.element_at("scales", i + 1))
    return w.select(SERIES, "idx", "target_ts",
                    split_label(F.col("idx") + horizon, F.col("train_end"), F.col("val_end")).alias("split"),
                    F.transform("seq_raw", scale_step).alias("seq"), "hist", "y_raw",
                    standard_scale("y_raw", "y_mean", "y_std").alias("y_scaled"))


def flat_features(seq_col: str = "seq"):
    """Time-major flat vector (index = step * F + feature)."""
    return F.flatten(F.col(seq_col))


def window_counts(windows: DataFrame) -> DataFrame:
    """Windows per series and split."""
    return windows.groupBy(SERIES, "split").agg(F.count(F.lit(1)).alias("windows"))
