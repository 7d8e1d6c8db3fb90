"""Leakage-safe feature parameters and their application.

A6 split points, P9/P10 feature order, A3 train-only medians, A4 exact robust
scaler, A5 target scaler, J2 application.  Parameters are fitted on training
rows only (``idx < train_end``) and come out as small per-series tables: one
wide row per series (arrays in feature order) for applying, and the long
``feature_params`` table as the persisted form (S4).

Quantiles are exact (MLlib's RobustScaler is approximate), with bounded state
(``operators.quantiles``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cols import qc
from ..functions.calendar import CALENDAR_FEATURES, calendar_columns
from ..functions.numeric import nonfinite_to_null
from ..functions.scaling import nonzero_scale
from .quantiles import filled_quartiles

SERIES = "series_id"
CURRENT_NAME = "PM2.5_current"


@dataclass
class FeatureLayout:
    """Fixed feature order (P10): value columns in file order with the target
    copy renamed (P9), then the four calendar columns."""

    value_cols: list[str]       # source columns in file order (target included)
    target: str
    current_name: str           # feature name of the target copy

    @property
    def names(self) -> list[str]:
        return [self.current_name if c == self.target else c for c in self.value_cols] + CALENDAR_FEATURES


def feature_layout(value_cols: list[str], target: str, current_name: str = CURRENT_NAME) -> FeatureLayout:
    name = current_name
    while name in value_cols and name != target:
        name += "_input"
    return FeatureLayout(list(value_cols), target, name)


def split_points(bounds: DataFrame, train_fraction: float = 0.70,
                 validation_fraction: float = 0.15) -> DataFrame:
    """``int(n * 0.70)`` and ``int(n * (0.70 + 0.15))`` in binary floating
    point (DOUBLE literals, never DECIMAL)."""
    upper = float(train_fraction) + float(validation_fraction)
    return bounds.select(SERIES, "n",
                         F.floor(F.col("n") * F.lit(float(train_fraction))).cast("long").alias("train_end"),
                         F.floor(F.col("n") * F.lit(upper)).cast("long").alias("val_end"))


def feature_frame(hourly: DataFrame, layout: FeatureLayout) -> DataFrame:
    """Hourly rows with every feature column (non-finite -> NULL) under
    positional names ``_f0, _f1, ...`` (feature order) plus the untouched
    ``target``."""
    feats = [nonfinite_to_null(qc(c)) for c in layout.value_cols] + calendar_columns("ts")
    return hourly.select(SERIES, "idx", "ts", qc(layout.target).alias("target"),
                         *[f.alias(f"_f{i}") for i, f in enumerate(feats)])


def fit_params(feats: DataFrame, splits: DataFrame, layout: FeatureLayout) -> DataFrame:
    """A3 + A4 + A5 on training rows; one row per series:
    ``(series_id, n, train_end, val_end, fill_medians, centers, scales,
    y_mean, y_std, train_targets)``.  A series without training rows keeps its
    row, with null statistics and no train targets."""
    k = len(layout.names)
    train = feats.join(splits.select(SERIES, "train_end"), [SERIES]).where(F.col("idx") < F.col("train_end"))
    # A3: medians of the raw features (NULLs skipped; 0.0 if none); A4: quartiles of the median-filled ones
    rob = filled_quartiles(train, [SERIES], [F.col(f"_f{i}") for i in range(k)])
    # A5: target scaler on finite training targets (unfilled)
    tgt = train.groupBy(SERIES).agg(F.avg("target").alias("y_mean"), F.stddev_pop("target").alias("_y_std"),
                                    F.count("target").alias("train_targets"))
    return (splits.join(tgt, SERIES, "left").join(rob, SERIES, "left")
            .select(SERIES, "n", "train_end", "val_end",
                    F.array(*[F.col(f"_m{i}") for i in range(k)]).alias("fill_medians"),
                    F.array(*[F.col(f"_m{i}") for i in range(k)]).alias("centers"),
                    F.array(*[nonzero_scale(F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i in range(k)]).alias("scales"),
                    "y_mean", nonzero_scale("_y_std").alias("y_std"),
                    F.coalesce("train_targets", F.lit(0)).alias("train_targets")))


def fitted(params: DataFrame) -> DataFrame:
    """The series that had training rows (a median is never null there)."""
    return params.where(F.col("fill_medians")[0].isNotNull())


def feature_params_long(params: DataFrame, layout: FeatureLayout) -> DataFrame:
    """S4 form: ``(series_id, feature, ord, fill_median, center, scale)``."""
    names = F.array(*[F.lit(n) for n in layout.names])
    z = F.arrays_zip(names.alias("feature"), F.col("fill_medians").alias("fill_median"),
                     F.col("centers").alias("center"), F.col("scales").alias("scale"))
    return (fitted(params).select(SERIES, F.posexplode(z).alias("ord", "p"))
            .select(SERIES, F.col("p.feature").alias("feature"), F.col("ord").cast("int").alias("ord"),
                    F.col("p.fill_median").alias("fill_median"), F.col("p.center").alias("center"),
                    F.col("p.scale").alias("scale")))


def target_params(params: DataFrame) -> DataFrame:
    return params.select(SERIES, "y_mean", "y_std", "train_end", "val_end", "n")
