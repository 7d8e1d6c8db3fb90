"""Evaluation plane: metrics (A8), distillation loss (A9), grouped seed
statistics (A11, A12, F10), objective (F9), quantisation R2 drop (F11), spec
JSON (F12), best-so-far curve (W6), best trial (T1), accuracy-vs-size table
(T2), unions (U1-U3), label pairing (J3) and prediction frames (J4).

Every aggregate here is algebraic (sums, counts, min/max, var), so Catalyst
runs it as partial + final hash aggregation: a group holding a third of all
prediction rows is pre-reduced in every task before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scaling import objective

# The metric columns summarised over seeds, in the reference's order.
SEED_METRICS = ["validation_R2", "validation_MAE_ugm3", "validation_RMSE_ugm3", "R2", "MAE_ugm3", "RMSE_ugm3",
                "MSE_ugm3_sq", "params", "model_size_KB", "tflite_size_KB", "quantization_R2_drop",
                "input_saturation_rate", "output_saturation_rate"]
RESULT_KEYS = ["dataset", "model", "teacher", "precision"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def metric_columns(y: str = "observed", p: str = "predicted") -> list[Column]:
    """A8 aggregate columns: R2, MAE, RMSE, MSE (+ n).  R2 follows the usual
    convention for a constant truth: 1.0 for a perfect fit, else 0.0; NULL
    below two rows."""
    e = _c(y) - _c(p)
    sse = F.sum(e * e)
    sst = F.count(e) * F.var_pop(_c(y))
    r2 = (F.when(F.count(e) < 2, F.lit(None).cast("double"))
           .when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
           .otherwise(F.lit(1.0) - sse / sst))
    mse = F.avg(e * e)
    return [r2.alias("R2"), F.avg(F.abs(e)).alias("MAE_ugm3"), F.sqrt(mse).alias("RMSE_ugm3"),
            mse.alias("MSE_ugm3_sq"), F.count(e).alias("n")]


def regression_metrics(pred: DataFrame, keys: list[str], y: str = "observed", p: str = "predicted") -> DataFrame:
    """A8 per group; rows with a NULL observation or prediction are skipped."""
    valid = pred.where(_c(y).isNotNull() & _c(p).isNotNull())
    return valid.groupBy(*keys).agg(*metric_columns(y, p))


def distillation_loss(df: DataFrame, keys: list[str], alpha: float | Column, y: str = "y_scaled",
                      t: str = "teacher_scaled", p: str = "predicted_scaled") -> DataFrame:
    """Alpha * MSE(hard) + (1 - alpha) * MSE(teacher)."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    hard = F.avg((_c(y) - _c(p)) ** 2)
    soft = F.avg((_c(t) - _c(p)) ** 2)
    return df.groupBy(*keys).agg((a * hard + (F.lit(1.0) - a) * soft).alias("distillation_loss"),
                                 hard.alias("hard_mse"), soft.alias("soft_mse"))


def kd_label(alpha: float | Column, y: str = "y_scaled", t: str = "teacher_scaled") -> Column:
    """M2 blended label: for squared error, alpha(y-p)^2 + (1-alpha)(t-p)^2 =
    (p - [alpha y + (1-alpha) t])^2 + const, so distillation is regression on it."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return a * _c(y) + (F.lit(1.0) - a) * _c(t)


def pair_teacher(hard: DataFrame, soft: DataFrame, keys: list[str] = ("series_id", "target_ts"),
                 check: bool = True) -> DataFrame:
    """Pair each hard label with the teacher prediction by key; with
    ``check`` a label without a prediction, or with several, raises (one
    aggregate over the keys alone)."""
    keys = list(keys)
    if check:
        times = soft.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        bad = hard.select(*keys).join(times, keys, "left").agg(
            F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_n") > 1).alias("repeated")).first()
        if bad["missing"] or bad["repeated"]:
            raise ValueError(f"teacher predictions: {bad['missing']} labels have none, {bad['repeated']} have several")
    return hard.join(soft, keys, "inner")


def prediction_frame(df: DataFrame, observed: str, predicted: str, split: str | Column, precision: str,
                     model: str, teacher: str, seed: int | Column | None,
                     time_col: str = "target_ts", series_col: str = "series_id") -> DataFrame:
    """Long prediction rows; keys travel with the row, no positional zip.
    Splits are named as in the reference's prediction files (``validation``)."""
    sp = _c(split) if not isinstance(split, str) or split in df.columns else F.lit(split)
    sp = F.when(sp == "val", F.lit("validation")).otherwise(sp)
    sd = seed if isinstance(seed, Column) else F.lit(seed).cast("int")
    return df.select(F.col(series_col).alias("series_id"), F.col(time_col).alias("timestamp"), sp.alias("split"),
                     F.lit(model).alias("model"), F.lit(teacher).alias("teacher"),
                     F.lit(precision).alias("precision"), sd.alias("seed"),
                     F.col(observed).alias("observed"), F.col(predicted).alias("predicted"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name, filling columns missing from some frames."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def seed_statistics(results: DataFrame, keys: list[str] = RESULT_KEYS, metrics: list[str] | None = None) -> DataFrame:
    """Mean, sample std (NULL for one value), min, max, non-null count of
    every metric per group; NULL group keys are kept as a group."""
    metrics = [m for m in (metrics or SEED_METRICS) if m in results.columns]
    aggs = []
    for m in metrics:
        x = F.col(m).cast("double")
        aggs += [F.avg(x).alias(f"{m}__mean"), F.stddev_samp(x).alias(f"{m}__std"), F.min(x).alias(f"{m}__min"),
                 F.max(x).alias(f"{m}__max"), F.count(x).alias(f"{m}__count")]
    return results.groupBy(*keys).agg(*aggs)


def seed_summary(results: DataFrame, keys: list[str] = RESULT_KEYS, metrics: list[str] | None = None,
                 replicate_col: str = "seed", count_name: str = "number_of_seeds") -> DataFrame:
    """A12 + F10: distinct replicates, and per metric the mean, the std (0.0
    for one value) and the text ``mean ± std`` with 6 decimals ("" when the
    metric has no value)."""
    metrics = [m for m in (metrics or SEED_METRICS) if m in results.columns]
    aggs = [F.count_distinct(replicate_col).alias(count_name)]
    for m in metrics:
        x = F.col(m).cast("double")
        aggs += [F.avg(x).alias(f"{m}_mean"), F.stddev_samp(x).alias(f"_{m}_sd"), F.count(x).alias(f"_{m}_n")]
    g = results.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys] + [F.col(count_name)]
    for m in metrics:
        std = F.when(F.col(f"_{m}_n") == 0, F.lit(None).cast("double")).otherwise(
            F.coalesce(F.col(f"_{m}_sd"), F.lit(0.0)))
        text = F.when(F.col(f"_{m}_n") == 0, F.lit("")).otherwise(
            F.format_string("%.6f ± %.6f", F.col(f"{m}_mean"), std))
        out += [F.col(f"{m}_mean"), std.alias(f"{m}_std"), text.alias(f"{m}_mean_std")]
    return g.select(*out)


def best_so_far(trials: DataFrame, keys: list[str] = ("stage", "seed"), order: str = "trial",
                score: str = "validation_R2") -> DataFrame:
    """Running max of the score over successful trials in trial order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return trials.where(F.col(score).isNotNull()).withColumn("best_so_far_R2", F.max(score).over(w))


def with_objective(trials: DataFrame, score: str = "validation_R2") -> DataFrame:
    """F9 column ``objective_1_minus_validation_R2``."""
    return trials.withColumn("objective_1_minus_validation_R2", objective(score))


def best_trial(trials: DataFrame, keys: list[str] = ("stage", "seed"), spec_cols: list[str] | None = None,
               obj: str = "objective_1_minus_validation_R2", order: str = "trial") -> DataFrame:
    """The trial with the lowest objective per group, ties to the first
    trial (failed trials score 1e6 and still take part)."""
    spec_cols = spec_cols or [c for c in trials.columns if c not in (*keys, obj, order)]
    best = F.min_by(F.struct(F.col(order), *[F.col(c) for c in spec_cols]), F.struct(F.col(obj), F.col(order)))
    return (trials.groupBy(*keys).agg(best.alias("_b"), F.min(obj).alias(obj))
            .select(*keys, F.col(f"_b.{order}").alias(order), *[F.col(f"_b.{c}").alias(c) for c in spec_cols], obj))


def tradeoff(trials: DataFrame, keys: list[str] = ("stage", "seed"), size: str = "params",
             score: str = "validation_R2") -> DataFrame:
    """Successful trials' size against score, with a Pareto flag (no
    smaller-or-equal trial scores at least as well before it in size order)."""
    ok = trials.where(F.col(score).isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.col(size), F.col(score).desc(), F.col("trial")).rowsBetween(
        Window.unboundedPreceding, -1)
    prev = F.max(score).over(w)
    return ok.select(*keys, "trial", size, score, (prev.isNull() | (F.col(score) > prev)).alias("pareto"))


def spec_json(spec_cols: list[str]) -> Column:
    """sorted-key JSON text of a specification."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(spec_cols)]))


def quantization_drop(results: DataFrame, keys: list[str] = ("dataset", "model", "teacher", "seed")) -> DataFrame:
    """FP32 test R2 minus INT8 test R2 on the INT8 rows; 0.0 on the
    FP32 row of a model that has an INT8 row; NULL otherwise (teachers)."""
    keys = list(keys)
    fp = results.where(F.col("precision") == "FP32").select(*keys, F.col("R2").alias("_fp32_R2"))
    has_int8 = results.where(F.col("precision") == "INT8").select(*keys).distinct().withColumn("_has_int8", F.lit(True))
    j = results.join(fp, keys, "left").join(has_int8, keys, "left")
    drop = (F.when(F.col("precision") == "INT8", F.col("_fp32_R2") - F.col("R2"))
             .when(F.col("_has_int8"), F.lit(0.0)))
    return j.withColumn("quantization_R2_drop", drop).drop("_fp32_R2", "_has_int8")
