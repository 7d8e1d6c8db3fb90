"""Modelling plane on MLlib: distributed fits over the pooled windows.

M4 trials table (deterministic sampler over Integer / Categorical / Real
uniform / Real log-uniform domains), M5 trial evaluation with failure
isolation, M1/M3 learners, M2 distillation as regression on a blended label,
M7 scoring back to target units, M8 history, M9 validation early stop
(GBT), M10 size, M12 soft labels, S5 model sink and size.

``model_rows`` writes what every fit and score reads, once per study: keys,
split, feature vector, labels and the series' target scaling.  Every fit is a
distributed MLlib job over that table, and several trials run at once from a
driver thread pool; the trials of a linear learner are solved together from
the moments of the train rows (``gram``), and trials of a boosted learner that
differ in rounds share a fit (``boost``).  Nothing but hyper-parameters,
moments of the features and metric rows passes the driver.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scaling import inverse_standard
from ..session import materialize
from . import boost, gram
from . import evaluate as ev
from .gram import LabelMoments

SERIES = "series_id"


# ----------------------------------------------------------------- M4 domains

@dataclass(frozen=True)
class Integer:
    name: str
    low: int
    high: int


@dataclass(frozen=True)
class Categorical:
    name: str
    values: tuple


@dataclass(frozen=True)
class Real:
    name: str
    low: float
    high: float
    prior: str = "uniform"   # or "log-uniform"


# MLlib search spaces (our choice of MLlib parameters; the l2 and kd_alpha
# ranges are the flagship's student ranges).  A boosted learner's rounds are free
# and the rest is drawn from few values, so that trials share fits (``boost``).
TEACHER_SPACE = (Integer("max_depth", 2, 4), Integer("max_iter", 10, 40),
                 Categorical("step_size", (0.05, 0.1, 0.2)), Categorical("subsampling_rate", (0.75, 1.0)))
STUDENT_SPACE = (Real("l2", 1e-8, 5e-4, "log-uniform"), Real("kd_alpha", 0.25, 1.0))
BASELINE_SPACES = {
    "linear": (Real("l2", 1e-7, 1e-3, "log-uniform"),),
    "decision_tree": (Integer("max_depth", 2, 10), Integer("min_instances", 1, 20)),
    "random_forest": (Integer("num_trees", 10, 60), Integer("max_depth", 3, 8)),
    "gbt": TEACHER_SPACE,
}


def trials_table(spark: SparkSession, space: tuple, n_trials: int, seed: int) -> DataFrame:
    """M4: one row per trial with one typed column per dimension.  A uniform
    draw per (seed, trial, dimension) is the leading 32 bits of an MD5 digest,
    so the table is reproducible in any engine and computed by Spark, not a
    driver RNG."""
    base = spark.range(1, n_trials + 1).select(F.col("id").cast("int").alias("trial"))
    cols = [F.col("trial")]
    for i, dim in enumerate(space):
        text = F.concat_ws("|", F.lit(str(seed)), F.col("trial").cast("string"), F.lit(str(i)), F.lit(dim.name))
        u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))
        if isinstance(dim, Integer):
            v = (F.lit(dim.low) + F.floor(u * (dim.high - dim.low + 1))).cast("int")
        elif isinstance(dim, Categorical):
            arr = F.array(*[F.lit(x) for x in dim.values])
            v = F.element_at(arr, (F.floor(u * len(dim.values)) + 1).cast("int"))
        elif dim.prior == "log-uniform":
            v = F.exp(F.lit(math.log(dim.low)) + u * F.lit(math.log(dim.high / dim.low)))
        else:
            v = F.lit(dim.low) + u * F.lit(dim.high - dim.low)
        cols.append(v.alias(dim.name))
    return base.select(*cols)


# ----------------------------------------------------------------- rows of the fits

def model_rows(windows: DataFrame, params: DataFrame, features: Column | None = None) -> DataFrame:
    """What all fits and scores read, written once: ``features`` (default: the
    time-major flat window) as a vector, labels, split and target scaling."""
    flat = F.flatten("seq") if features is None else features
    rows = windows.join(params.select(SERIES, "y_mean", "y_std"), [SERIES])
    return materialize(rows.select(SERIES, "idx", "target_ts", "split", array_to_vector(flat).alias("features"),
                                   "y_raw", "y_scaled", "y_mean", "y_std"), "model-rows")


def label_moments(rows: DataFrame) -> LabelMoments:
    t = "teacher_scaled" if "teacher_scaled" in rows.columns else "y_scaled"
    r = rows.where(F.col("split") == "train").agg(
        F.count("y_scaled").alias("n"), F.var_pop("y_scaled").alias("vy"), F.var_pop(t).alias("vt"),
        F.covar_pop("y_scaled", t).alias("c")).first()
    return LabelMoments(r["n"], r["vy"] or 0.0, r["vt"] or 0.0, r["c"] or 0.0)


def build_estimator(kind: str, spec: dict, seed: int, label: str = "y_scaled", early_stop: bool = True,
                    moments: LabelMoments | None = None, iterate: bool = False):
    """M1/M2/M3 learners from a spec row.

    MLlib divides a linear model's penalty by its label's standard deviation,
    so ``l2`` is multiplied by it: the penalty is then ``l2`` whatever the
    blend.  ``iterate`` asks for the iterative solver (its objective history is
    M8); otherwise the normal equations are solved in one pass."""
    if kind in ("gbt", "teacher"):
        kw = dict(maxDepth=int(spec["max_depth"]), maxIter=int(spec["max_iter"]), stepSize=float(spec["step_size"]),
                  subsamplingRate=float(spec["subsampling_rate"]), seed=seed, labelCol=label, featuresCol="features")
        if early_stop:
            kw.update(validationIndicatorCol="is_val", validationTol=0.01)
        return GBTRegressor(**kw)
    if kind in ("linear", "student"):
        spread = moments.std(float(spec.get("kd_alpha", 1.0)), sample=iterate) if moments else 1.0
        return LinearRegression(regParam=float(spec["l2"]) * spread, elasticNetParam=0.0, standardization=False,
                                solver="l-bfgs" if iterate else "normal", maxIter=200, tol=1e-10,
                                labelCol=label, featuresCol="features")
    if kind == "decision_tree":
        return DecisionTreeRegressor(maxDepth=int(spec["max_depth"]), minInstancesPerNode=int(spec["min_instances"]),
                                     seed=seed, labelCol=label, featuresCol="features")
    if kind == "random_forest":
        return RandomForestRegressor(numTrees=int(spec["num_trees"]), maxDepth=int(spec["max_depth"]), seed=seed,
                                     labelCol=label, featuresCol="features")
    raise ValueError(f"unknown learner {kind!r}")


def param_count(model) -> int:
    """linear = coefficients + intercept; trees = total nodes."""
    if hasattr(model, "coefficients"):
        return int(model.numFeatures) + 1
    if hasattr(model, "totalNumNodes"):
        return int(model.totalNumNodes)
    return int(model.numNodes)


def history(model, data: DataFrame | None = None) -> list[float]:
    """M8: objective per iteration (linear, iterative solver) or loss per tree
    (GBT, on data); a model fitted in one step has none."""
    if hasattr(model, "coefficients"):
        values = list(model.summary.objectiveHistory) if model.hasSummary else []
        return values if len(values) > 1 else []
    if hasattr(model, "evaluateEachIteration") and data is not None:
        return list(model.evaluateEachIteration(data, "squared"))
    return []


def epochs(model) -> int | None:
    """Boosting rounds or trees of an ensemble, iterations of an iterative
    solve, 1 for a single tree; null for a closed-form solve."""
    if hasattr(model, "coefficients"):
        return len(history(model)) or None
    if hasattr(model, "trees"):
        return int(model.getNumTrees)
    return 1


def labelled(kind: str, spec: dict, rows: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows with the label that the spec asks for (M2: blended)."""
    if "kd_alpha" in spec:
        return rows.withColumn("kd_label", blended_label(float(spec["kd_alpha"]))), "kd_label"
    return rows, label


def fit(kind: str, spec: dict, seed: int, rows: DataFrame, label: str = "y_scaled",
        moments: LabelMoments | None = None, iterate: bool = False, early_stop: bool = True):
    """Fit on train windows; GBT also gets validation rows for early stopping
    (M9) through the indicator column, never as training rows."""
    rows, label = labelled(kind, spec, rows, label)
    if kind in ("linear", "student") and moments is None:
        moments = label_moments(rows)
    est = build_estimator(kind, spec, seed, label, early_stop=early_stop, moments=moments, iterate=iterate)
    if isinstance(est, GBTRegressor) and est.isSet("validationIndicatorCol"):
        data = rows.where(F.col("split").isin("train", "val")).withColumn("is_val", F.col("split") == "val")
    else:
        data = rows.where(F.col("split") == "train")
    return est.fit(data)


def score(model, rows: DataFrame, out: str = "predicted") -> DataFrame:
    """M7: predictions back in target units (F5 with the row's own scaling)."""
    pred = model.transform(rows).withColumnRenamed("prediction", "predicted_scaled")
    return pred.withColumn(out, inverse_standard("predicted_scaled", "y_mean", "y_std"))


# Output columns of a trial (fixed names of the result contract).
_TRIAL_RESULT = {"stage": "string", "seed": "int", "validation_R2": "double", "validation_MAE_ugm3": "double",
                 "validation_RMSE_ugm3": "double", "params": "long", "epochs_completed": "int", "status": "string",
                 "error": "string"}


def evaluate_trials(kind: str, trials: DataFrame, rows: DataFrame, seed: int, label: str = "y_scaled",
                    parallelism: int = 4, stage: str = "search", moments: gram.Gramian | None = None,
                    pool: ThreadPoolExecutor | None = None) -> DataFrame:
    """M5: fit every trial, score validation (A8 in target units), keep a
    failed row (NULL metrics, objective 1e6, the whole error text) for any
    trial that raises.  Linear learners: one pass for the moments (none if
    given) and one for all trials' scores.  Boosted learners: a fit and a pass of
    scores per family of trials that differ in rounds alone.  ``pool`` (default:
    one of ``parallelism`` threads) runs the fits and may serve several searches."""
    spark = rows.sparkSession
    specs = [r.asDict() for r in trials.orderBy("trial").collect()]   # n_trials rows of hyper-parameters
    if kind in ("linear", "student"):
        moments = moments or gram.gramian(rows, (label, "teacher_scaled") if any("kd_alpha" in s for s in specs) else (label,))
        found = [dict.fromkeys(_TRIAL_RESULT) | {k: r[k] for k in trials.columns} | {"stage": stage, "seed": seed, "status": r["status"], "error": r["error"]}
                 | ({"validation_R2": r["R2"], "validation_MAE_ugm3": r["MAE_ugm3"], "validation_RMSE_ugm3": r["RMSE_ugm3"], "params": moments.width + 1}
                    if r["status"] == "success" else {"epochs_completed": 0}) for r in gram.search(specs, rows, moments, label)]
        return _trial_rows(spark, trials, found)
    if kind in ("gbt", "teacher"):
        def longest(spec: dict, early_stop: bool):
            return fit(kind, spec, seed, rows, label, early_stop=early_stop)

        found = [dict.fromkeys(_TRIAL_RESULT) | {k: r[k] for k in trials.columns} | {"stage": stage, "seed": seed, "status": r["status"], "error": r["error"]}
                 | ({"validation_R2": r.get("R2"), "validation_MAE_ugm3": r.get("MAE_ugm3"), "validation_RMSE_ugm3": r.get("RMSE_ugm3"),
                     "params": r["nodes"], "epochs_completed": r["rounds"]} if r["status"] == "success" else {"epochs_completed": 0})
                 for r in boost.search(specs, rows, longest, parallelism, pool)]
        return _trial_rows(spark, trials, found)
    val = rows.where(F.col("split") == "val")

    def run(spec: dict) -> dict:
        row = dict.fromkeys(_TRIAL_RESULT) | spec | {"stage": stage, "seed": seed}
        try:
            model = fit(kind, spec, seed, rows, label)
            m = ev.regression_metrics(score(model, val), [], "y_raw", "predicted").collect()[0]
            return row | {"validation_R2": m["R2"], "validation_MAE_ugm3": m["MAE_ugm3"], "validation_RMSE_ugm3": m["RMSE_ugm3"],
                          "params": param_count(model), "epochs_completed": epochs(model), "status": "success", "error": ""}
        except Exception as e:  # noqa: BLE001 - failure isolation per trial
            return row | {"epochs_completed": 0, "status": "failed", "error": repr(e)}

    with nullcontext(pool) if pool else ThreadPoolExecutor(max_workers=max(1, parallelism)) as workers:
        found = list(workers.map(run, specs))
    return _trial_rows(spark, trials, found)


def _trial_rows(spark: SparkSession, trials: DataFrame, found: list[dict]) -> DataFrame:
    """The trials with their results and objectives."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in trials.schema.fields]
                       + [f"{c} {t}" for c, t in _TRIAL_RESULT.items()])
    names = [*trials.columns, *_TRIAL_RESULT]
    return ev.with_objective(spark.createDataFrame([tuple(r[c] for c in names) for r in found], schema))


def soft_labels(teacher, rows: DataFrame) -> DataFrame:
    """Teacher predictions (scaled) kept on the same window rows."""
    return teacher.transform(rows).withColumnRenamed("prediction", "teacher_scaled")


def save_model(model, path: str) -> float:
    """Write the model and return its size in KB (bytes / 1024)."""
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    size = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .agg(F.sum("length")).collect()[0][0])
    return float(size or 0) / 1024.0


def blended_label(alpha: float | Column) -> Column:
    """M2 label column ``kd_label``."""
    return ev.kd_label(alpha, "y_scaled", "teacher_scaled")
