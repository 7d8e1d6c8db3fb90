"""Registered model-plane queries, with the protocol's seeds and trials, and
the embeddings quantisation query.

The studies with an oracle use one feature per window (the scaled current
target), for which a ridge fit has a closed form: SQL then follows the trials
table, every fit, the selection by validation, the refit, the scores in target
units and the summary over seeds.  The tree baseline runs the same protocol on
whole windows; it has no SQL form, so its rows are checked by tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import modeling as md
from ..operators import quantize as qz
from ..operators.gram import gramian
from ..session import ensure_checkpoint_dir, materialize, release, remove
from ..sources import tables
from ..sources.sinks import read_groups, write_groups
from ..sources.tables import table
from . import ridgeoracle as ridge
from .catalog import EVENTS_ALL, EVENTS_BY_TYPE, prepared, rnd
from .oracle import r6
from .study import StudyConfig, StudyResult, run_baseline, run_distillation

_STUDIES: dict = {}


def _study(spark: SparkSession, sf_dir: str, kind: str) -> StudyResult:
    """One study per (application, table as it stands, kind), read by several queries."""
    key = (spark.sparkContext.applicationId, sf_dir, tables.version(spark, sf_dir, "events"), kind)
    if key not in _STUDIES:
        p = prepared(spark, sf_dir, EVENTS_ALL)
        current = F.array(F.element_at(F.element_at("seq", -1), 1))
        one = StudyConfig(dataset="events", teacher_kind="linear", features=current, parallelism=8)
        whole = StudyConfig(dataset="events", teacher_kind="linear", parallelism=8)
        if kind == "distill windows":
            _STUDIES[key] = run_distillation(prepared(spark, sf_dir, EVENTS_BY_TYPE), whole)
        elif kind == "distill boosted":
            _STUDIES[key] = run_distillation(prepared(spark, sf_dir, EVENTS_BY_TYPE), StudyConfig(dataset="events", parallelism=8))
        elif kind == "linear windows":
            _STUDIES[key] = run_baseline(prepared(spark, sf_dir, EVENTS_BY_TYPE), whole, "linear")
        elif kind == "distill":
            _STUDIES[key] = run_distillation(p, one)
        elif kind == "linear":
            _STUDIES[key] = run_baseline(p, one, kind)
        else:
            _STUDIES[key] = run_baseline(p, StudyConfig(dataset="events", parallelism=8), kind)
    return _STUDIES[key]


def _fp32(r: DataFrame) -> DataFrame:
    return r.where("precision = 'FP32'").select(
        "dataset", "model", "teacher", "seed", "status", "params", rnd("validation_R2"), rnd("validation_MAE_ugm3"),
        rnd("validation_RMSE_ugm3"), rnd("R2"), rnd("MAE_ugm3"), rnd("RMSE_ugm3"), rnd("MSE_ugm3_sq"))


def q_distill_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher and student FP32 rows of every seed, with their metrics."""
    return _fp32(_study(spark, sf_dir, "distill").results)


def q_distill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11/A12/F10 over the E1 seeds."""
    s = _study(spark, sf_dir, "distill").summary.where("precision = 'FP32'")
    return s.select("dataset", "model", "teacher", "number_of_seeds", rnd("R2_mean"), rnd("R2_std"), rnd("MAE_ugm3_mean"), rnd("RMSE_ugm3_mean"))


def q_distill_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction rows of E1 per series, split, model, precision and seed."""
    p = _study(spark, sf_dir, "distill").predictions
    return p.groupBy("series_id", "split", "model", "teacher", "precision", "seed").agg(F.count(F.lit(1)).alias("rows"), F.count("predicted").alias("predicted"))


def q_distill_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4/M5: every trial of E1 with its drawn specification and score."""
    t = _study(spark, sf_dir, "distill").trials
    return t.select("stage", "seed", "trial", rnd(F.col("l2") * 1e6, "l2_e6"), rnd(F.coalesce("kd_alpha", F.lit(-1.0)), "kd_alpha"),
                    "status", "params", rnd("validation_R2"), rnd("validation_RMSE_ugm3"))


def q_distill_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows a study leaves, and that no seed failed."""
    r = _study(spark, sf_dir, "distill")
    rows = r.results.select("model", "teacher", "seed", "precision", "status", "params",
                            F.col("tflite_size_KB").isNull().alias("no_device_size"),
                            F.when(F.col("precision") == "INT8", F.col("model_size_KB").isNull()).otherwise(F.col("model_size_KB") > 0).alias("size_ok"))
    return rows.withColumn("failed_seeds", F.lit(r.failures.count()))


def q_distill_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1-Q4: the student of every seed through 8-bit inputs and outputs: its
    calibration, scores, drop against FP32 and saturation rates."""
    r = _study(spark, sf_dir, "distill")
    rates = [rnd(f"{v}{side}_saturation_rate") for v in ("validation_", "") for side in ("input", "output")]
    rows = r.results.where("precision = 'INT8'").select(
        "dataset", "model", "teacher", "seed", "status", rnd("validation_R2"), rnd("validation_MAE_ugm3"), rnd("validation_RMSE_ugm3"), rnd("R2"),
        rnd("MAE_ugm3"), rnd("RMSE_ugm3"), rnd("quantization_R2_drop"), *rates)
    cal = r.quantization.select("seed", "model", rnd("in_scale"), "in_zero_point", rnd("out_scale"), "out_zero_point")
    return rows.join(cal, ["seed", "model"])


def q_distill_specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the selected specification that each result row carries, read back
    from its JSON: the dimensions in order and their values."""
    r, spec = _study(spark, sf_dir, "distill").results, F.col("specification")
    return r.select("model", "precision", "seed", F.array_join(F.json_object_keys(spec), ",").alias("dimensions"),
                    rnd(F.get_json_object(spec, "$.l2").cast("double") * 1e6, "l2_e6"), rnd(F.get_json_object(spec, "$.kd_alpha").cast("double"), "kd_alpha"))


#: Seeds that ``q_sink_rerun`` writes a second time.
RERUN_SEEDS = (7, 42)


def q_sink_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1's predictions written by seed, two seeds then written again
    with other values (one unit higher) in other files; what is read back holds
    every seed once.  FP32 rows, per seed and model."""
    p = _study(spark, sf_dir, "distill").predictions.where("precision = 'FP32'")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hourloom/rerun-{uuid.uuid4().hex[:12]}"
    try:
        write_groups(p, path, StudyConfig.seeds)
        again = p.where(F.col("seed").isin(*RERUN_SEEDS)).withColumn("predicted", F.col("predicted") + 1.0)
        for _ in range(2):  # a rerun of a rerun changes nothing
            write_groups(again, path, RERUN_SEEDS)
        back = read_groups(spark, path, p.schema)
        found = back.groupBy("seed", "model").agg(F.count(F.lit(1)).alias("rows"), rnd(F.avg("predicted"), "mean_predicted"),
                                                  rnd(F.avg("observed"), "mean_observed"))
        return materialize(found, "rerun-read")  # a row per seed and model
    finally:
        remove(spark, path)


def q_baseline_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 with the ridge learner."""
    return _fp32(_study(spark, sf_dir, "linear").results)


def q_baseline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 with a decision tree on whole windows, FP32 and INT8."""
    r = _study(spark, sf_dir, "decision_tree").results
    return r.select("dataset", "model", "seed", "precision", "status", "params", "epochs_completed", rnd("validation_R2"), rnd("R2"), rnd("quantization_R2_drop"), "specification")


def _whole(r: DataFrame) -> DataFrame:
    return r.select("dataset", "model", "teacher", "seed", "precision", "status", "params", rnd("validation_R2"), rnd("R2"), rnd("MAE_ugm3"), rnd("RMSE_ugm3"),
                    rnd("quantization_R2_drop"), rnd("input_saturation_rate"), rnd("output_saturation_rate"), "specification")


def q_distill_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 on whole windows of the series by type, FP32 and INT8 (linear teacher)."""
    return _whole(_study(spark, sf_dir, "distill windows").results)


def q_distill_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 with its default teacher, boosted trees, on whole windows of the series by type."""
    return _whole(_study(spark, sf_dir, "distill boosted").results)


def q_boosted_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4/M5: every teacher trial of the boosted E1 (whole numbers and choices
    drawn), how it ended, and that early stopping kept within its rounds."""
    t = _study(spark, sf_dir, "distill boosted").trials.where("stage = 'teacher'")
    return t.select("seed", "trial", "max_depth", "max_iter", "step_size", "subsampling_rate", "status",
                    F.col("epochs_completed").between(F.lit(1), F.col("max_iter")).alias("within_rounds"), F.col("validation_R2").isNotNull().alias("scored"))


def q_baseline_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 with the ridge learner on whole windows of the series by type."""
    return _whole(_study(spark, sf_dir, "linear windows").results)


def q_ridge_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments that ridge searches on whole windows are solved from."""
    p = prepared(spark, sf_dir, EVENTS_BY_TYPE)
    rows = md.model_rows(p.windows, p.target_params)
    found = []
    if not rows.where("split = 'train'").isEmpty():
        g = gramian(rows)
        k = len(g.mean)
        found = [(i, j, g.n, float(g.mean[i]), float(g.cov[i, j])) for i in range(k) for j in range(i, k)]  # features squared, whatever the rows
    release(rows)
    out = spark.createDataFrame(found, "i long, j long, train_windows long, mean_i double, covariance double")
    return out.select("i", "j", "train_windows", rnd("mean_i"), rnd("covariance"))


# ------------------------------------------------------- embeddings

def q_embeddings_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-tensor calibration over all embedding values, then per label:
    saturation rate (input side), mean absolute dequantisation error, and
    the sum of codes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label",
                                                   F.col("embedding").cast("array<double>").alias("v"))
    cal = qz.calibrate(e, F.col("v"))
    j = e.crossJoin(F.broadcast(cal))  # one-row side
    s, z = F.col("scale"), F.col("zero_point")
    hits, total = qz.input_saturation_counts(F.col("v"), s, z)
    codes = F.transform("v", lambda x: qz.fake_quant(x, s, z)[0])
    deq = qz.fake_quant_array(F.col("v"), s, z)
    err = F.aggregate(F.zip_with("v", deq, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b)
    per = j.select("label", hits.alias("h"), total.alias("n"), err.alias("err"),
                   F.aggregate(codes, F.lit(0.0), lambda a, b: a + b).alias("code_sum"))
    return per.groupBy("label").agg(
        (F.sum("h") / F.greatest(F.lit(1), F.sum("n"))).alias("input_saturation_rate"),
        rnd(F.sum("err") / F.sum("n"), "mean_abs_error"),
        F.sum("code_sum").cast("long").alias("code_sum"),
        F.sum("n").alias("values"))


def sql_embeddings_quantized() -> str:
    return f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT vec_id, label, unnest(v) AS x FROM e),
c0 AS (SELECT least(min(x), 0.0) AS lo, greatest(max(x), 0.0) AS hi FROM x),
c AS (SELECT (hi - lo) / 255.0 AS s, lo FROM c0),
cz AS (SELECT s, CASE WHEN s > 0 THEN least(greatest(round_even(-128.0 - lo / s, 0), -128.0), 127.0) END AS z FROM c),
q AS (SELECT x.label, x.x, round_even(x.x / cz.s + cz.z, 0) AS raw, cz.s, cz.z FROM x CROSS JOIN cz),
qq AS (SELECT label, x, raw, least(greatest(raw, -128.0), 127.0) AS code, s, z FROM q)
SELECT label, sum(CASE WHEN raw < -128 OR raw > 127 THEN 1 ELSE 0 END) / greatest(1, count(*)) AS input_saturation_rate,
       {r6('sum(abs(x - (code - z) * s)) / count(*)')} AS mean_abs_error,
       CAST(sum(code) AS BIGINT) AS code_sum, count(*) AS "values"
FROM qq GROUP BY label"""


def registered() -> dict:
    return {"distill_results_events": q_distill_results, "distill_summary_events": q_distill_summary,
            "distill_predictions_events": q_distill_predictions, "distill_trials_events": q_distill_trials,
            "distill_status_events": q_distill_status, "distill_int8_events": q_distill_int8, "distill_specifications_events": q_distill_specifications,
            "sink_rerun_events": q_sink_rerun, "baseline_results_events": q_baseline_results,
            "baseline_tree_events": q_baseline_tree,
            "distill_windows_events": q_distill_windows, "baseline_windows_events": q_baseline_windows,
            "distill_boosted_events": q_distill_boosted, "boosted_trials_events": q_boosted_trials, "ridge_moments_events": q_ridge_moments, "embeddings_quantized": q_embeddings_quantized}


def registered_sql() -> dict:
    return {"embeddings_quantized": sql_embeddings_quantized(), **ridge.registered_sql()}
