"""Multi-seed studies on the prepared windows (E1 distillation, E2 baseline).

Per seed: search (M4/M5) -> select by validation only (T1) -> refit (M6) ->
soft labels (M12) -> student search on the blended label (M2) -> refit ->
FP32 scoring (M7, A8) -> INT8 column-quantised scoring (J5, Q1-Q4) ->
result rows (U2) and prediction rows (J4, U1).  Seeds that fail become rows
of a failures table (M11); aggregation over seeds is A11/A12/F10.

The rows that fits and scores read are written once per study (and once per
seed with the teacher's labels), persisted while they are in use, and removed
when the study ends; predictions and results are kept.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import modeling as md
from ..operators import quantize as qz
from ..operators import windows as win
from ..operators.gram import Gramian, blend_of, gramian
from ..session import ensure_checkpoint_dir, materialize, release
from ..sources.sinks import read_groups, write_groups, write_json, write_table
from .prepare import Prepared

# Fixed names: the result row of the output contract.
RESULT_SCHEMA = ("dataset string, model string, teacher string, seed int, precision string, "
                 "validation_R2 double, validation_MAE_ugm3 double, validation_RMSE_ugm3 double, "
                 "R2 double, MAE_ugm3 double, RMSE_ugm3 double, MSE_ugm3_sq double, params long, "
                 "model_size_KB double, tflite_size_KB double, quantization_R2_drop double, "
                 "input_saturation_rate double, output_saturation_rate double, epochs_completed int, "
                 "status string, specification string, validation_input_saturation_rate double, "
                 "validation_output_saturation_rate double, error string")
RESULT_FIELDS = [f.strip().split(" ")[0] for f in RESULT_SCHEMA.split(",")]
HISTORY_SCHEMA = "seed int, model string, iteration int, loss double"
#: A student's search has the seed of its study plus this.
STUDENT_SHIFT = 10000
QUANTIZATION_SCHEMA = ("seed int, model string, in_scale double, in_zero_point double, in_scale_ok boolean, "
                       "out_scale double, out_zero_point double, out_scale_ok boolean")


@dataclass
class StudyConfig:
    dataset: str = "dataset"
    seeds: tuple = (42, 123, 2024, 7, 99)
    teacher_trials: int = 30
    student_trials: int = 30
    baseline_trials: int = 60
    teacher_name: str = "teacher"
    student_name: str = "distilled student"
    teacher_kind: str = "gbt"
    evaluate_int8: bool = True
    representative_samples: int = 250
    parallelism: int = 4
    features: Column | None = None   # default: the flat window, time-major
    model_dir: str | None = None     # default: <checkpoint dir>/hourloom/models


@dataclass
class StudyResult:
    results: DataFrame
    predictions: DataFrame | None
    trials: DataFrame | None
    failures: DataFrame
    statistics: DataFrame
    summary: DataFrame
    history: DataFrame                    # M8: (seed, model, iteration, loss)
    convergence: DataFrame | None         # W6: best-so-far validation R2 per trial
    tradeoff: DataFrame | None            # T2: size against validation R2, Pareto flag
    specifications: DataFrame | None      # F12: selected specification per stage and seed
    quantization: DataFrame               # Q1/Q3: the six calibration fields per seed
    seeds: tuple = ()                     # the seeds that were run, failed ones too
    run_record: DataFrame | None = None   # S3: one row about the run, with A13 counts


@dataclass
class _Gathered:
    results: list[dict] = field(default_factory=list)
    predictions: list[DataFrame] = field(default_factory=list)
    trials: list[DataFrame] = field(default_factory=list)
    history: list[tuple] = field(default_factory=list)
    quantization: list[tuple] = field(default_factory=list)
    specifications: list[DataFrame] = field(default_factory=list)
    failures: list[tuple] = field(default_factory=list)

    def add(self, other: _Gathered) -> None:
        for name in self.__dataclass_fields__:
            getattr(self, name).extend(getattr(other, name))


def _metrics(pred: DataFrame) -> dict:
    rows = ev.regression_metrics(pred, ["split"], "y_raw", "predicted").collect()  # <= 3 rows
    return {r["split"]: r.asDict() for r in rows}


def _frame_metrics(frame: DataFrame) -> dict:
    """The same of written prediction rows, whose scores need not be made again."""
    named = frame.withColumn("split", F.when(F.col("split") == "validation", "val").otherwise(F.col("split")))
    return {r["split"]: r.asDict() for r in ev.regression_metrics(named, ["split"], "observed", "predicted").collect()}  # <= 2 rows


def _result(cfg: StudyConfig, model: str, teacher: str, seed: int, precision: str, m: dict, **kw) -> dict:
    v, t = m.get("val", {}), m.get("test", {})
    return dict.fromkeys(RESULT_FIELDS) | dict(
        dataset=cfg.dataset, model=model, teacher=teacher, seed=seed, precision=precision, validation_R2=v.get("R2"),
        validation_MAE_ugm3=v.get("MAE_ugm3"), validation_RMSE_ugm3=v.get("RMSE_ugm3"), R2=t.get("R2"),
        MAE_ugm3=t.get("MAE_ugm3"), RMSE_ugm3=t.get("RMSE_ugm3"), MSE_ugm3_sq=t.get("MSE_ugm3_sq")) | kw


def int8_scores(model, rows: DataFrame, max_samples: int = 250, sample: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Q1-Q3: calibrate on the representative train sample (drawn here if not
    given), then score val/test through quantised inputs and a quantised output."""
    sample = qz.representative_sample(rows, max_samples) if sample is None else sample
    flat = vector_to_array("features")
    seen = model.transform(sample)
    both = qz.calibrate(seen, flat, prefix="in_").crossJoin(qz.calibrate(seen, F.col("prediction"), prefix="out_", array=False))  # one row each
    cal = both.first().asDict()
    if not (cal["in_scale_ok"] and cal["out_scale_ok"]):
        raise RuntimeError("Invalid quantization scale.")
    s_in, z_in, s_out, z_out = (F.lit(float(cal[c])) for c in ("in_scale", "in_zero_point", "out_scale", "out_zero_point"))
    hits, total = qz.input_saturation_counts(flat, s_in, z_in)
    q = rows.where(F.col("split") != "train").withColumns({"in_hits": hits, "in_total": total})
    q = q.withColumn("features", array_to_vector(qz.fake_quant_array(flat, s_in, z_in)))
    code, deq = qz.fake_quant(F.col("predicted_scaled"), s_out, z_out)
    pred = model.transform(q).withColumnRenamed("prediction", "predicted_scaled")
    pred = pred.withColumn("out_sat", qz.output_saturated(code)).withColumn("predicted_scaled", deq)
    return pred.withColumn("predicted", md.inverse_standard("predicted_scaled", "y_mean", "y_std")), cal


class _Shared:
    """What all seeds of a study use alike, made when first asked for: the
    moments of features and labels (one pass) and the calibration sample; and
    the threads that fit the trials of every seed, so that as many run at once
    (and keep their rows in memory) as in the search of a single seed."""

    def __init__(self, rows: DataFrame, samples: int, parallelism: int = 4):
        self.fits = ThreadPoolExecutor(max(1, parallelism))
        self._rows, self._samples, self._found, self._sample, self._lock = rows, samples, None, None, Lock()

    def sample(self) -> DataFrame:
        """The representative train windows' features, written once."""
        with self._lock:
            if self._sample is None:
                self._sample = materialize(qz.representative_sample(self._rows, self._samples).select("features"), "calibration")
            return self._sample

    def release(self) -> None:
        self.fits.shutdown()
        if self._sample is not None:
            release(self._sample)

    def of(self, kind: str, teacher=None, soft: DataFrame | None = None) -> Gramian | None:
        """For a linear learner; with a teacher, its soft labels are one more
        label (of a linear teacher without a pass, else one pass over ``soft``)."""
        if kind not in ("linear", "student"):
            return None
        if teacher is not None and not hasattr(teacher, "coefficients"):
            return gramian(soft, ("y_scaled", "teacher_scaled"))
        with self._lock:
            self._found = self._found or gramian(self._rows)
        if teacher is None:
            return self._found
        return self._found.with_linear_label("teacher_scaled", teacher.coefficients.toArray(), float(teacher.intercept))


def _search(cfg: StudyConfig, kind: str, space: tuple, n: int, rows: DataFrame, seed: int, stage: str, out: _Gathered,
            shared: _Shared, moments: Gramian | None = None) -> dict:
    """The selected specification."""
    tab = md.trials_table(rows.sparkSession, space, n, seed)
    trials = md.evaluate_trials(kind, tab, rows, seed, parallelism=cfg.parallelism, stage=stage, moments=moments, pool=shared.fits)
    dims = [d.name for d in space]
    best = ev.best_trial(trials, keys=["stage", "seed"], spec_cols=dims)
    chosen = best.select("stage", "seed", "trial", *dims, ev.spec_json(dims).alias("specification")).first()
    out.trials.append(trials)
    out.specifications.append(rows.sparkSession.createDataFrame([(stage, seed, chosen["trial"], chosen["specification"])],
                                                                "stage string, seed int, trial int, specification string"))
    return {d: chosen[d] for d in dims} | {"json": chosen["specification"]}


def _refit(cfg: StudyConfig, kind: str, spec: dict, rows: DataFrame, seed: int, name: str, teacher: str, model_dir: str,
           drop: float | None, out: _Gathered, moments: Gramian | None = None):
    """M6-M8: refit on the selected specification, save, score, report.  A
    linear learner is solved at once; its history is that of conjugate gradients
    on the same moments."""
    model = md.fit(kind, spec, seed, rows, moments=moments and moments.label_moments())
    losses = moments.descent(float(spec["l2"]), blend_of(spec)) if moments else md.history(model, rows.where(F.col("split") == "val"))
    rounds = len(losses) if moments else md.epochs(model)
    size = md.save_model(model, f"{model_dir}/seed_{seed}/{name.replace(' ', '_')}")
    pred = md.score(model, rows.where(F.col("split") != "train"))
    frame = ev.prediction_frame(pred, "y_raw", "predicted", "split", "FP32", name, teacher, seed)
    out.predictions.append(materialize(frame, "predictions"))
    m = _frame_metrics(out.predictions[-1])
    out.history += [(seed, name, i + 1, float(v)) for i, v in enumerate(losses)]
    out.results.append(_result(cfg, name, teacher, seed, "FP32", m, params=md.param_count(model), model_size_KB=size,
                               quantization_R2_drop=drop, epochs_completed=rounds, status="success",
                               specification=spec["json"]))
    return model, m | {"epochs": rounds}


def _int8(cfg: StudyConfig, model, rows: DataFrame, spec: dict, seed: int, name: str, teacher: str, fp: dict, out: _Gathered,
          shared: _Shared) -> None:
    """Q2-Q4: the INT8 result row; a stage that fails leaves a row that says so."""
    known = dict(params=md.param_count(model), epochs_completed=fp.get("epochs"), specification=spec["json"])
    try:
        scored, cal = int8_scores(model, rows, cfg.representative_samples, shared.sample())
        m = _metrics(scored)
        sat = {r["split"]: r.asDict() for r in qz.saturation_rates(scored, ["split"]).collect()}
        a, b = fp.get("test", {}).get("R2"), m.get("test", {}).get("R2")
        rate = lambda split, side: sat.get(split, {}).get(f"{side}_saturation_rate")
        row = _result(cfg, name, teacher, seed, "INT8", m, quantization_R2_drop=None if a is None or b is None else a - b,
                      input_saturation_rate=rate("test", "input"), output_saturation_rate=rate("test", "output"),
                      validation_input_saturation_rate=rate("val", "input"), validation_output_saturation_rate=rate("val", "output"),
                      status="strict_int8_success", **known)
        frame = ev.prediction_frame(scored, "y_raw", "predicted", "split", "INT8", name, teacher, seed)
        out.predictions.append(materialize(frame, "predictions"))
        out.quantization.append((seed, name, *(cal[c] for c in ("in_scale", "in_zero_point", "in_scale_ok", "out_scale", "out_zero_point", "out_scale_ok"))))
    except Exception as e:  # noqa: BLE001 - Q4 failure row
        row = _result(cfg, name, teacher, seed, "INT8", {}, status=f"strict_int8_failed: {type(e).__name__}", error=repr(e), **known)
    out.results.append(row)


def _distil_seed(cfg: StudyConfig, rows: DataFrame, seed: int, model_dir: str, shared: _Shared) -> _Gathered:
    out = _Gathered()
    t_space = md.BASELINE_SPACES[cfg.teacher_kind]
    given = shared.of(cfg.teacher_kind)
    t_spec = _search(cfg, cfg.teacher_kind, t_space, cfg.teacher_trials, rows, seed, "teacher", out, shared, given)
    teacher, _ = _refit(cfg, cfg.teacher_kind, t_spec, rows, seed, cfg.teacher_name, "None", model_dir, None, out, given)
    soft = md.soft_labels(teacher, rows)  # M12; of a linear teacher one product a row, so they are not written
    landed = None if given else materialize(soft, f"soft_{seed}").persist(StorageLevel.MEMORY_AND_DISK)
    soft = soft if landed is None else landed
    try:
        both = shared.of("student", teacher, soft)
        s_spec = _search(cfg, "student", md.STUDENT_SPACE, cfg.student_trials, soft, seed + STUDENT_SHIFT, "student", out,
                         shared, both)
        student, m = _refit(cfg, "student", s_spec, soft, seed, cfg.student_name, cfg.teacher_name, model_dir, 0.0, out, both)
        if cfg.evaluate_int8:
            _int8(cfg, student, soft, s_spec, seed, cfg.student_name, cfg.teacher_name, m, out, shared)
    finally:
        if landed is not None:
            landed.unpersist()
            release(landed)
    return out


def _baseline_seed(cfg: StudyConfig, kind: str, name: str, rows: DataFrame, seed: int, model_dir: str, shared: _Shared) -> _Gathered:
    out = _Gathered()
    given = shared.of(kind)
    spec = _search(cfg, kind, md.BASELINE_SPACES[kind], cfg.baseline_trials, rows, seed, kind, out, shared, given)
    model, m = _refit(cfg, kind, spec, rows, seed, name, "None", model_dir, 0.0 if cfg.evaluate_int8 else None, out, given)
    if cfg.evaluate_int8:
        _int8(cfg, model, rows, spec, seed, name, "None", m, out, shared)
    return out


def _study(prepared: Prepared, cfg: StudyConfig, kind: str, one_seed) -> StudyResult:
    """Every seed on its own; a failed seed becomes a failures row.  Seeds
    run side by side: most jobs of a seed follow each other and are short, and
    would leave the cluster idle.  The trials of all seeds that are fitted one by
    one share ``cfg.parallelism`` threads."""
    spark = prepared.windows.sparkSession
    rows = md.model_rows(prepared.windows, prepared.target_params, cfg.features).persist(StorageLevel.MEMORY_AND_DISK)
    model_dir = cfg.model_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/hourloom/models"
    out, shared = _Gathered(), _Shared(rows, cfg.representative_samples, cfg.parallelism)

    def run(seed: int) -> _Gathered:
        try:
            return one_seed(rows, seed, model_dir, shared)
        except Exception as e:  # noqa: BLE001 - one failed seed does not stop the study
            return _Gathered(failures=[(seed, type(e).__name__, repr(e))])

    try:
        with ThreadPoolExecutor(max(1, cfg.parallelism)) as pool:
            for found in pool.map(run, cfg.seeds):
                out.add(found)
    finally:
        rows.unpersist()
        release(rows)
        shared.release()
    result = _collect(spark, out)
    result.seeds = tuple(cfg.seeds)
    result.run_record = run_record(prepared, cfg, result)
    return result


def run_distillation(prepared: Prepared, cfg: StudyConfig) -> StudyResult:
    """E1 over every seed."""
    return _study(prepared, cfg, cfg.teacher_kind, lambda rows, seed, folder, shared: _distil_seed(cfg, rows, seed, folder, shared))


def run_baseline(prepared: Prepared, cfg: StudyConfig, kind: str = "linear", model_name: str | None = None) -> StudyResult:
    """One learner, one search per seed, refit, FP32 + INT8 scoring."""
    return _study(prepared, cfg, kind, lambda rows, seed, folder, shared: _baseline_seed(cfg, kind, model_name or kind, rows, seed, folder, shared))


def _collect(spark: SparkSession, out: _Gathered) -> StudyResult:
    if not out.results:
        raise RuntimeError(f"every seed failed: {out.failures}")
    res = spark.createDataFrame([tuple(r[k] for k in RESULT_FIELDS) for r in out.results], RESULT_SCHEMA)
    pred = ev.union_all(out.predictions) if out.predictions else None
    tri = ev.union_all(out.trials) if out.trials else None
    keys = ["stage", "seed"]
    return StudyResult(
        res, pred, tri, spark.createDataFrame(out.failures, "seed int, error_type string, error string"),
        ev.seed_statistics(res), ev.seed_summary(res), spark.createDataFrame(out.history, HISTORY_SCHEMA),
        ev.best_so_far(tri, keys=keys) if tri is not None else None, ev.tradeoff(tri, keys=keys) if tri is not None else None,
        ev.union_all(out.specifications) if out.specifications else None, spark.createDataFrame(out.quantization, QUANTIZATION_SCHEMA))


def run_record(prepared: Prepared, cfg: StudyConfig, result: StudyResult) -> DataFrame:
    """S3: one row about the run: data sizes (A13), protocol and outcome."""
    counts = win.window_counts(prepared.windows).groupBy().agg(
        *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("windows"))), F.lit(0)).alias(f"{s}_windows") for s in ("train", "val", "test")])
    lit = {"dataset": cfg.dataset, "window_size": prepared.window_size, "horizon": prepared.horizon,
           "number_of_features": len(prepared.feature_names), "teacher_trials": cfg.teacher_trials,
           "student_trials": cfg.student_trials, "baseline_trials": cfg.baseline_trials}
    failed = result.failures.agg(F.count(F.lit(1)).alias("failed_seeds"))
    record = counts.crossJoin(failed)  # one row each
    return record.select(*[F.lit(v).alias(k) for k, v in lit.items()], F.lit(list(prepared.feature_names)).alias("feature_names"),
                         F.lit(list(cfg.seeds)).alias("seeds"), "train_windows", "val_windows", "test_windows", "failed_seeds")


def write_outputs(result: StudyResult, out_dir: str, fmt: str = "parquet", prepared: Prepared | None = None) -> None:
    """Result, prediction, trial, failure and history tables kept by
    seed, so that a later run of some seeds replaces those and no others; the
    statistics and summary of all seeds now in the result table; the audit and
    quality tables of the data plane; the run record and selected specifications
    as JSON."""
    root, seeds = out_dir.rstrip("/"), result.seeds
    spark = result.results.sparkSession
    searched = [*seeds, *(s + STUDENT_SHIFT for s in seeds)]
    kept = {"results": (result.results, seeds), "failures": (result.failures, seeds), "history": (result.history, seeds),
            "quantization": (result.quantization, seeds), "predictions": (result.predictions, seeds), "trials": (result.trials, searched),
            "convergence": (result.convergence, searched), "tradeoff": (result.tradeoff, searched)}
    for name, (df, groups) in kept.items():
        if df is not None:
            write_groups(df, f"{root}/{name}", groups, fmt=fmt)
    everything = read_groups(spark, f"{root}/results", result.results.schema, fmt)
    tables = {"statistics": ev.seed_statistics(everything), "summary": ev.seed_summary(everything)}
    if prepared is not None:
        tables |= {"audit": prepared.audit, "quality": prepared.quality}
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", fmt)
    for name, df in (("run_record", result.run_record), ("specifications", result.specifications)):
        if df is not None:
            write_json(df, f"{root}/{name}")
