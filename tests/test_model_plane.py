"""Model plane: sampler, distillation identity, gates, sinks, a small study."""

import json
import math

import pytest
from pyspark.sql import functions as F

from helpers import hourly_series
from hourloom.operators import evaluate as ev
from hourloom.operators import modeling as md
from hourloom.plans.prepare import GateError, Gates, prepare, windows_with
from hourloom.plans import study as st
from hourloom.plans.study import StudyConfig, run_baseline, run_distillation, write_outputs
from hourloom.sources.sinks import json_safe, load_params, save_params, to_json_text


def _series(spark, n=400):
    vals = [(None if i % 23 == 0 else 30 + 10 * math.sin(i / 6.0) + (i % 5), float(i % 11)) for i in range(n)]
    return hourly_series(spark, vals, cols=("value", "p"))


def test_trials_table_is_deterministic_and_in_range(spark):
    space = (md.Integer("a", 2, 6), md.Categorical("c", ("x", "y", "z")), md.Real("u", 0.0, 0.2),
             md.Real("l", 1e-8, 5e-4, "log-uniform"))
    t1 = md.trials_table(spark, space, 50, 42).collect()
    t2 = md.trials_table(spark, space, 50, 42).collect()
    assert t1 == t2 and len(t1) == 50
    assert all(2 <= r.a <= 6 and r.c in ("x", "y", "z") and 0 <= r.u <= 0.2 and 1e-8 <= r.l <= 5e-4 for r in t1)
    assert len({r.a for r in t1}) == 5 and md.trials_table(spark, space, 50, 43).collect() != t1


def test_distillation_identity(spark):
    """alpha*(y-p)^2 + (1-alpha)*(t-p)^2 = (p - kd)^2 + alpha*(1-alpha)*(y-t)^2."""
    df = spark.createDataFrame([(1.0, 0.5, 0.2), (-2.0, 1.0, 0.7), (0.3, 0.3, -0.4)],
                               "y_scaled double, teacher_scaled double, predicted_scaled double")
    a = 0.37
    loss = ev.distillation_loss(df, [], a).collect()[0].distillation_loss
    kd = df.select(((F.col("predicted_scaled") - ev.kd_label(a)) ** 2
                    + a * (1 - a) * (F.col("y_scaled") - F.col("teacher_scaled")) ** 2).alias("v"))
    assert abs(kd.agg(F.avg("v")).collect()[0][0] - loss) < 1e-12


def test_gate_policies(spark):
    o = _series(spark, 200)
    rep = prepare(o, "value", ["p"], persist="none")
    assert rep.windows.count() > 0 and rep.quality.where(~F.col("passed")).count() > 0
    exc = prepare(o, "value", ["p"], persist="none", on_fail="exclude")
    assert exc.windows.count() == 0
    with pytest.raises(GateError) as e:
        prepare(o, "value", ["p"], persist="none", on_fail="raise")
    assert {r.series_id for r in e.value.failed.collect()} == {"s"}
    ok = prepare(o, "value", ["p"], persist="none", on_fail="raise", gates=Gates(100, 50, 5))
    assert ok.windows.count() > 0


def test_json_safe_nulls_non_finite(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], "a")], "x double, a array<double>, s string")
    row = json.loads(to_json_text(df).collect()[0].json)
    assert row == {"x": None, "a": [1.0, None], "s": "a"}
    assert json_safe(df).collect()[0].x is None


def test_json_safe_at_any_depth(spark):
    nan, inf = float("nan"), float("inf")
    row = ({"a": {"b": [nan, 1.0]}, "n": 1}, [[1.0, inf], None], {"k": {"v": [-inf, 2.5]}}, [{"x": nan, "s": "t"}], None, {"m": {"deep": nan}})
    df = spark.createDataFrame([row], "s struct<a: struct<b: array<double>>, n: int>, aa array<array<float>>, m map<string, struct<v: array<double>>>, "
                                      "ls array<struct<x: double, s: string>>, z struct<x: double>, mm map<string, map<string, double>>")
    got = json.loads(to_json_text(df).collect()[0].json)
    assert got == {"s": {"a": {"b": [None, 1.0]}, "n": 1}, "aa": [[1.0, None], None], "m": {"k": {"v": [None, 2.5]}}, "ls": [{"x": None, "s": "t"}],
                   "z": None, "mm": {"m": {"deep": None}}}


def test_a_wrong_year_makes_no_grid(spark):
    """One stamp of the year 9999 would be 70 million grid rows."""
    far = hourly_series(spark, [(1.0, 2.0)] * 50, cols=("value", "p"), series="far")
    last = F.lit("9999-12-31 23:00:00").cast("timestamp_ntz")
    o = _series(spark, 300).unionByName(far).unionByName(far.limit(1).withColumn("ts", last))
    p = prepare(o, "value", ["p"], gates=Gates(50, 20, 10), on_fail="exclude")
    assert p.hourly.where("series_id = 'far'").count() == 0 and p.hourly.where("series_id = 's'").count() == 300
    checks = {(r.series_id, r.check): r.passed for r in p.quality.collect()}
    assert checks["far", "span_plausible"] is False and checks["s", "span_plausible"] is True
    assert {c for s, c in checks if s == "far"} == {c for s, c in checks if s == "s"}
    assert p.windows.select("series_id").distinct().collect()[0].series_id == "s"
    with pytest.raises(GateError, match="span") as e:
        prepare(o, "value", ["p"], gates=Gates(50, 20, 10), on_fail="raise")
    assert [(r.series_id, r.check) for r in e.value.failed.collect()] == [("far", "span_plausible")]


def test_one_row_series_keeps_its_checks(spark):
    o = _series(spark, 200).unionByName(hourly_series(spark, [(1.0, 2.0)], cols=("value", "p"), series="lone"))
    rep = prepare(o, "value", ["p"], persist="none")
    checks = {(r.series_id, r.check): r.passed for r in rep.quality.collect()}
    assert {c for s, c in checks if s == "lone"} == {c for s, c in checks if s == "s"}
    assert not checks["lone", "split_valid"] and not checks["lone", "train_targets"]


def test_span_gate_reports_one_wrong_year(spark):
    from helpers import obs_frame
    rows = [("2024-01-01 00:00:00", 1.0), ("2024-01-01 01:00:00", 2.0), ("2223-01-01 00:00:00", 3.0)]
    o = obs_frame(spark, rows)
    from hourloom.operators import regularize as reg
    from hourloom.plans.prepare import quality_report
    b = reg.series_bounds(o)
    a = reg.audit(o.withColumnRenamed("ts", "t"), b, "value")
    p = b.select("series_id", "n", F.lit(1).alias("train_end"), F.lit(2).alias("val_end"), F.lit(0).alias("train_targets"))
    q = {r.check: r.passed for r in quality_report(a, p, None, Gates(), 8).collect()}
    assert q["span_plausible"] is False


def test_pairing_finds_missing_and_repeated_keys(spark):
    hard = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3)], "series_id string, target_ts int")
    soft = spark.createDataFrame([("s", 1, 0.1), ("s", 1, 0.2), ("s", 2, 0.3)], "series_id string, target_ts int, t double")
    with pytest.raises(ValueError, match="1 labels have none, 1 have several"):
        ev.pair_teacher(hard, soft)
    assert ev.pair_teacher(hard.limit(0), soft).count() == 0


def test_saved_params_give_equal_windows(spark, tmp_path):
    o = _series(spark, 300)
    p = prepare(o, "value", ["p"])
    save_params(p.params, p.feature_params, f"file://{tmp_path}/params")
    again = windows_with(load_params(spark, f"file://{tmp_path}/params"), o, "value", ["p"])
    key = lambda df: sorted(map(repr, df.select("idx", "target_ts", "split", "seq", "y_scaled").collect()))
    assert key(again) == key(p.windows)


@pytest.fixture(scope="module")
def rows(spark):
    p = prepare(_series(spark), "value", ["p"], gates=Gates(50, 20, 10))
    return md.model_rows(p.windows, p.target_params)


def test_penalty_does_not_depend_on_the_label_spread(spark, rows):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    one = rows.withColumn("features", array_to_vector(F.slice(vector_to_array("features"), 1, 1)))
    t = one.where("split = 'train'").select(vector_to_array("features")[0].alias("x"), (F.col("y_scaled") * 7 + 1).alias("k"))
    m = t.agg(F.covar_pop("x", "k"), F.var_pop("x")).first()
    label = one.withColumn("k", F.col("y_scaled") * 7 + 1)
    spread = md.LabelMoments(t.count(), t.agg(F.var_pop("k")).first()[0], 0.0, 0.0)
    for iterate in (False, True):
        model = md.fit("linear", {"l2": 0.5}, 1, label, "k", spread, iterate)
        assert abs(model.coefficients[0] - m[0] / (m[1] + 0.5)) < 1e-6


def test_epochs_and_history(rows):
    gbt = md.fit("gbt", {"max_depth": 2, "max_iter": 7, "step_size": 0.1, "subsampling_rate": 1.0}, 1, rows)
    assert md.epochs(gbt) == gbt.getNumTrees >= 1 and len(md.history(gbt, rows.where("split = 'val'"))) == md.epochs(gbt)
    forest = md.fit("random_forest", {"num_trees": 5, "max_depth": 3}, 1, rows)
    assert md.epochs(forest) == 5 and md.history(forest, rows) == []
    tree = md.fit("decision_tree", {"max_depth": 3, "min_instances": 1}, 1, rows)
    assert md.epochs(tree) == 1 and md.param_count(tree) == tree.numNodes
    direct = md.fit("linear", {"l2": 1e-4}, 1, rows)
    assert md.epochs(direct) is None and md.history(direct) == []
    lin = md.fit("linear", {"l2": 1e-4}, 1, rows, iterate=True)
    h = md.history(lin)
    assert md.epochs(lin) == len(h) > 2 and h[0] > h[-1] and all(a >= b - 1e-9 for a, b in zip(h, h[1:], strict=False))
    assert abs(lin.coefficients[0] - direct.coefficients[0]) < 0.01  # nearly collinear features


def test_failed_trial_keeps_its_whole_error(spark, rows):
    long = "no such depth " * 100
    trials = spark.createDataFrame([(1, "0.1"), (2, long)], "trial int, l2 string")
    out = {r.trial: r for r in md.evaluate_trials("linear", trials, rows, 1).collect()}
    assert out[1].status == "success" and out[1].epochs_completed is None
    assert out[2].status == "failed" and long in out[2].error and out[2].objective_1_minus_validation_R2 == 1e6


def test_small_distillation_and_baseline_study(spark, tmp_path):
    p = prepare(_series(spark), "value", ["p"], gates=Gates(50, 20, 10))
    cfg = StudyConfig(dataset="t", seeds=(1, 2), teacher_trials=2, student_trials=2, parallelism=2, model_dir=f"{tmp_path}/m")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    r = run_distillation(p, cfg)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    res = r.results.collect()
    assert len(res) == 6 and {x.precision for x in res} == {"FP32", "INT8"}
    assert all(x.status in ("success", "strict_int8_success") for x in res)
    teacher = [x for x in res if x.model == "teacher"]
    assert all(x.quantization_R2_drop is None and x.teacher == "None" and x.epochs_completed >= 1 for x in teacher)
    assert all(x.model_size_KB is None for x in res if x.precision == "INT8")
    assert r.trials.count() == 8 and r.failures.count() == 0
    assert {x.number_of_seeds for x in r.summary.collect()} == {2}
    spec = json.loads([x for x in res if x.precision == "FP32" and x.model != "teacher"][0].specification)
    assert list(spec) == sorted(spec) and 0.25 <= spec["kd_alpha"] <= 1.0
    assert r.predictions.select("split").distinct().count() == 2
    h = [x.loss for x in r.history.where("model = 'distilled student' and seed = 1").orderBy("iteration").collect()]
    assert len(h) > 2 and h[0] > h[-1]
    assert r.convergence.count() == r.trials.where(F.col("validation_R2").isNotNull()).count()
    assert r.tradeoff.where(F.col("pareto")).count() >= 1
    out = f"file://{tmp_path}/out"
    write_outputs(r, out, prepared=p)
    assert spark.read.parquet(f"{out}/predictions").select("seed").distinct().count() == 2
    assert spark.read.parquet(f"{out}/audit").count() == 1 and spark.read.parquet(f"{out}/quality").count() == 5
    record = spark.read.json(f"{out}/run_record").first()
    assert record.train_windows == p.windows.where("split = 'train'").count() and record.failed_seeds == 0
    assert spark.read.json(f"{out}/specifications").count() == 4 and spark.read.parquet(f"{out}/quantization").count() == 2
    one = run_distillation(p, StudyConfig(dataset="t", seeds=(2,), teacher_trials=1, student_trials=1, parallelism=2, teacher_kind="linear",
                                          model_dir=f"{tmp_path}/m"))
    write_outputs(one, out, prepared=p)  # seed 2 again, with fewer trials and a linear teacher
    per_seed = {x.seed: x.n for x in spark.read.parquet(f"{out}/trials").groupBy("seed").agg(F.count("*").alias("n")).collect()}
    assert per_seed == {1: 2, 10001: 2, 2: 1, 10002: 1}
    assert spark.read.parquet(f"{out}/results").count() == 6
    assert {x.number_of_seeds for x in spark.read.parquet(f"{out}/summary").collect()} == {2}
    b = run_baseline(p, StudyConfig(dataset="t", seeds=(3,), baseline_trials=2, parallelism=2, model_dir=f"{tmp_path}/m"), kind="decision_tree")
    assert b.results.count() == 2


def test_failed_seed_and_failed_int8_leave_rows(spark, tmp_path, monkeypatch):
    p = prepare(_series(spark), "value", ["p"], gates=Gates(50, 20, 10))
    cfg = StudyConfig(dataset="t", seeds=(1, 2), baseline_trials=1, parallelism=1, model_dir=f"{tmp_path}/m")
    whole = "x" * 3000
    real = st._search

    def search(cfg, kind, space, n, rows, seed, *a):
        if seed == 2:
            raise RuntimeError(whole)
        return real(cfg, kind, space, n, rows, seed, *a)

    def scores(*a, **k):
        raise ZeroDivisionError(whole)
    monkeypatch.setattr(st, "_search", search)
    monkeypatch.setattr(st, "int8_scores", scores)
    r = run_baseline(p, cfg, "linear")
    assert [(f.seed, f.error_type) for f in r.failures.collect()] == [(2, "RuntimeError")] and whole in r.failures.first().error
    int8 = r.results.where("precision = 'INT8'").collect()
    assert [x.status for x in int8] == ["strict_int8_failed: ZeroDivisionError"] and whole in int8[0].error
    assert r.run_record.first().failed_seeds == 1
