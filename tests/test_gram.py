"""Ridge search by sufficient statistics against MLlib's fits."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from helpers import hourly_series
from hourloom.operators import evaluate as ev
from hourloom.operators import gram
from hourloom.operators import modeling as md
from hourloom.plans.prepare import Gates, prepare


@pytest.fixture(scope="module")
def rows(spark):
    vals = [(None if i % 23 == 0 else 30 + 10 * math.sin(i / 6.0) + (i * i % 7), float(i * i % 11)) for i in range(600)]
    p = prepare(hourly_series(spark, vals, cols=("value", "p")), "value", ["p"], gates=Gates(50, 20, 10))
    found = md.model_rows(p.windows, p.target_params)
    return found.withColumn("teacher_scaled", F.col("y_scaled") * 0.5 + F.sin(F.col("y_raw")))


def test_moments_equal_those_of_the_rows(rows):
    g = gram.gramian(rows.repartition(5), ("y_scaled", "teacher_scaled"))
    train = rows.where("split = 'train'").select(vector_to_array("features").alias("x"), "y_scaled", "teacher_scaled").collect()
    z = np.array([[*r.x, r.y_scaled, r.teacher_scaled] for r in train])
    assert g.n == len(z) and g.width == z.shape[1] - 2 > 16
    assert np.allclose(g.mean, z.mean(0), atol=1e-12) and np.allclose(g.cov, np.cov(z.T, bias=True), atol=1e-11)


@pytest.mark.parametrize(("l2", "alpha"), [(1e-3, 1.0), (5e-4, 0.25), (0.3, 0.6)])
def test_a_solve_equals_the_fit(rows, l2, alpha):
    b, b0 = gram.gramian(rows, ("y_scaled", "teacher_scaled")).ridge(l2, {"y_scaled": alpha, "teacher_scaled": 1 - alpha})
    model = md.fit("student", {"l2": l2, "kd_alpha": alpha}, 1, rows)
    assert np.allclose(b, model.coefficients.toArray(), atol=1e-8) and abs(b0 - model.intercept) < 1e-8


def test_scores_equal_those_of_the_models(spark, rows):
    specs = [{"l2": x, "kd_alpha": a} for x, a in ((1e-8, 0.3), (1e-2, 0.9), (1.0, 0.5))]
    trials = spark.createDataFrame([(i + 1, s["l2"], s["kd_alpha"]) for i, s in enumerate(specs)], "trial int, l2 double, kd_alpha double")
    found = {r.trial: r for r in md.evaluate_trials("student", trials, rows, 1).collect()}
    for i, s in enumerate(specs[1:], 2):
        m = ev.regression_metrics(md.score(md.fit("student", s, 1, rows), rows.where("split = 'val'")), [], "y_raw", "predicted").first()
        got = found[i]
        assert np.allclose([got.validation_R2, got.validation_MAE_ugm3, got.validation_RMSE_ugm3], [m.R2, m.MAE_ugm3, m.RMSE_ugm3], rtol=1e-8)
        assert got.params == 17 or got.params > 17


def test_a_linear_teacher_needs_no_pass(rows):
    teacher = md.fit("linear", {"l2": 1e-3}, 1, rows)
    soft = md.soft_labels(teacher, rows.drop("teacher_scaled"))
    passed = gram.gramian(soft, ("y_scaled", "teacher_scaled"))
    made = gram.gramian(rows).with_linear_label("teacher_scaled", teacher.coefficients.toArray(), teacher.intercept)
    assert made.labels == passed.labels and np.allclose(made.cov, passed.cov, atol=1e-10) and np.allclose(made.mean, passed.mean, atol=1e-10)


def test_jobs_of_a_search_do_not_depend_on_its_trials(spark, rows):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"search-{n}", "")
        md.evaluate_trials("student", md.trials_table(spark, md.STUDENT_SPACE, n, 1), rows, 1)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"search-{n}"))
        spark.sparkContext._jsc.clearJobGroup()
        return found
    assert 0 < jobs(3) == jobs(60) < 20


def test_descent_ends_at_the_solution(rows):
    g = gram.gramian(rows, ("y_scaled", "teacher_scaled"))
    blend = gram.blend_of({"kd_alpha": 0.4})
    steps = g.descent(1e-2, blend)
    b, _ = g.ridge(1e-2, blend)
    d, w = g.width, np.array([0.4, 0.6])
    best = 0.5 * w @ g.cov[d:, d:] @ w + 0.5 * b @ (g.cov[:d, :d] + 1e-2 * np.eye(d)) @ b - b @ (g.cov[:d, d:] @ w)
    assert len(steps) > 3 and abs(steps[-1] - best) < 1e-10 and all(x >= y - 1e-12 for x, y in zip(steps, steps[1:], strict=False))


def test_no_train_rows_and_bad_penalties(rows):
    with pytest.raises(ValueError, match="no train rows"):
        gram.gramian(rows.where("split <> 'train'"))
    with pytest.raises(ValueError, match="penalty"):
        gram.gramian(rows).ridge(float("nan"), {"y_scaled": 1.0})
