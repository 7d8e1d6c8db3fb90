"""Prefix scoring of boosted searches against refits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import hourly_series
from hourloom.operators import boost
from hourloom.operators import evaluate as ev
from hourloom.operators import modeling as md
from hourloom.plans.prepare import Gates, prepare
from hourloom.session import materialize

BASE = {"max_depth": 3, "step_size": 0.2, "subsampling_rate": 0.75}


@pytest.fixture(scope="module")
def rows(spark):
    o = None
    for s, scale in (("a", 1.0), ("b", 40.0)):
        vals = [(None if i % 23 == 0 else scale * (30 + 10 * math.sin(i / 6.0) + (i * i % 7)), float(i * i % 11)) for i in range(400)]
        one = hourly_series(spark, vals, cols=("value", "p"), series=s)
        o = one if o is None else o.unionByName(one)
    p = prepare(o, "value", ["p"], gates=Gates(50, 20, 10))
    return md.model_rows(p.windows, p.target_params)


@pytest.fixture(scope="module")
def longest(rows):
    return md.fit("gbt", BASE | {"max_iter": 8}, 5, rows, early_stop=False)


def test_a_prefix_scores_as_a_refit(rows, longest):
    """Predictions and metrics of the first r trees are those of a fit of r rounds."""
    val = rows.where("split = 'val'")
    seen = boost.curve(longest, val)
    pre = {(r.series_id, r.idx): r.prefixes for r in boost.prefix_predictions(longest, val).collect()}
    assert len(seen.rows) == len(seen.nodes) == 8
    for r in (1, 8):
        refit = md.fit("gbt", BASE | {"max_iter": r}, 5, rows, early_stop=False)
        scored = md.score(refit, val)
        for x in scored.collect():
            assert abs(pre[x.series_id, x.idx][r - 1] - x.predicted_scaled) < 1e-12
        m = ev.regression_metrics(scored, [], "y_raw", "predicted").first()
        assert np.allclose([seen.rows[r - 1][c] for c in ("R2", "MAE_ugm3", "RMSE_ugm3")], [m.R2, m.MAE_ugm3, m.RMSE_ugm3], rtol=1e-9)
        assert seen.nodes[r - 1] == refit.totalNumNodes
        assert np.allclose([x["loss"] for x in seen.rows[:r]], refit.evaluateEachIteration(val, "squared"), rtol=1e-9)


def test_trials_share_the_fits_of_their_families(spark, rows, monkeypatch):
    """Family (2, 0.3) runs its rounds out; family (3, 1.0) is stopped early."""
    specs = [(1, 2, 4, 0.3, 1.0), (2, 2, 8, 0.3, 1.0), (3, 3, 9, 1.0, 1.0), (4, 3, 1, 1.0, 1.0), (5, 99, 5, 0.1, 1.0)]
    trials = spark.createDataFrame(specs, "trial int, max_depth int, max_iter int, step_size double, subsampling_rate double")
    fits, real = [], md.fit
    monkeypatch.setattr(md, "fit", lambda kind, spec, *a, **k: fits.append(spec["max_iter"]) or real(kind, spec, *a, **k))
    found = {r.trial: r for r in md.evaluate_trials("gbt", trials, rows, 7).collect()}
    assert sorted(fits) == [5, 8, 9]
    assert found[5].status == "failed" and found[5].error and found[5].validation_R2 is None and found[5].epochs_completed == 0
    assert found[2].epochs_completed > 4 and found[3].epochs_completed < 9
    monkeypatch.undo()
    for t, depth, most, step, rate in specs[:4]:
        model = md.fit("gbt", dict(max_depth=depth, max_iter=most, step_size=step, subsampling_rate=rate), 7, rows)
        m = ev.regression_metrics(md.score(model, rows.where("split = 'val'")), [], "y_raw", "predicted").first()
        got = found[t]
        assert (got.epochs_completed, got.params, got.status) == (model.getNumTrees, model.totalNumNodes, "success")
        assert np.allclose([got.validation_R2, got.validation_MAE_ugm3], [m.R2, m.MAE_ugm3], rtol=1e-9)


def test_draws_of_the_boosted_space_in_sql(spark):
    """M4: whole numbers and choices drawn by Spark are those of the SQL form."""
    import duckdb

    from hourloom.plans import ridgeoracle
    dims = [d.name for d in md.TEACHER_SPACE]
    want = duckdb.sql(f"SELECT seed, trial, {', '.join(dims)} FROM ({ridgeoracle.boosted_trials_sql()}) ORDER BY ALL").fetchall()
    got = [(s, r.trial, *[r[d] for d in dims]) for s in ridgeoracle.SEEDS for r in md.trials_table(spark, md.TEACHER_SPACE, 30, s).collect()]
    assert sorted(got) == want and len({r[2] for r in got}) == 3


def test_no_validation_rows(spark, rows):
    trials = spark.createDataFrame([(1, 2, 3, 0.1, 1.0)], "trial int, max_depth int, max_iter int, step_size double, subsampling_rate double")
    got = md.evaluate_trials("gbt", trials, rows.where(F.col("split") != "val"), 7).first()
    assert (got.status, got.epochs_completed, got.validation_R2) == ("success", 3, None)


def test_seeds_run_side_by_side_on_shared_fit_threads(spark, monkeypatch):
    """The seeds of a boosted study wait for each other here; their fits stay within the study's parallelism."""
    from threading import Barrier, Lock
    from types import SimpleNamespace

    from hourloom.plans import study
    monkeypatch.setattr(md, "model_rows", lambda windows, params, features: materialize(windows, "side-by-side"))
    monkeypatch.setattr(study, "run_record", lambda prepared, cfg, result: None)
    seeds_meet, fits_meet = Barrier(3), Barrier(3)  # six fits, three at once
    lock, busy = Lock(), [0]

    def one_seed(rows, seed, folder, shared):
        seeds_meet.wait(30)

        def work(_):
            with lock:
                busy.append(busy[-1] + 1)
            fits_meet.wait(30)
            with lock:
                busy.append(busy[-1] - 1)
        list(shared.fits.map(work, range(2)))
        return study._Gathered(results=[dict.fromkeys(study.RESULT_FIELDS) | {"model": "m", "seed": seed, "status": "success"}])

    rows = spark.range(3).withColumn("split", F.lit("train"))
    prepared = SimpleNamespace(windows=rows, target_params=None)
    result = study._study(prepared, study.StudyConfig(seeds=(1, 2, 3), parallelism=3), "gbt", one_seed)
    assert result.failures.count() == 0 and [r.seed for r in result.results.select("seed").collect()] == [1, 2, 3]
    assert max(busy) == 3
