"""Golden fixtures: one small hand-computed frame per trap (FIXTURES.md A2)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import col_list, hourly_series, obs_frame
from hourloom.functions import names
from hourloom.functions.numeric import clean_numeric
from hourloom.functions.timeparse import best_of_n_parse
from hourloom.operators import evaluate as ev
from hourloom.operators import features as feat
from hourloom.operators import quantize as qz
from hourloom.operators import regularize as reg
from hourloom.operators.windows import flat_features
from hourloom.plans.prepare import prepare


def test_offgrid_rows_are_lost_exact_alignment(spark):
    o = obs_frame(spark, [("2024-01-01 00:30:00", 1), ("2024-01-01 01:00:00", 2),
                          ("2024-01-01 01:30:00", 3), ("2024-01-01 01:30:00", 5)])
    hourly, bounds = reg.regularize(o, "value", [], align="exact")
    rows = hourly.orderBy("idx").collect()
    assert [(str(r.ts), r.value) for r in rows] == [("2024-01-01 00:30:00", 1.0), ("2024-01-01 01:30:00", 4.0)]


def test_floor_alignment_buckets_to_the_hour(spark):
    o = obs_frame(spark, [("2024-01-01 00:30:00", 1), ("2024-01-01 00:50:00", 3), ("2024-01-01 02:10:00", 5)])
    hourly, _ = reg.regularize(o, "value", [], align="floor")
    assert col_list(hourly, "value") == [2.0, None, 5.0]


def test_split90_binary_floating_point(spark):
    o = hourly_series(spark, list(range(90)))
    _, bounds = reg.regularize(o, "value", [])
    r = feat.split_points(bounds).collect()[0]
    assert (r.n, r.train_end, r.val_end) == (90, 62, 76)


@pytest.mark.parametrize("text,expected", [
    ("1,234", 1234.0), ("--", None), ("NA", None), (" 5 ", 5.0), ("1e5", 100000.0), ("0x10", None),
    ("True", None), ("-3", -3.0), ("5--3", 53.0), ("none", None), ("1_000", None), ("5d", None),
    ("N/A", None), ("nan", None), ("NaN", None), ("inf", math.inf), ("-Infinity", -math.inf), (".5", 0.5),
    ("\t7\n", 7.0), (None, None)])
def test_numeric_text(spark, text, expected):
    v = spark.createDataFrame([(text,)], "t string").select(clean_numeric(F.col("t"))).collect()[0][0]
    assert v == expected


def test_date_mix_day_first_wins(spark):
    df = spark.createDataFrame([("a", "01/02/2024 03:00"), ("a", "13/02/2024 03:00")], "series_id string, t string")
    rows, report = best_of_n_parse(df, "t", "series_id")
    r = report.collect()[0]
    assert r.format_index == 1 and r.parse_rate == 1.0
    assert sorted(str(x.ts) for x in rows.collect()) == ["2024-02-01 03:00:00", "2024-02-13 03:00:00"]


def test_date_tie_month_first(spark):
    df = spark.createDataFrame([("a", "01/02/2024 03:00")], "series_id string, t string")
    rows, report = best_of_n_parse(df, "t", "series_id")
    assert report.collect()[0].format_index == 0
    assert str(rows.collect()[0].ts) == "2024-01-02 03:00:00"


def test_ffill_limit_three(spark):
    o = hourly_series(spark, [(1, 1), (1, None), (1, None), (1, None), (1, None), (1, 2)], cols=("value", "p"))
    hourly, _ = reg.regularize(o, "value", ["p"])
    assert col_list(hourly, "p") == [1.0, 1.0, 1.0, 1.0, None, 2.0]


def test_ffill_across_missing_grid_rows(spark):
    o = obs_frame(spark, [("2024-01-01 00:00:00", 1, 7), ("2024-01-01 05:00:00", 1, 8)], cols=("value", "p"))
    hourly, _ = reg.regularize(o, "value", ["p"])
    assert col_list(hourly, "p") == [7.0, 7.0, 7.0, 7.0, None, 8.0]
    assert col_list(hourly, "value") == [1.0, None, None, None, None, 1.0]  # target never filled


def test_inf_in_duplicate_mean_ends_null(spark):
    o = obs_frame(spark, [("2024-01-01 00:00:00", math.inf), ("2024-01-01 00:00:00", 5),
                          ("2024-01-01 01:00:00", 2)])
    hourly, _ = reg.regularize(o, "value", [])
    assert col_list(hourly, "value") == [None, 2.0]


def _numpy_positions(n, k):
    return list(np.linspace(0, n - 1, num=min(k, n), dtype=int))


@pytest.mark.parametrize("n,k", [(10, 4), (319, 250), (1, 250), (2, 250), (251, 250), (1000, 250)])
def test_linspace_positions(spark, n, k):
    w = spark.range(n).select(F.lit("s").alias("series_id"), (F.col("id") + 7).alias("idx"),
                              F.lit("train").alias("split"))
    got = sorted(r.pos for r in qz.representative_sample(w, max_samples=k).collect())
    assert got == _numpy_positions(n, k)


def test_rank_in_order_across_chunks(spark):
    w = spark.range(0, 500, 3).select(F.lit("s").alias("series_id"), F.col("id").alias("idx"))
    got = qz.rank_in_order(w, ["series_id"], "idx", chunk_rows=17).orderBy("idx").collect()
    assert [r.pos for r in got] == list(range(len(got)))


def test_std_with_one_seed(spark):
    r = spark.createDataFrame([("d", "m", "None", "FP32", 42, 0.5)],
                              "dataset string, model string, teacher string, precision string, seed int, R2 double")
    stats = ev.seed_statistics(r, metrics=["R2"]).collect()[0]
    assert stats["R2__std"] is None and stats["R2__count"] == 1
    summ = ev.seed_summary(r, metrics=["R2"]).collect()[0]
    assert summ["R2_std"] == 0.0 and summ["R2_mean_std"] == "0.500000 ± 0.000000" and summ["number_of_seeds"] == 1


def test_summary_with_no_values(spark):
    r = spark.createDataFrame([("d", "m", "None", "INT8", 42, None)],
                              "dataset string, model string, teacher string, precision string, seed int, R2 double")
    summ = ev.seed_summary(r, metrics=["R2"]).collect()[0]
    assert summ["R2_mean"] is None and summ["R2_std"] is None and summ["R2_mean_std"] == ""


def test_null_group_keys_are_kept(spark):
    r = spark.createDataFrame([(None, "m", "None", "FP32", 1, 1.0), (None, "m", "None", "FP32", 2, 3.0)],
                              "dataset string, model string, teacher string, precision string, seed int, R2 double")
    s = ev.seed_statistics(r, metrics=["R2"]).collect()
    assert len(s) == 1 and s[0]["R2__mean"] == 2.0


def test_saturation_input_exclusive_output_inclusive(spark):
    df = spark.createDataFrame([([-129.0, -128.0, 127.0, 128.0],)], "a array<double>")
    one, zero = F.lit(1.0), F.lit(0.0)
    hits, total = qz.input_saturation_counts(F.col("a"), one, zero)
    r = df.select(hits.alias("h"), total.alias("n")).collect()[0]
    assert (r.h, r.n) == (2, 4)
    codes = df.select(F.explode(F.transform("a", lambda v: qz.fake_quant(v, one, zero)[0])).alias("c"))
    assert codes.where(qz.output_saturated(F.col("c"))).count() == 4


def test_const_feature_scales_by_one(spark):
    o = hourly_series(spark, [(float(i % 5), 3.0) for i in range(40)], cols=("value", "c"))
    p = prepare(o, "value", ["c"], persist="none")
    fp = {r.feature: r for r in p.feature_params.collect()}
    assert fp["c"].scale == 1.0 and fp["c"].center == 3.0
    first = p.windows.select(F.col("seq")[0][1].alias("v")).collect()
    assert all(r.v == 0.0 for r in first)


def test_flat_order_is_time_major(spark):
    df = spark.createDataFrame([([[float(t * 10 + f) for f in range(2)] for t in range(8)],)],
                               "seq array<array<double>>")
    flat = df.select(flat_features("seq").alias("f")).collect()[0].f
    assert flat == [float(t * 10 + f) for t in range(8) for f in range(2)]


def test_target_scaler_zero_variance_is_one(spark):
    o = hourly_series(spark, [5.0] * 30)
    p = prepare(o, "value", [], persist="none")
    r = p.target_params.collect()[0]
    assert r.y_std == 1.0 and r.y_mean == 5.0


def test_timestamp_and_target_resolution():
    assert names.timestamp_column(["x", "Recorded At ", "date"]) == "date"
    assert names.timestamp_column(["x", " Recorded  At"]) == " Recorded  At"
    assert names.target_column(["Temp", "PM 2.5 (µg/m³)"]) == "PM 2.5 (µg/m³)"
    assert names.target_column(["pm25", "PM2.5"]) == "PM2.5"
    with pytest.raises(ValueError):
        names.target_column(["Temp", "Humidity"])


def test_normalize_name_column_matches_python(spark):
    raw = ["  PM2.5 (µg/m³) ", "Date_Time", "μg--Level#1", "\tRecorded At\n"]
    df = spark.createDataFrame([(r,) for r in raw], "n string")
    got = [r[0] for r in df.select(names.normalize_name_col(F.col("n"))).collect()]
    assert got == [names.normalize_name(r) for r in raw]
