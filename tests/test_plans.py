"""Physical-plan checks for the scale properties the design relies on."""

from pyspark.sql import functions as F

from helpers import hourly_series
from hourloom.operators import features as feat
from hourloom.operators import regularize as reg
from hourloom.operators import windows as win
from hourloom.session import materialize
from hourloom.sources.tables import events_observations


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    obs = events_observations(spark, "/root/testdata/sf0.001", by="event_type")
    plan = _plan(obs.select("series_id", "ts", "value", "k"))
    schema = [line for line in plan.splitlines() if "ReadSchema" in line or "FileScan" in line][0]
    assert "event_id" not in schema and "user_id" not in schema


def _rows(spark):
    o = hourly_series(spark, [(float(i % 7), float(i % 5) if i % 4 else None) for i in range(200)],
                      cols=("value", "p"))
    g, _ = reg.regularize(o, "value", ["p"], ffill_limit=0)
    lay = feat.feature_layout(["value", "p"], "value")
    return win.fill_and_window(feat.feature_frame(g, lay), len(lay.names), [1]), lay


def test_fill_and_windows_share_one_exchange(spark):
    rows, _ = _rows(spark)
    plan = _plan(rows)
    part_exchanges = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln and "_part" in ln]
    windows = [ln for ln in plan.splitlines() if ln.strip().lstrip("+- :").startswith("Window ")]
    assert len(part_exchanges) == 1 and len(windows) >= 2


def test_scaling_windows_is_map_only(spark):
    rows, lay = _rows(spark)
    rows = materialize(rows, "plan_rows")
    params = materialize(feat.fit_params(rows.select("series_id", "idx", "ts", "target",
                                                     *[f"_f{i}" for i in range(len(lay.names))]),
                                         feat.split_points(rows.groupBy("series_id").agg(
                                             (F.max("idx") + 1).alias("n"))), lay), "plan_params")
    plan = _plan(win.scale_windows(rows, params))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_no_window_over_a_whole_series(spark):
    """Rows are exchanged by (series, time) in some form; by the series alone only its one-row bounds are."""
    rows, _ = _rows(spark)
    for ln in _plan(rows).splitlines():
        if "Exchange hashpartitioning(series_id" in ln:
            keys = {k.split("#")[0].strip() for k in ln.split("hashpartitioning(")[1].split(")")[0].split(",")[:-1]}
            assert keys & {"_part", "ts", "_chunk", "idx"} or keys == {"series_id"}, ln


def test_timestamp_parse_stays_compiled(spark):
    """Some forty formats, and no generated method outgrows what the JVM compiles."""
    from hourloom.functions.timeparse import best_of_n_parse
    raw = spark.range(100).select(F.lit("s").alias("series_id"), F.concat(F.lit("2024-01-01 "), F.col("id").cast("string"), F.lit(":00")).alias("t"))
    rows, report = best_of_n_parse(raw, "t")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows its stages only as it runs
    try:
        for df in (rows.select("series_id", "ts"), report.select("*")):
            stages = df._jdf.queryExecution().debug().codegenToSeq()
            sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length())]
            assert sizes and all(0 < x < 64_000 for x in sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_filter_on_the_parsed_time_reads_each_text_once(spark):
    """Fields are read once a pass (rates, rows); a filter on the time is not written out over the raw text."""
    from hourloom.functions.timeparse import best_of_n_parse
    raw = spark.createDataFrame([("a", f"2024-01-{d:02d} 03:00") for d in range(1, 20)] + [("a", "n/a"), ("b", "13/02/2024 04:00"), (None, "2024-01-01 00:00")],
                                "series_id string, t string")
    found = best_of_n_parse(raw, "t")[0].where(F.col("ts").isNotNull())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 4 and plan.count("try_make_timestamp_ntz") == 4
    assert sorted(r.t for r in found.collect() if str(r.ts)[:4] == "2024") == sorted([f"2024-01-{d:02d} 03:00" for d in range(1, 20)] + ["13/02/2024 04:00"])


def test_ingest_reads_its_texts_once(spark):
    """Times and numbers are landed: counts, gates and observations read no text again."""
    from hourloom.operators.ingest import ingest
    raw = spark.createDataFrame([("s", f"2024-01-01 {h:02d}:00", f"{h},500", "x" if h % 2 else str(h)) for h in range(20)], "station string, Timestamp string, `PM2.5` string, p string")
    ing = ingest(raw, series_col="station")
    for df in (ing.observations, ing.column_report, ing.parse_report):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" not in plan and "regexp" not in plan
    assert [r[2:] for r in ing.observations.orderBy("ts").collect()] == [(float(h * 1000 + 500), None if h % 2 else float(h)) for h in range(20)]
    assert {(r.column, r.fraction, r.kept) for r in ing.column_report.collect()} == {("PM2.5", 1.0, True), ("p", 0.5, True)}


def test_no_persisted_tables_left(spark):
    from hourloom.plans import catalog as cat
    cat.clear_cache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for name in ("quality_events", "windows_orders", "parse_report_orders"):
        cat.registered_queries()[name](spark, "/root/testdata/sf0.001").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_representative_sample_ranks_keys_only(spark):
    from hourloom.operators.quantize import representative_sample
    w = spark.range(5000).select(F.lit("s").alias("series_id"), F.col("id").alias("idx"), F.lit("train").alias("split"),
                                 F.array(F.col("id").cast("double")).alias("seq"))
    out = representative_sample(w, 100)
    wide = [ln for ln in _plan(out).splitlines() if "Window" in ln and "seq" in ln]
    assert not wide and out.count() == 100


def test_data_plane_takes_two_large_exchanges(spark):
    """Observations and grid meet in one aggregate; fill and windows take one more."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o = hourly_series(spark, [(float(i % 7), float(i % 5)) for i in range(200)], cols=("value", "p"))
        g, _ = reg.regularize(o, "value", ["p"], ffill_limit=0, keep=lambda b: materialize(b, "plan_bounds"))
        lay = feat.feature_layout(["value", "p"], "value")
        plan = _plan(win.fill_and_window(feat.feature_frame(g, lay), len(lay.names), [1]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln and ("idx" in ln or "_part" in ln)]
    assert len(wide) == 2 and plan.count("SortMergeJoin") == 1  # the join with the per-series bounds
