"""Bench: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS]; prints ONE JSON line.

Each query runs fully through the ``noop`` sink (every row computed, nothing
collected).  Data-plane queries rebuild the prepared plane from the parquet
tables each run (hourly grid, params, windows, all written to the checkpoint
folder); the evaluation queries reuse the plane prepared once.  Reported
seconds are the median of ``$BENCH_RUNS`` warm runs (default 3) after one
compare the chunk halo against one window task for a single long series.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from hourloom.plans import catalog as cat  # noqa: E402
from hourloom.plans import evalqueries as evq  # noqa: E402
from hourloom.plans import ingestqueries as inq  # noqa: E402
from hourloom.plans import studyqueries as stq  # noqa: E402
from hourloom.plans.prepare import prepare  # noqa: E402
from hourloom.session import local_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, runs: int) -> float:
    fn()  # warm-up
    times = []
    for _ in range(runs):
        t = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t)
    return round(statistics.median(times), 3)


def data_plane(spark, sf_dir, src):
    def go():
        cat.clear_cache()
        p = cat.prepared(spark, sf_dir, src)
        run(p.windows)
        run(p.quality)
    return go


def query(spark, sf_dir, fn):
    return lambda: run(fn(spark, sf_dir))


def synthetic_hourly(spark, n_series: int, hours: int):
    """Replicated hourly series with gaps (bench input only, not a query)."""
    ids = spark.range(n_series * hours, numPartitions=max(8, n_series * hours // 500_000))
    s = (F.col("id") % n_series).cast("string")
    h = F.floor(F.col("id") / n_series)
    ts = F.timestamp_add("HOUR", h, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    val = F.when(F.xxhash64("id") % 10 == 0, None).otherwise(F.sin(h / 24.0) * 10 + (F.col("id") % 7))
    pred = F.when(F.xxhash64("id", F.lit(1)) % 4 == 0, None).otherwise(F.cos(h / 12.0))
    return ids.select(s.alias("series_id"), ts.alias("ts"), val.alias("value"), pred.alias("p"))


def scale_case(spark, n_series, hours, chunk_rows):
    obs = synthetic_hourly(spark, n_series, hours)

    def go():
        p = prepare(obs, "value", ["p"], persist="write", chunk_rows=chunk_rows)
        run(p.windows)
    return go


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    out = {}
    headline = {
        "windows_events": data_plane(spark, sf_dir, cat.EVENTS_BY_TYPE),
        "windows_lineitem": data_plane(spark, sf_dir, cat.LINEITEM_BY_FLAG),
        "windows_orders": data_plane(spark, sf_dir, cat.ORDERS_ALL),
    }
    for name, fn in headline.items():
        out[name] = timed(fn, runs)
    cat.clear_cache()
    evals = {"metrics_events": evq.q_metrics(), "trials_events": evq.q_trials(),
             "int8_metrics_events": evq.q_int8_metrics(), "seed_summary_events": evq.q_seed_summary(),
             "representative_sample_events": evq.q_representative_sample(),
             "numeric_clean_customer": inq.q_numeric_clean, "parse_report_orders": inq.q_parse_report,
             "parsed_timestamps_orders": inq.q_parsed_timestamps,
             "embeddings_quantized": stq.q_embeddings_quantized}
    for name, fn in evals.items():
        out[name] = timed(query(spark, sf_dir, fn), runs)
    headline_total = round(sum(out.values()), 3)
    extra = {}
    for name in ("metrics_events", "int8_metrics_events", "seed_summary_events"):  # with their data plane

        def whole(fn=evals[name]):
            cat.clear_cache()
            run(fn(spark, sf_dir))
        extra[f"{name}_with_data_plane"] = timed(whole, 1)
    if os.environ.get("BENCH_SCALE", "1") == "1":
        extra["scale_100_series_x_8760h"] = timed(scale_case(spark, 100, 8760, 8760), 1)
        extra["scale_1000_series_x_876h"] = timed(scale_case(spark, 1000, 876, 8760), 1)
        extra["scale_1_series_x_876000h_chunked"] = timed(scale_case(spark, 1, 876_000, 8760), 1)
        extra["scale_1_series_x_876000h_one_task"] = timed(scale_case(spark, 1, 876_000, 10_000_000), 1)
    if os.environ.get("BENCH_STUDY", "1") == "1":
        def study():
            stq._STUDIES.clear()
            run(stq.q_distill_results(spark, sf_dir))
        t = time.perf_counter()
        study()
        extra["distill_ridge_study_5seeds_30x30trials"] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "sum of median warm seconds over headline queries", "value": headline_total,
                      "unit": "sec", "queries": {**out, **extra}, "sf": os.path.basename(sf_dir).replace("sf", ""),
                      "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
