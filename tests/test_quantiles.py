"""Exact quantiles with bounded state equal Spark's exact ``percentile``."""

import random

import pytest
from pyspark.sql import functions as F

from hourloom.operators.quantiles import filled_quartiles, group_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def _exact(df):
    arr = F.array(*[F.lit(p) for p in PROBS])
    return {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", arr).alias("q")).collect()}


def _ours(df, **kw):
    return {r.k: r._q0 for r in group_quantiles(df, ["k"], [F.col("v")], PROBS, **kw).collect()}


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_equals_percentile(spark, accuracy):
    rnd = random.Random(7)
    rows = [("hot", float(rnd.randint(0, 3000)) / 7.0 if rnd.random() > 0.05 else None) for _ in range(20000)]
    rows += [("weekday", float(i % 7)) for i in range(5000)]
    rows += [("half tied", 3.25 if i % 2 else float(i)) for i in range(5001)]
    rows += [("small", float(i % 13)) for i in range(50)] + [("empty", None)] * 3 + [("one", 4.5), ("two", 1.0), ("two", 2.0)]
    rows += [(f"n{n}", float(rnd.randint(-50, 50))) for n in range(3, 12) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert _ours(df, accuracy=accuracy) == _exact(df)


def test_state_is_the_distinct_values_of_the_bracket(spark):
    """Ties never pile up: what is gathered per group is distinct values."""
    df = spark.range(60_000).select(F.lit("k").alias("k"), F.when(F.col("id") % 2 == 0, 3.5).otherwise((F.col("id") % 7).cast("double")).alias("v"))
    out = group_quantiles(df, ["k"], [F.col("v")], [0.25, 0.5, 0.75], accuracy=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and plan.count("partial_count") >= 1
    rows = out.collect()
    assert rows[0]._q0 == df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]


def test_several_expressions_and_keys(spark):
    df = spark.createDataFrame([("a", 1, float(i), float(i * i % 17)) for i in range(300)] + [("b", 2, None, 5.0)], "k string, j int, v double, w double")
    got = {(r.k, r.j): (r._q0, r._q1) for r in group_quantiles(df, ["k", "j"], [F.col("v"), F.col("w")], [0.5]).collect()}
    assert got[("a", 1)] == ([149.5], [8.0]) or got[("a", 1)][0] == [149.5]
    assert got[("b", 2)] == (None, [5.0])


@pytest.mark.parametrize("accuracy", [40, 10_000])
def test_filled_quartiles_equal_those_of_the_filled_column(spark, accuracy):
    """Any share of nulls, ties, odd and even counts: as if filled first."""
    rnd = random.Random(3)
    rows = [(f"share {share}", None if rnd.random() < share / 10 else rnd.gauss(0, 5)) for share in range(10) for _ in range(1500)]
    rows += [("ties", None if i % 5 == 0 else float(i % 4)) for i in range(3000)] + [("none", None)] * 3
    rows += [(f"{n} of {n + m}", rnd.uniform(-9, 9) if i < n else None) for n in range(1, 8) for m in range(6) for i in range(n + m)]
    df = spark.createDataFrame(rows, "k string, v double")
    med = df.groupBy("k").agg(F.coalesce(F.percentile("v", F.lit(0.5)), F.lit(0.0)).alias("m"))
    full = df.join(med, "k").withColumn("w", F.coalesce("v", "m"))
    want = {r.k: tuple(r.q) for r in full.groupBy("k").agg(F.percentile("w", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))).alias("q")).collect()}
    got = {r.k: (r._m0, r._lo0, r._hi0) for r in filled_quartiles(df, ["k"], [F.col("v")], accuracy).collect()}
    assert got == want


def test_filled_quartiles_take_one_sketch_and_one_count(spark):
    df = spark.createDataFrame([("a", float(i), float(-i)) for i in range(100)], "k string, v double, w double")
    plan = filled_quartiles(df, ["k"], [F.col("v"), F.col("w")])._jdf.queryExecution().optimizedPlan().toString()
    assert sum("percentile_approx" in ln and "Aggregate" in ln for ln in plan.splitlines()) <= 2
    assert sum("collect_list" in ln and "Aggregate" in ln for ln in plan.splitlines()) == 1
