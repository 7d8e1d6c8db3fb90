"""Sinks may be run again: a failed write leaves the old table, a rerun of some
seeds replaces those and no others."""

import os

import pytest
from pyspark.sql import functions as F

from hourloom.sources.sinks import read_groups, write_groups, write_json, write_table

SCHEMA = "seed int, v double"


def _rows(df):
    return sorted(tuple(r) for r in df.select("seed", "v").collect())


def _failing(df):
    return df.withColumn("v", F.when(F.col("v") > 1, F.raise_error(F.lit("no such value"))).otherwise(F.col("v")).cast("double"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_rerun_replaces_its_seeds_only(spark, tmp_path, fmt):
    path = f"file://{tmp_path}/t"
    first = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)], SCHEMA)
    write_groups(first, path, [1, 2, 3], fmt=fmt)
    again = spark.createDataFrame([(2, 30.0), (2, 31.0)], SCHEMA)
    for _ in range(2):
        write_groups(again, path, [2], fmt=fmt)
        assert _rows(read_groups(spark, path, first.schema, fmt)) == [(1, 1.0), (1, 2.0), (2, 30.0), (2, 31.0), (3, 4.0)]
    write_groups(again, path, [2, 3], fmt=fmt)  # seed 3 has no rows now
    assert _rows(read_groups(spark, path, first.schema, fmt)) == [(1, 1.0), (1, 2.0), (2, 30.0), (2, 31.0)]


def test_failed_group_write_leaves_every_seed(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = spark.createDataFrame([(1, 1.0), (2, 3.0)], SCHEMA)
    write_groups(first, path, [1, 2])
    bad = spark.createDataFrame([(1, 0.5), (2, 9.0)], SCHEMA).repartition(2, "seed")
    with pytest.raises(Exception, match="no such value"):
        write_groups(_failing(bad), path, [1, 2])
    assert _rows(read_groups(spark, path, first.schema)) == [(1, 1.0), (2, 3.0)]


def test_rows_of_other_seeds_raise_before_writing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for other in (5, None):
        with pytest.raises(ValueError, match="not among"):
            write_groups(spark.createDataFrame([(1, 1.0), (other, 1.0)], SCHEMA), path, [1])
    assert not os.path.exists(f"{tmp_path}/t")


def test_no_rows_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    none = spark.createDataFrame([], SCHEMA)
    write_groups(none, path, [1])
    assert _rows(read_groups(spark, path, none.schema)) == []


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_failed_table_write_leaves_the_old_one(spark, tmp_path, fmt):
    path = f"file://{tmp_path}/t"
    write_table(spark.createDataFrame([(1, 0.5)], SCHEMA), path, fmt)
    with pytest.raises(Exception, match="no such value"):
        write_table(_failing(spark.createDataFrame([(1, 9.0)], SCHEMA)), path, fmt)
    back = read_groups(spark, path, spark.createDataFrame([], SCHEMA).schema, fmt)
    assert _rows(back) == [(1, 0.5)]
    assert os.listdir(tmp_path) == ["t"]  # nothing left beside it


def test_table_written_from_itself(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write_table(spark.createDataFrame([(1, 0.5)], SCHEMA), path)
    for _ in range(2):
        old = spark.read.parquet(path)
        write_table(old.unionByName(old.withColumn("v", F.col("v") + 1)), path)
    assert _rows(spark.read.parquet(path)) == [(1, 0.5), (1, 1.5), (1, 1.5), (1, 2.5)]
    write_json(spark.createDataFrame([(1, float("nan"))], SCHEMA), f"{path}-json")
    write_json(spark.createDataFrame([(2, 2.0)], SCHEMA), f"{path}-json")
    assert [tuple(r) for r in spark.read.json(f"{path}-json").select("seed", "v").collect()] == [(2, 2.0)]
