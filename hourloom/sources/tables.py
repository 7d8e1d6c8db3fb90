"""Observation frames from the parquet tables.

Each returns ``(series_id, ts TIMESTAMP_NTZ, <target>, <predictors>...)`` and
selects only the columns it needs, so the scan's ReadSchema is pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _series(by: str | None) -> F.Column:
    return (F.col(by).cast("string") if by else F.lit("all")).alias("series_id")


def events_observations(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Event stream as a sensor table: target ``value``, predictor ``k`` from
    the JSON ``props``; series = all events or one per ``by`` column."""
    ev = table(spark, sf_dir, "events")
    return ev.select(_series(by), F.col("ts").cast("timestamp_ntz").alias("ts"),
                     F.col("value").cast("double").alias("value"),
                     F.get_json_object("props", "$.k").try_cast("double").alias("k"))


def orders_observations(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Daily order-price series (target ``o_totalprice``)."""
    o = table(spark, sf_dir, "orders")
    return o.select(_series(by), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
                    F.col("o_totalprice").cast("double").alias("o_totalprice"))


def lineitem_observations(spark: SparkSession, sf_dir: str, by: str | None = "l_returnflag") -> DataFrame:
    """Daily shipment series: target ``l_extendedprice``, predictors
    ``l_discount``, ``l_quantity``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(_series(by), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
                     F.col("l_extendedprice").cast("double").alias("l_extendedprice"),
                     F.col("l_discount").cast("double").alias("l_discount"),
                     F.col("l_quantity").cast("double").alias("l_quantity"))


def version(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    """Size and last change of a table's path: tells a changed input."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(path).getLength()), int(fs.getFileStatus(path).getModificationTime())
