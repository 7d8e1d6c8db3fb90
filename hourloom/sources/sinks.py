"""Sinks: tables (S2), JSON metadata with non-finite values as null (S3),
fitted parameters write/reload (S4).  Model files and their size (S5) live in
``operators.modeling.save_model``.

Every write may be run again.  A whole table is written beside its place and
takes it when it is complete, so a write that fails leaves the old table.  A
table kept by seed (``write_groups``) replaces only the seeds that a run was
about: Spark's dynamic partition overwrite stages the new partitions and moves
them in when all tasks have ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import nonfinite_to_null
from ..session import exists, remove, rename


def _staged(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write beside ``path``, then take its place.  Between the two renames (or
    copies, in an object store) the old table lies beside it as ``.old-...``."""
    path = path.rstrip("/")
    tag = uuid.uuid4().hex[:12]
    fresh, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    try:
        write(fresh)
    except Exception:
        remove(spark, fresh)
        raise
    kept = exists(spark, path)
    if kept:
        rename(spark, path, old)
    try:
        rename(spark, fresh, path)
    except Exception:
        if kept:
            rename(spark, old, path)
        remove(spark, fresh)
        raise
    if kept:
        remove(spark, old)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Replace a table as parquet (default) or headered CSV.  The rows may
    come from the table itself."""
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    _staged(df.sparkSession, path, w.option("header", True).csv if fmt == "csv" else w.format(fmt).save)


def write_groups(df: DataFrame, path: str, groups: Iterable[int], key: str = "seed", fmt: str = "parquet") -> None:
    """Replace the named groups of a table kept by ``key`` and leave
    its other groups.  A named group without rows is removed (a seed that failed
    before and succeeds now leaves no failure).  Rows of groups not named raise,
    before anything is written."""
    named = sorted(set(groups))
    there = {r[0] for r in df.select(key).where(~F.col(key).isin(named) | F.col(key).isNull()).limit(1).collect()}
    if there:
        raise ValueError(f"rows of {key} {there} are not among {named}")
    present = {r[0] for r in df.select(key).distinct().collect()}  # at most the named groups
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    for g in named:
        if g not in present:
            remove(df.sparkSession, f"{path.rstrip('/')}/{key}={g}")


def read_groups(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A table of ``write_groups`` back, empty if no group has rows."""
    return spark.read.schema(schema).option("header", True).format(fmt).load(path)


def _has_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_floats(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_floats(kind.keyType) or _has_floats(kind.valueType)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def _finite(c: Column, kind: T.DataType) -> Column:
    """The value with every non-finite number in it, at any depth, as null.  A
    map key cannot be null: a non-finite one becomes its name as text."""
    if not _has_floats(kind):
        return c
    if isinstance(kind, T.StructType):
        parts = [_finite(c.getField(f.name) if "." not in f.name else c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        if _has_floats(kind.valueType):
            c = F.transform_values(c, lambda _, v: _finite(v, kind.valueType))
        if isinstance(kind.keyType, (T.DoubleType, T.FloatType)):
            c = F.transform_keys(c, lambda k, _: k.cast("string"))
        return c
    return nonfinite_to_null(c.cast("double"))


def json_safe(df: DataFrame) -> DataFrame:
    """S3 (value side): NaN and +-inf become NULL wherever they stand, in
    columns, structs, arrays and maps of any nesting, so JSON never carries
    ``"NaN"``."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    """S3: JSON lines with nulls kept as ``null`` fields."""
    _staged(df.sparkSession, path, json_safe(df).write.option("ignoreNullFields", False).json)


def to_json_text(df: DataFrame, col: str = "json") -> DataFrame:
    """S3 as a column: one JSON document per row (nulls kept)."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in safe.columns]),
                                 {"ignoreNullFields": "false"}).alias(col))


def save_params(params: DataFrame, feature_params: DataFrame, root: str) -> None:
    """The wide per-series params and the long feature table."""
    write_table(params, f"{root.rstrip('/')}/params")
    write_table(feature_params, f"{root.rstrip('/')}/feature_params")


def load_params(spark: SparkSession, root: str) -> DataFrame:
    """S4 reload: apply to new data with ``plans.prepare.windows_with``."""
    return spark.read.parquet(f"{root.rstrip('/')}/params")
