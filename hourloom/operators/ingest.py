"""Ingest of a raw, all-string sensor table into observations.

P2/P3 column resolution (schema only), P4 best-of-N timestamp parse per
series, P5 drop unparsed timestamps, P6 drop the text column, F1 numeric
cleaning of every other column, P7 sparse-column gate per series (one wide
aggregate for all columns; target always kept), empty / parse-rate gates with
a policy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import qc
from ..functions.names import target_column, timestamp_column
from ..functions.numeric import clean_numeric
from ..functions.timeparse import MIN_SUCCESS_RATE, best_of_n_parse
from ..session import materialize, release

SERIES = "series_id"
MIN_NUMERIC_FRACTION = 0.25


class ParseGateError(ValueError):
    """Raised by ``on_fail="raise"``; ``failed`` has the report rows of all failing series."""

    def __init__(self, failed: DataFrame, message: str):
        super().__init__(message)
        self.failed = failed


@dataclass
class Ingested:
    observations: DataFrame      # (series_id, ts, target, predictors...)
    timestamp_col: str
    target: str
    predictors: list[str]
    value_cols: list[str]        # target and predictors in file order (feature order)
    parse_report: DataFrame      # per series: format_index, parse_rate, parse_passed
    column_report: DataFrame     # per series and column: numeric fraction, kept


def numeric_fractions(df: DataFrame, cols: list[str], by: str | None = None,
                      clean: Callable[[Column], Column] = clean_numeric) -> DataFrame:
    """P7 measure: share of rows whose cleaned value parses, per column (and
    per ``by``), in one aggregate (long form ``([by,] column, fraction)``).
    ``clean`` is the identity for columns that are clean already."""
    keys = [by] if by else []
    agg = df.groupBy(*keys).agg(*[F.avg(clean(qc(c)).isNotNull().cast("double")).alias(f"_p{i}") for i, c in enumerate(cols)],
                                F.count(F.lit(1)).alias("_rows"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_p{i}").alias("fraction")) for i, c in enumerate(cols)])
    return agg.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.column", "p.fraction")


def ingest(raw: DataFrame, series_col: str | None = None, timestamp_col: str | None = None,
           target_col: str | None = None, min_numeric_fraction: float = MIN_NUMERIC_FRACTION,
           min_parse_rate: float = MIN_SUCCESS_RATE, on_fail: str = "raise", persist: str = "write") -> Ingested:
    """``raw``: string columns as read (see ``sources.csv``); ``series_col``
    names the series key column (default: one series ``all``).

    ``on_fail`` for series whose timestamps parse below ``min_parse_rate``, and
    for a table without rows: ``raise``, ``exclude`` (their rows are left out;
    the report names them) or ``report`` (kept).

    A value column is kept when it is numeric enough in any series; in a
    series where it is not, its values are null (P7 per series).

    ``persist="write"`` lands three tables in the checkpoint folder: the raw
    strings as parquet, so that the passes over them (column counts, parse
    rates, times and numbers) read pruned columns instead of re-parsing the
    text files; the parse report (one row per series); and the rows with their
    times and cleaned numbers, which replace the raw strings and which the
    numeric fractions and the projection read, so that no text is read again."""
    if on_fail not in ("raise", "exclude", "report"):
        raise ValueError(f"unknown on_fail {on_fail!r}")
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    land = materialize if persist == "write" else lambda df, name: df
    raw = land(raw, "raw")
    key = series_col or SERIES
    # columns without any value (a header group's own columns elsewhere) are not candidates
    filled = raw.agg(F.count(F.lit(1)).alias("_rows"),
                     *[F.count(qc(c)).alias(f"_n{i}") for i, c in enumerate(raw.columns)]).collect()[0]
    if on_fail == "raise" and filled["_rows"] == 0:
        raise ValueError("the table has no rows")
    data_cols = [c for i, c in enumerate(raw.columns) if c != key and (filled[f"_n{i}"] > 0 or filled["_rows"] == 0)]
    ts_col = timestamp_col or timestamp_column(data_cols)
    target = target_col or target_column(data_cols)
    keyed = raw.select((qc(series_col).cast("string") if series_col else F.lit("all")).alias(SERIES),
                       *[qc(c) for c in data_cols])
    parsed, report = best_of_n_parse(keyed, ts_col, SERIES, out_col="_ts", keep=lambda df: land(df, "parse-report"))
    report = report.withColumn("parse_passed", F.col("parse_rate") >= F.lit(float(min_parse_rate)))
    if on_fail == "raise":
        bad = report.where(~F.col("parse_passed"))
        if not bad.isEmpty():
            raise ParseGateError(bad, f"{bad.count()} series have too few readable timestamps; all are in .failed")
    kept = parsed.where(F.col("_ts").isNotNull()).drop(ts_col)          # P5 + P6
    if on_fail == "exclude":
        kept = kept.join(report.where("parse_passed").select(SERIES), SERIES, "left_semi")
    value_cols = [c for c in data_cols if c != ts_col]
    kept = land(kept.select(SERIES, "_ts", *[clean_numeric(qc(c)).alias(c) for c in value_cols]), "parsed")
    if persist == "write":
        release(raw)
    fractions = numeric_fractions(kept, value_cols, SERIES, clean=lambda c: c)
    column_report = fractions.withColumn(
        "kept", (F.col("column") == F.lit(target)) | (F.col("fraction") >= F.lit(float(min_numeric_fraction))))
    good = {r["column"] for r in column_report.where("kept").select("column").distinct().collect()}  # column names
    predictors = [c for c in value_cols if c != target and c in good]
    # per series, the columns that are numeric there
    own = column_report.where("kept").groupBy(SERIES).agg(F.collect_set("column").alias("_own"))
    value = lambda c: F.when(F.array_contains("_own", c), qc(c)) if c != target else qc(c)
    obs = kept.join(own, SERIES).select(SERIES, F.col("_ts").alias("ts"), *[value(c).alias(c) for c in [target, *predictors]])
    value_cols = [c for c in value_cols if c == target or c in predictors]
    return Ingested(obs, ts_col, target, predictors, value_cols, report, column_report)
