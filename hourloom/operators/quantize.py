"""INT8 evaluation plane as column quantisation: J5 representative sample,
Q1 affine calibration, F7/F8 over arrays, A10 saturation rates, Q3
diagnostics.  The scheme is the public asymmetric per-tensor affine one:
``scale = (max - min) / 255`` over a range widened to contain 0,
``zero_point = round(-128 - min / scale)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scaling import INT8_MAX, INT8_MIN, clip_int8, dequantize, quantize_raw
from .halo import DEFAULT_CHUNK_ROWS

SERIES = "series_id"
REPRESENTATIVE_SAMPLES = 250


def rank_in_order(df: DataFrame, key_cols: list[str], order_col: str, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                  out: str = "pos") -> DataFrame:
    """0-based rank of each row within its key in ``order_col`` order, without
    a window over the whole key: rows are counted per ``(key, chunk)``, the
    small count table is prefix-summed, and ranks are assigned inside chunks."""
    chunked = df.withColumn("_chunk", F.floor(F.col(order_col) / F.lit(chunk_rows)).cast("long"))
    counts = chunked.groupBy(*key_cols, "_chunk").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*key_cols).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key_cols, "_chunk", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"),
                            F.sum("_c").over(Window.partitionBy(*key_cols)).alias("_total"))
    inner = Window.partitionBy(*key_cols, "_chunk").orderBy(order_col)
    ranked = chunked.join(offsets, [*key_cols, "_chunk"])
    return (ranked.withColumn(out, F.col("_off") + F.row_number().over(inner) - 1)
            .withColumnRenamed("_total", f"{out}_total").drop("_chunk", "_off"))


def representative_sample(windows: DataFrame, max_samples: int = REPRESENTATIVE_SAMPLES, split: str = "train",
                          key_cols: list[str] | None = None, order_col: str = "idx") -> DataFrame:
    """``k = min(max_samples, n)`` evenly spaced train windows per key in
    time order, both ends included: position ``floor(i * ((n-1)/(k-1)))`` for
    i < k-1 and exactly ``n-1`` for the last; k = 1 takes position 0."""
    key_cols = key_cols or [SERIES]
    train = windows.where(F.col("split") == split)
    # only the keys are ranked and shuffled; the chosen positions come back to the rows at the end
    ranked = rank_in_order(train.select(*key_cols, order_col), key_cols, order_col)
    sizes = train.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("n"))
    k = F.least(F.lit(max_samples).cast("long"), F.col("n"))
    pos_i = sizes.select(*key_cols, "n", k.alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("i"))
    step = (F.col("n") - F.lit(1.0)) / (F.col("k") - 1)
    pos = (F.when(F.col("k") == 1, F.lit(0).cast("long"))
            .when(F.col("i") == F.col("k") - 1, F.col("n") - 1)
            .otherwise(F.floor(F.col("i") * step).cast("long")))
    positions = pos_i.select(*key_cols, pos.alias("pos"))
    chosen = ranked.join(positions, [*key_cols, "pos"], "left_semi").select(*key_cols, order_col, "pos")
    return train.join(chosen, [*key_cols, order_col])


def calibrate(df: DataFrame, values: Column, key_cols: list[str] | None = None, prefix: str = "",
              array: bool = True) -> DataFrame:
    """Q1: per-tensor affine parameters from the min/max of ``values`` (an
    ARRAY<DOUBLE> column, or DOUBLE with ``array=False``), range widened to
    contain 0.  Min/max are algebraic, so this is a partial+final aggregate."""
    key_cols = key_cols or []
    lo, hi = (F.array_min(values), F.array_max(values)) if array else (values, values)
    agg = df.groupBy(*key_cols).agg(F.min(lo).alias("_lo"), F.max(hi).alias("_hi"))
    mn = F.least(F.col("_lo"), F.lit(0.0))
    mx = F.greatest(F.col("_hi"), F.lit(0.0))
    scale = (mx - mn) / F.lit(255.0)
    # an all-zero (or empty) range gives scale 0: zero point NULL, scale_ok false
    zp = F.when(scale > 0, F.least(F.greatest(F.rint(F.lit(float(INT8_MIN)) - F.try_divide(mn, scale)),
                                              F.lit(float(INT8_MIN))), F.lit(float(INT8_MAX))))
    out = agg.select(*key_cols, scale.alias(f"{prefix}scale"), zp.alias(f"{prefix}zero_point"))
    return out.withColumn(f"{prefix}scale_ok", F.col(f"{prefix}scale") > 0)


def input_saturation_counts(arr: Column, scale: Column, zp: Column) -> tuple[Column, Column]:
    """A10 (input side): codes strictly outside [-128, 127] before clipping."""
    hits = F.size(F.filter(arr, lambda v: (quantize_raw(v, scale, zp) < INT8_MIN) | (quantize_raw(v, scale, zp) > INT8_MAX)))
    return hits, F.size(arr)


def output_saturated(code: Column) -> Column:
    """A10 (output side): clipped code at either end (inclusive)."""
    return (code <= INT8_MIN) | (code >= INT8_MAX)


def fake_quant_array(arr: Column, scale: Column, zp: Column) -> Column:
    """Quantise then dequantise every element (what an INT8 input sees)."""
    return F.transform(arr, lambda v: dequantize(clip_int8(quantize_raw(v, scale, zp)), scale, zp))


def fake_quant(x: Column, scale: Column, zp: Column) -> tuple[Column, Column]:
    """Output side: (clipped code, dequantised value)."""
    code = clip_int8(quantize_raw(x, scale, zp))
    return code, dequantize(code, scale, zp)


def saturation_rates(df: DataFrame, keys: list[str], in_hits: str = "in_hits", in_total: str = "in_total",
                     out_sat: str = "out_sat") -> DataFrame:
    """Q3 rates per group: ``sum(hit) / greatest(1, sum(n))``."""
    return df.groupBy(*keys).agg(
        (F.sum(in_hits) / F.greatest(F.lit(1), F.sum(in_total))).alias("input_saturation_rate"),
        (F.sum(F.col(out_sat).cast("long")) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("output_saturation_rate"))
