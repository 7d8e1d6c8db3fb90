"""Scaling, fill, inverse and objective expressions (F3-F6, F9) and the
affine INT8 quantiser (F7, F8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT8_MIN = -128
INT8_MAX = 127
FAILED_OBJECTIVE = 1e6


def _c(x: Column | str | float) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def standard_scale(y, mean, std) -> Column:
    """(y - mean) / std; NULL stays NULL."""
    return (_c(y) - _c(mean)) / _c(std)


def inverse_standard(p, mean, std) -> Column:
    """p * std + mean."""
    return _c(p) * _c(std) + _c(mean)


def nonzero_scale(s) -> Column:
    """A zero (or missing) spread scales by 1."""
    s = _c(s)
    return F.when(s.isNull() | (s == 0.0), F.lit(1.0)).otherwise(s)


def objective(r2) -> Column:
    """1 - R2; a failed trial scores 1e6."""
    return F.coalesce(F.lit(1.0) - _c(r2), F.lit(FAILED_OBJECTIVE))


def quantize_raw(x, scale, zero_point) -> Column:
    """Unclipped affine code rint(x / scale + zp) (half-to-even, as NumPy)."""
    return F.rint(F.try_divide(_c(x), _c(scale)) + _c(zero_point))


def clip_int8(q) -> Column:
    return F.least(F.greatest(_c(q), F.lit(float(INT8_MIN))), F.lit(float(INT8_MAX)))


def quantize(x, scale, zero_point) -> Column:
    """clip(rint(x / scale + zp), -128, 127) as TINYINT."""
    return clip_int8(quantize_raw(x, scale, zero_point)).cast("tinyint")


def dequantize(q, scale, zero_point) -> Column:
    """F8: (q - zp) * scale."""
    return (_c(q).cast("double") - _c(zero_point)) * _c(scale)
