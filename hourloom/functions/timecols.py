"""Time-zone-free timestamp arithmetic on TIMESTAMP_NTZ columns.

All grid arithmetic runs on microseconds since 1970-01-01 in wall-clock
terms (``timestamp_diff`` / ``timestamp_add`` treat NTZ values in UTC), so a
daylight-saving change in the session zone never bends an hourly grid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_SECOND = 1_000_000

# Named grid steps (seconds).
STEPS = {"minute": 60, "hour": 3600, "day": 86400}


def step_seconds(step: str | int) -> int:
    if isinstance(step, int):
        return step
    return STEPS[step]


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def to_micros(ts: Column | str) -> Column:
    """TIMESTAMP_NTZ -> LONG microseconds since the epoch (wall clock)."""
    return F.timestamp_diff("MICROSECOND", _epoch(), F.col(ts) if isinstance(ts, str) else ts)


def from_micros(us: Column | str) -> Column:
    """LONG microseconds since the epoch -> TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", F.col(us) if isinstance(us, str) else us, _epoch())


def floor_to_step(ts: Column | str, step: str | int) -> Column:
    """Floor a TIMESTAMP_NTZ to a multiple of ``step`` (stays TIMESTAMP_NTZ)."""
    step_us = step_seconds(step) * US_PER_SECOND
    us = to_micros(ts)
    return from_micros(F.floor(us / F.lit(step_us)).cast("long") * F.lit(step_us))


def as_ntz(ts: Column | str) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return col.cast("timestamp_ntz")


def ts_text(ts: Column | str) -> Column:
    """Stable text form used in oracle comparisons."""
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM-dd HH:mm:ss")
