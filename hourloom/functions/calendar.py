"""Calendar features (F2): sin/cos of hour-of-day and weekday (Monday = 0)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CALENDAR_FEATURES = ["hour_sin", "hour_cos", "weekday_sin", "weekday_cos"]


def calendar_columns(ts: Column | str) -> list[Column]:
    t = F.col(ts) if isinstance(ts, str) else ts
    hour = F.hour(t).cast("double")
    weekday = F.weekday(t).cast("double")  # Monday = 0, unlike dayofweek
    two_pi = 2.0 * math.pi
    return [
        F.sin(F.lit(two_pi) * hour / 24.0).alias("hour_sin"),
        F.cos(F.lit(two_pi) * hour / 24.0).alias("hour_cos"),
        F.sin(F.lit(two_pi) * weekday / 7.0).alias("weekday_sin"),
        F.cos(F.lit(two_pi) * weekday / 7.0).alias("weekday_cos"),
    ]
