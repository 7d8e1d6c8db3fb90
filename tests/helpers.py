import datetime as dt

from pyspark.sql import functions as F


def ts(s):
    return dt.datetime.fromisoformat(s)


def obs_frame(spark, rows, cols=("value",), series="s"):
    """rows: list of (iso timestamp, v1, v2, ...)."""
    data = [(series, ts(r[0]), *[None if v is None else float(v) for v in r[1:]]) for r in rows]
    schema = "series_id string, ts timestamp_ntz, " + ", ".join(f"`{c}` double" for c in cols)
    return spark.createDataFrame(data, schema)


def hourly_series(spark, values, start="2024-01-01 00:00:00", cols=("value",), series="s", step_hours=1):
    t0 = ts(start)
    rows = [((t0 + dt.timedelta(hours=i * step_hours)).isoformat(sep=" "), *(v if isinstance(v, tuple) else (v,)))
            for i, v in enumerate(values)]
    return obs_frame(spark, rows, cols, series)


def col_list(df, c, order="idx"):
    return [r[0] for r in df.orderBy(order).select(c).collect()]
