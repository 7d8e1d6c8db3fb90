"""Independent DuckDB SQL for the registered queries.

Written directly from the reference semantics (not generated from the Spark
plan): ``quantile_cont`` for exact medians and quartiles, ``last_value ...
IGNORE NULLS`` for the limited fill, ``range`` for the grid.
"""

from __future__ import annotations

from .catalog import SeriesSource

RE_R6 = "R6("


def r6(x: str) -> str:
    """6-decimal rounding written with plain IEEE operations (half-even on
    x * 1e6) so Spark and DuckDB give bit-identical values, ties included."""
    return f"(round_even(({x}) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0)"


def expand_r6(sql: str) -> str:
    """Replace each ``R6(expr, 6)`` marker with ``r6(expr)``."""
    out, i = [], 0
    while True:
        j = sql.find(RE_R6, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth = j + len(RE_R6), 1
        start = k
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[start:k - 1]
        expr = inner.rsplit(",", 1)[0]
        out.append(r6(expand_r6(expr)))
        i = k

STEP_FN = {"hour": ("to_hours", 3600), "day": ("to_days", 86400)}


def _obs_sql(src: SeriesSource) -> str:
    series = f"CAST({src.by} AS VARCHAR)" if src.by else "'all'"
    if src.name == "events":
        ts = "CAST(ts AS TIMESTAMP)"
        cols = "CAST(value AS DOUBLE) AS value, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k"
        table = "events"
    elif src.name == "orders":
        ts = "CAST(o_orderdate AS TIMESTAMP)"
        cols = "CAST(o_totalprice AS DOUBLE) AS o_totalprice"
        table = "orders"
    else:
        ts = "CAST(l_shipdate AS TIMESTAMP)"
        cols = ("CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount, "
                "CAST(l_quantity AS DOUBLE) AS l_quantity")
        table = "lineitem"
    if src.align == "floor":
        ts = f"date_trunc('{src.step}', {ts})"
    return f"SELECT {series} AS series_id, {ts} AS ts, {cols} FROM {table} WHERE {ts} IS NOT NULL"


def prepared_ctes(src: SeriesSource, train_fraction: float = 0.70, validation_fraction: float = 0.15,
                  ffill_limit: int = 3, window: int = 8) -> str:
    """CTEs: obs, bounds, dedup, grid, hourly, splits, feats, med, rob, params,
    scaled, wins (complete windows with digests)."""
    add_fn, step_s = STEP_FN[src.step]
    vals = [src.target, *src.predictors]
    n_feat = len(vals) + 4
    fin = lambda c: f"CASE WHEN isfinite({c}) THEN {c} END"
    ffill = ",\n    ".join(
        f"last_value({fin(p)} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx "
        f"ROWS BETWEEN {ffill_limit} PRECEDING AND CURRENT ROW) AS {p}" for p in src.predictors)
    ffill = (",\n    " + ffill) if ffill else ""
    feat_exprs = [f"{c} AS f{i}" for i, c in enumerate(vals)]
    two_pi = "(2 * pi())"
    feat_exprs += [f"sin({two_pi} * CAST(hour(ts) AS DOUBLE) / 24.0) AS f{len(vals)}",
                   f"cos({two_pi} * CAST(hour(ts) AS DOUBLE) / 24.0) AS f{len(vals) + 1}",
                   f"sin({two_pi} * CAST(isodow(ts) - 1 AS DOUBLE) / 7.0) AS f{len(vals) + 2}",
                   f"cos({two_pi} * CAST(isodow(ts) - 1 AS DOUBLE) / 7.0) AS f{len(vals) + 3}"]
    med = ", ".join(f"coalesce(quantile_cont(f{i}, 0.5), 0.0) AS m{i}" for i in range(n_feat))
    rob = ", ".join(f"quantile_cont(coalesce(f{i}, m{i}), [0.25, 0.5, 0.75]) AS q{i}" for i in range(n_feat))
    scale = lambda i: f"(CASE WHEN q{i}[3] - q{i}[1] = 0 THEN 1.0 ELSE q{i}[3] - q{i}[1] END)"
    xs = [f"((coalesce(f{i}, m{i}) - q{i}[2]) / {scale(i)})" for i in range(n_feat)]
    upper = repr(float(train_fraction) + float(validation_fraction))
    agg_vals = ", ".join(f"avg({c}) AS {c}" for c in vals)
    # position weights: row r of the window adds r * n_feat to each of its features' weights
    lagged = " + ".join(f"{r * n_feat} * lag(row_sum, {window - 1 - r}, 0) OVER o" for r in range(1, window))
    return f"""
obs AS ({_obs_sql(src)}),
bounds AS (
  SELECT series_id, min(ts) AS t0, max(ts) AS t1, count(*) AS raw_rows,
         (epoch_us(max(ts)) - epoch_us(min(ts))) // {step_s * 1_000_000} + 1 AS n
  FROM obs GROUP BY series_id),
dedup AS (SELECT series_id, ts, {agg_vals} FROM obs GROUP BY series_id, ts),
gidx AS (SELECT series_id, t0, unnest(range(0, n)) AS idx FROM bounds),
grid AS (SELECT series_id, idx, t0 + {add_fn}(CAST(idx AS BIGINT)) AS ts FROM gidx),
hourly0 AS (SELECT g.series_id, g.idx, g.ts, {", ".join("d." + c for c in vals)}
            FROM grid g LEFT JOIN dedup d ON g.series_id = d.series_id AND g.ts = d.ts),
hourly AS (
  SELECT series_id, idx, ts, {fin(src.target)} AS {src.target}{ffill}
  FROM hourly0),
splits AS (
  SELECT series_id, n, CAST(floor(n * {float(train_fraction)!r}::DOUBLE) AS BIGINT) AS train_end,
         CAST(floor(n * {upper}::DOUBLE) AS BIGINT) AS val_end
  FROM bounds),
feats AS (
  SELECT h.series_id, h.idx, h.ts, h.{src.target} AS target, {", ".join(feat_exprs)}, s.n, s.train_end, s.val_end
  FROM hourly h JOIN splits s ON h.series_id = s.series_id),
med AS (
  SELECT series_id, {med}, avg(target) AS y_mean, stddev_pop(target) AS y_std0, count(target) AS train_targets
  FROM feats WHERE idx < train_end GROUP BY series_id),
rob AS (
  SELECT f.series_id, {rob}
  FROM feats f JOIN med m ON f.series_id = m.series_id WHERE f.idx < f.train_end GROUP BY f.series_id),
params AS (
  SELECT m.*, r.* EXCLUDE (series_id),
         CASE WHEN y_std0 IS NULL OR y_std0 = 0 THEN 1.0 ELSE y_std0 END AS y_std
  FROM med m JOIN rob r ON m.series_id = r.series_id),
scaled AS (
  SELECT f.series_id, f.idx, f.ts, f.target, f.train_end, f.val_end,
         (f.target - p.y_mean) / p.y_std AS y_scaled,
         {" + ".join(xs)} AS row_sum, {" + ".join(f"{i + 1} * {x}" for i, x in enumerate(xs))} AS row_weighted,
         {xs[0]} AS x_first, {xs[-1]} AS x_last, [{", ".join(xs)}] AS xs
  FROM feats f JOIN params p ON f.series_id = p.series_id),
wins0 AS (
  SELECT series_id, idx, train_end, val_end,
         sum(row_sum) OVER w AS seq_sum, sum(row_weighted) OVER w + {lagged} AS seq_weighted, count(target) OVER w AS hist,
         first_value(x_first) OVER w AS seq_first, x_last AS seq_last, count(*) OVER w AS rows_in,
         lead(target, 1) OVER o AS y_raw, lead(y_scaled, 1) OVER o AS y_scaled, lead(ts, 1) OVER o AS target_ts
  FROM scaled
  WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW),
         o AS (PARTITION BY series_id ORDER BY idx)),
wins AS (
  SELECT series_id, idx, target_ts, y_raw, y_scaled, seq_sum, seq_weighted, seq_first, seq_last, rows_in * {n_feat} AS seq_len,
         CASE WHEN idx + 1 < train_end THEN 'train' WHEN idx + 1 < val_end THEN 'val' ELSE 'test' END AS split
  FROM wins0 WHERE idx >= {window - 1} AND hist = {window} AND y_raw IS NOT NULL)"""


def hourly_sql(src: SeriesSource) -> str:
    cols = ", ".join(f"R6({c}, 6) AS {c}" for c in [src.target, *src.predictors])
    return (f"WITH {prepared_ctes(src)}\nSELECT series_id, idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {cols} "
            f"FROM hourly")


def audit_sql(src: SeriesSource) -> str:
    add_fn, _ = STEP_FN[src.step]
    return f"""WITH {prepared_ctes(src)},
vt AS (SELECT series_id, count({src.target}) AS v FROM hourly GROUP BY series_id)
SELECT b.series_id, '{src.name}' AS source, 'ts' AS timestamp_column, '{src.target}' AS target_column,
       '{', '.join(src.predictors)}' AS predictor_columns, b.raw_rows AS rows_after_timestamp_filter, b.n AS hourly_grid_rows,
       strftime(b.t0, '%Y-%m-%d %H:%M:%S') AS hourly_start,
       strftime(b.t0 + {add_fn}(CAST(b.n - 1 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS hourly_end,
       coalesce(vt.v, 0) AS valid_target_values, b.n - coalesce(vt.v, 0) AS target_missing_after_reindex
FROM bounds b LEFT JOIN vt ON b.series_id = vt.series_id"""


def split_points_sql(src: SeriesSource) -> str:
    return f"WITH {prepared_ctes(src)}\nSELECT series_id, n, train_end, val_end FROM splits"


def feature_names(src: SeriesSource) -> list[str]:
    return [("PM2.5_current" if c == src.target else c) for c in [src.target, *src.predictors]] + [
        "hour_sin", "hour_cos", "weekday_sin", "weekday_cos"]


def feature_params_sql(src: SeriesSource) -> str:
    names = feature_names(src)
    parts = []
    for i, name in enumerate(names):
        scale = f"CASE WHEN q{i}[3] - q{i}[1] = 0 THEN 1.0 ELSE q{i}[3] - q{i}[1] END"
        parts.append(f"SELECT series_id, '{name}' AS feature, CAST({i} AS INTEGER) AS ord, R6(m{i}, 6) AS fill_median, "
                     f"R6(q{i}[2], 6) AS center, R6({scale}, 6) AS scale FROM params")
    return f"WITH {prepared_ctes(src)}\n" + "\nUNION ALL\n".join(parts)


def target_params_sql(src: SeriesSource) -> str:
    return f"WITH {prepared_ctes(src)}\nSELECT series_id, R6(y_mean, 6) AS y_mean, R6(y_std, 6) AS y_std FROM params"


def windows_sql(src: SeriesSource) -> str:
    return f"""WITH {prepared_ctes(src)}
SELECT series_id, strftime(target_ts, '%Y-%m-%d %H:%M:%S') AS target_ts, split,
       R6(y_raw, 6) AS y_raw, R6(y_scaled, 6) AS y_scaled, R6(seq_sum, 6) AS seq_sum, R6(seq_weighted, 6) AS seq_weighted,
       R6(seq_first, 6) AS seq_first, R6(seq_last, 6) AS seq_last, CAST(seq_len AS INTEGER) AS seq_len
FROM wins"""


def window_counts_sql(src: SeriesSource) -> str:
    return f"WITH {prepared_ctes(src)}\nSELECT series_id, split, count(*) AS windows FROM wins GROUP BY series_id, split"


def quality_sql(src: SeriesSource, min_targets: int = 500, min_train: int = 100, min_windows: int = 80,
                window: int = 8) -> str:
    return f"""WITH {prepared_ctes(src)},
vt AS (SELECT series_id, count({src.target}) AS v FROM hourly GROUP BY series_id),
wc AS (SELECT series_id, split, count(*) AS c FROM wins GROUP BY series_id, split),
sp AS (SELECT s.series_id, x.split FROM splits s CROSS JOIN (VALUES ('train'), ('val'), ('test')) x(split)),
mw AS (SELECT sp.series_id, min(coalesce(wc.c, 0)) AS m FROM sp LEFT JOIN wc ON sp.series_id = wc.series_id AND sp.split = wc.split GROUP BY sp.series_id),
checks AS (
  SELECT b.series_id, 'observed_targets' AS "check", CAST(coalesce(vt.v, 0) AS DOUBLE) AS observed, {float(min_targets)} AS threshold
  FROM bounds b LEFT JOIN vt ON b.series_id = vt.series_id
  UNION ALL
  SELECT s.series_id, 'split_valid', CASE WHEN {window} < train_end AND train_end < val_end AND val_end < n THEN 1.0 ELSE 0.0 END, 1.0 FROM splits s
  UNION ALL
  SELECT s.series_id, 'train_targets', CAST(coalesce(p.train_targets, 0) AS DOUBLE), {float(min_train)} FROM splits s LEFT JOIN params p ON s.series_id = p.series_id
  UNION ALL
  SELECT series_id, 'span_plausible', CASE WHEN n <= 2000000 AND n <= 1000.0 * raw_rows THEN 1.0 ELSE 0.0 END, 1.0 FROM bounds
  UNION ALL
  SELECT series_id, 'windows_per_split', CAST(m AS DOUBLE), {float(min_windows)} FROM mw)
SELECT series_id, "check", observed, threshold, observed >= threshold AS passed FROM checks"""


def registered_sql() -> dict:
    from .catalog import EVENTS_ALL, EVENTS_BY_TYPE, LINEITEM_BY_FLAG, ORDERS_ALL
    s = {}
    for tag, src in (("events", EVENTS_BY_TYPE), ("lineitem", LINEITEM_BY_FLAG), ("orders", ORDERS_ALL)):
        s[f"hourly_grid_{tag}"] = hourly_sql(src)
        s[f"audit_{tag}"] = audit_sql(src)
        s[f"split_points_{tag}"] = split_points_sql(src)
        s[f"feature_params_{tag}"] = feature_params_sql(src)
        s[f"target_params_{tag}"] = target_params_sql(src)
        s[f"windows_{tag}"] = windows_sql(src)
        s[f"window_counts_{tag}"] = window_counts_sql(src)
        s[f"quality_{tag}"] = quality_sql(src)
    s["windows_events_all"] = windows_sql(EVENTS_ALL)
    from .evaloracle import registered as eval_registered
    s.update(eval_registered())
    from .ingestqueries import registered_sql as ingest_sql
    s.update(ingest_sql())
    from .studyqueries import registered_sql as study_sql
    s.update(study_sql())
    return {k: expand_r6(v) for k, v in s.items()}
