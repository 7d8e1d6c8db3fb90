"""DuckDB SQL for the evaluation / quantisation queries (independent of the
Spark code: histories come from window frames, not arrays)."""

from __future__ import annotations

from .catalog import EVENTS_BY_TYPE, SeriesSource
from .evalqueries import ALPHA, MAX_LAG
from .oracle import prepared_ctes


from .oracle import r6  # noqa: E402


def _ctes(src: SeriesSource) -> str:
    w8 = "(PARTITION BY series_id ORDER BY idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
    lags = ", ".join(f"lag(target, {j}) OVER o AS l{j}" for j in range(1, MAX_LAG))

    def seq_sum(k: int, cur: str, prefix: str) -> str:
        # oldest-to-newest left-associated sum, the order of Spark's aggregate()
        terms = [f"{prefix}{j}" for j in range(k - 1, 0, -1)] + [cur]
        return " + ".join(terms)

    mas = ",\n    ".join(f"({seq_sum(k, 'target', 'l')}) / {k}.0 AS ma{k}" for k in range(1, MAX_LAG + 1))
    return prepared_ctes(src) + f""",
ext0 AS (
  SELECT series_id, idx, target, min(target) OVER {w8} AS hmin, max(target) OVER {w8} AS hmax, {lags}
  FROM scaled WINDOW o AS (PARTITION BY series_id ORDER BY idx)),
ext AS (
  SELECT series_id, idx, target AS last_val, hmin, hmax,
    {mas}
  FROM ext0),
wx AS (SELECT w.*, e.* EXCLUDE (series_id, idx) FROM wins w JOIN ext e ON w.series_id = e.series_id AND w.idx = e.idx),
fc AS (
  SELECT series_id, target_ts, split, y_raw AS observed, last_val AS predicted, 'last' AS model FROM wx
  UNION ALL
  SELECT series_id, target_ts, split, y_raw AS observed, ma{MAX_LAG} AS predicted, 'window_mean' AS model FROM wx),
tw AS (
  SELECT series_id, idx, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS pos,
         count(*) OVER (PARTITION BY series_id) AS n
  FROM wins WHERE split = 'train'),
sz AS (SELECT DISTINCT series_id, n, least(250, n) AS k FROM tw),
pi AS (SELECT series_id, n, k, unnest(range(0, k)) AS i FROM sz),
ps AS (
  SELECT series_id, CASE WHEN k = 1 THEN 0 WHEN i = k - 1 THEN n - 1
                         ELSE CAST(floor(i * ((n - 1.0::DOUBLE) / (k - 1))) AS BIGINT) END AS pos FROM pi),
samp AS (SELECT tw.series_id, tw.idx, tw.pos FROM tw SEMI JOIN ps ON tw.series_id = ps.series_id AND tw.pos = ps.pos),
sampw AS (SELECT wx.* FROM wx SEMI JOIN samp ON wx.series_id = samp.series_id AND wx.idx = samp.idx),
cin AS (
  SELECT (greatest(max(hmax), 0.0) - least(min(hmin), 0.0)) / 255.0 AS s, least(min(hmin), 0.0) AS lo FROM sampw),
cin2 AS (SELECT s, CASE WHEN s > 0 THEN least(greatest(round_even(-128.0 - lo / s, 0), -128.0), 127.0) END AS z FROM cin),
sfc AS (
  SELECT last_val AS p, 'last' AS model FROM sampw UNION ALL SELECT ma{MAX_LAG} AS p, 'window_mean' AS model FROM sampw),
cout AS (
  SELECT model, (greatest(max(p), 0.0) - least(min(p), 0.0)) / 255.0 AS s, least(min(p), 0.0) AS lo FROM sfc GROUP BY model),
cout2 AS (SELECT model, s, CASE WHEN s > 0 THEN least(greatest(round_even(-128.0 - lo / s, 0), -128.0), 127.0) END AS z FROM cout),
qrow AS (
  SELECT sc.series_id, sc.idx,
         (least(greatest(round_even(sc.target / c.s + c.z, 0), -128.0), 127.0) - c.z) * c.s AS dq,
         CASE WHEN round_even(sc.target / c.s + c.z, 0) < -128 OR round_even(sc.target / c.s + c.z, 0) > 127 THEN 1 ELSE 0 END AS hit
  FROM scaled sc CROSS JOIN cin2 c),
qwin0 AS (
  SELECT series_id, idx, dq, sum(hit) OVER {w8} AS in_hits, count(*) OVER {w8} AS in_total,
         {", ".join(f"lag(dq, {j}) OVER o AS d{j}" for j in range(1, MAX_LAG))}
  FROM qrow WINDOW o AS (PARTITION BY series_id ORDER BY idx)),
qwin AS (
  SELECT series_id, idx, dq AS q_last, ({seq_sum(MAX_LAG, 'dq', 'd')}) / {MAX_LAG}.0 AS q_mean, in_hits, in_total
  FROM qwin0),
qfc0 AS (
  SELECT w.series_id, w.target_ts, w.split, w.y_raw AS observed, q.q_last AS p, 'last' AS model, q.in_hits, q.in_total
  FROM wins w JOIN qwin q ON w.series_id = q.series_id AND w.idx = q.idx WHERE w.split <> 'train'
  UNION ALL
  SELECT w.series_id, w.target_ts, w.split, w.y_raw, q.q_mean, 'window_mean', q.in_hits, q.in_total
  FROM wins w JOIN qwin q ON w.series_id = q.series_id AND w.idx = q.idx WHERE w.split <> 'train'),
qfc AS (
  SELECT f.*, least(greatest(round_even(f.p / c.s + c.z, 0), -128.0), 127.0) AS code, c.s AS os, c.z AS oz
  FROM qfc0 f JOIN cout2 c ON f.model = c.model),
scored AS (
  SELECT series_id, target_ts, split, model, observed, (code - oz) * os AS predicted, in_hits, in_total,
         (code <= -128 OR code >= 127) AS out_sat
  FROM qfc)"""


def _metrics(table: str, keys: str, where: str = "TRUE") -> str:
    return f"""(SELECT {keys}, count(*) AS n, sum((observed - predicted) * (observed - predicted)) AS sse,
          count(*) * var_pop(observed) AS sst, avg(abs(observed - predicted)) AS mae,
          avg((observed - predicted) * (observed - predicted)) AS mse
   FROM {table} WHERE observed IS NOT NULL AND predicted IS NOT NULL AND {where} GROUP BY {keys})"""


R2 = "CASE WHEN n < 2 THEN NULL WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 - sse / sst END"


def predictions_sql(src=EVENTS_BY_TYPE) -> str:
    return f"""WITH {_ctes(src)}
SELECT series_id, strftime(target_ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
       CASE WHEN split = 'val' THEN 'validation' ELSE split END AS split, model, 'None' AS teacher,
       'FP32' AS precision, {r6('observed')} AS observed, {r6('predicted')} AS predicted
FROM fc WHERE split <> 'train'"""


def metrics_sql(src=EVENTS_BY_TYPE) -> str:
    return f"""WITH {_ctes(src)}
SELECT series_id, model, split, {r6(R2)} AS R2, {r6('mae')} AS MAE_ugm3, {r6('sqrt(mse)')} AS RMSE_ugm3,
       {r6('mse')} AS MSE_ugm3_sq, n
FROM {_metrics('fc', 'series_id, model, split')}"""


def _trials_cte(src) -> str:
    cases = " ".join(f"WHEN {k} THEN ma{k}" for k in range(1, MAX_LAG + 1))
    return _ctes(src) + f""",
tr0 AS (
  SELECT series_id, CAST(t.k AS INTEGER) AS trial, y_raw AS observed, CASE t.k {cases} END AS predicted
  FROM wx, range(1, {MAX_LAG + 1}) t(k) WHERE split = 'val'),
tr AS (
  SELECT series_id, trial, CAST(trial AS BIGINT) AS params, {R2} AS validation_R2, mae AS validation_MAE_ugm3,
         sqrt(mse) AS validation_RMSE_ugm3, coalesce(1.0 - ({R2}), 1000000.0) AS objective
  FROM {_metrics('tr0', 'series_id, trial')})"""


def trials_sql(src=EVENTS_BY_TYPE) -> str:
    return f"""WITH {_trials_cte(src)}
SELECT series_id, trial, params, {r6('validation_R2')} AS validation_R2, {r6('validation_MAE_ugm3')} AS validation_MAE_ugm3,
       {r6('validation_RMSE_ugm3')} AS validation_RMSE_ugm3, {r6('objective')} AS objective_1_minus_validation_R2,
       {r6('max(validation_R2) OVER (PARTITION BY series_id ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS best_so_far_R2
FROM tr WHERE validation_R2 IS NOT NULL"""


def best_trial_sql(src=EVENTS_BY_TYPE) -> str:
    return f"""WITH {_trials_cte(src)},
rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY objective, trial) AS r FROM tr)
SELECT series_id, trial, params, {r6('objective')} AS objective_1_minus_validation_R2 FROM rk WHERE r = 1"""


def tradeoff_sql(src=EVENTS_BY_TYPE) -> str:
    return f"""WITH {_trials_cte(src)},
ok AS (SELECT * FROM tr WHERE validation_R2 IS NOT NULL),
pv AS (SELECT *, max(validation_R2) OVER (PARTITION BY series_id ORDER BY params, validation_R2 DESC, trial
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ok)
SELECT series_id, trial, params, {r6('validation_R2')} AS validation_R2, (prev IS NULL OR validation_R2 > prev) AS pareto FROM pv"""


def _kd_cte(src) -> str:
    return _ctes(src) + f""",
kd AS (
  SELECT w.series_id, w.target_ts, w.split, w.y_scaled, (w.last_val - p.y_mean) / p.y_std AS teacher_scaled,
         (w.ma{MAX_LAG} - p.y_mean) / p.y_std AS predicted_scaled
  FROM wx w JOIN params p ON w.series_id = p.series_id)"""


def kd_pairs_sql(src=EVENTS_BY_TYPE) -> str:
    a = f"{ALPHA!r}::DOUBLE"
    return f"""WITH {_kd_cte(src)}
SELECT series_id, strftime(target_ts, '%Y-%m-%d %H:%M:%S') AS target_ts, split, {r6('y_scaled')} AS y_scaled,
       {r6('teacher_scaled')} AS teacher_scaled, {r6(f'{a} * y_scaled + (1.0::DOUBLE - {a}) * teacher_scaled')} AS kd_label
FROM kd"""


def distillation_loss_sql(src=EVENTS_BY_TYPE) -> str:
    a = f"{ALPHA!r}::DOUBLE"
    hard = "avg((y_scaled - predicted_scaled) * (y_scaled - predicted_scaled))"
    soft = "avg((teacher_scaled - predicted_scaled) * (teacher_scaled - predicted_scaled))"
    return f"""WITH {_kd_cte(src)}
SELECT series_id, split, {r6(f'{a} * {hard} + (1.0::DOUBLE - {a}) * {soft}')} AS distillation_loss,
       {r6(hard)} AS hard_mse, {r6(soft)} AS soft_mse
FROM kd GROUP BY series_id, split"""


def representative_sample_sql(src=EVENTS_BY_TYPE) -> str:
    return f"WITH {_ctes(src)}\nSELECT series_id, idx, pos FROM samp"


def int8_calibration_sql(src=EVENTS_BY_TYPE) -> str:
    return f"""WITH {_ctes(src)}
SELECT 'input' AS tensor, {r6('s')} AS scale, z AS zero_point FROM cin2
UNION ALL
SELECT 'output:' || model, {r6('s')}, z FROM cout2"""


def int8_metrics_sql(src=EVENTS_BY_TYPE) -> str:
    return f"""WITH {_ctes(src)},
m AS {_metrics('scored', 'series_id, model, split')},
r AS (SELECT series_id, model, split, sum(in_hits) / greatest(1, sum(in_total)) AS isr,
             sum(CAST(out_sat AS BIGINT)) / greatest(1, count(*)) AS osr FROM scored GROUP BY series_id, model, split)
SELECT m.series_id, m.model, m.split, {r6(R2)} AS R2, {r6('mae')} AS MAE_ugm3, {r6('sqrt(mse)')} AS RMSE_ugm3,
       {r6('isr')} AS input_saturation_rate, {r6('osr')} AS output_saturation_rate
FROM m JOIN r ON m.series_id = r.series_id AND m.model = r.model AND m.split = r.split"""


def _results_cte(src) -> str:
    def rows(table: str, precision: str, sat: bool) -> str:
        satj = ""
        satc = "CAST(NULL AS DOUBLE) AS input_saturation_rate, CAST(NULL AS DOUBLE) AS output_saturation_rate"
        if sat:
            satj = (f"LEFT JOIN (SELECT series_id, model, sum(in_hits) / greatest(1, sum(in_total)) AS isr, "
                    f"sum(CAST(out_sat AS BIGINT)) / greatest(1, count(*)) AS osr FROM {table} WHERE split = 'test' "
                    f"GROUP BY series_id, model) s ON s.series_id = t.series_id AND s.model = t.model")
            satc = "s.isr AS input_saturation_rate, s.osr AS output_saturation_rate"
        r2v = R2.replace("n <", "v.n <").replace("sst", "v.sst").replace("sse", "v.sse")
        r2t = R2.replace("n <", "t.n <").replace("sst", "t.sst").replace("sse", "t.sse")
        return f"""SELECT '{src.name}' AS dataset, t.model, 'None' AS teacher, t.series_id AS seed, '{precision}' AS precision,
         {r2v} AS validation_R2, v.mae AS validation_MAE_ugm3, sqrt(v.mse) AS validation_RMSE_ugm3,
         {r2t} AS R2, t.mae AS MAE_ugm3, sqrt(t.mse) AS RMSE_ugm3, t.mse AS MSE_ugm3_sq,
         CAST(CASE WHEN t.model = 'last' THEN 1 ELSE 8 END AS BIGINT) AS params, {satc}
  FROM {_metrics(table, 'series_id, model', "split = 'test'")} t
  JOIN {_metrics(table, 'series_id, model', "split = 'val'")} v ON t.series_id = v.series_id AND t.model = v.model
  {satj}"""
    return _ctes(src) + f""",
res0 AS ({rows('fc', 'FP32', False)}
  UNION ALL
  {rows('scored', 'INT8', True)}),
res AS (
  SELECT r.*, CASE WHEN r.precision = 'INT8' THEN f.R2 - r.R2 ELSE 0.0 END AS quantization_R2_drop
  FROM res0 r LEFT JOIN (SELECT seed, model, R2 FROM res0 WHERE precision = 'FP32') f
    ON r.seed = f.seed AND r.model = f.model)"""


METRICS = ["validation_R2", "validation_MAE_ugm3", "validation_RMSE_ugm3", "R2", "MAE_ugm3", "RMSE_ugm3",
           "MSE_ugm3_sq", "params", "quantization_R2_drop", "input_saturation_rate", "output_saturation_rate"]


def seed_statistics_sql(src=EVENTS_BY_TYPE) -> str:
    cols = []
    for m in METRICS:
        x = f"CAST({m} AS DOUBLE)"
        cols += [f"{r6(f'avg({x})')} AS {m}__mean", f"{r6(f'stddev_samp({x})')} AS {m}__std",
                 f"{r6(f'min({x})')} AS {m}__min", f"{r6(f'max({x})')} AS {m}__max", f"count({x}) AS {m}__count"]
    return f"""WITH {_results_cte(src)}
SELECT dataset, model, teacher, precision, {", ".join(cols)}
FROM res GROUP BY dataset, model, teacher, precision"""


def seed_summary_sql(src=EVENTS_BY_TYPE) -> str:
    cols = ["count(DISTINCT seed) AS number_of_seeds"]
    for m in METRICS:
        x = f"CAST({m} AS DOUBLE)"
        std = f"CASE WHEN count({x}) = 0 THEN NULL ELSE coalesce(stddev_samp({x}), 0.0) END"
        cols += [f"{r6(f'avg({x})')} AS {m}_mean", f"{r6(std)} AS {m}_std",
                 f"CASE WHEN count({x}) = 0 THEN '' ELSE printf('%.6f ± %.6f', avg({x}), {std}) END AS {m}_mean_std"]
    return f"""WITH {_results_cte(src)}
SELECT dataset, model, teacher, precision, {", ".join(cols)}
FROM res GROUP BY dataset, model, teacher, precision"""


def registered() -> dict:
    return {
        "predictions_events": predictions_sql(),
        "metrics_events": metrics_sql(),
        "trials_events": trials_sql(),
        "best_trial_events": best_trial_sql(),
        "tradeoff_events": tradeoff_sql(),
        "kd_pairs_events": kd_pairs_sql(),
        "distillation_loss_events": distillation_loss_sql(),
        "representative_sample_events": representative_sample_sql(),
        "int8_calibration_events": int8_calibration_sql(),
        "int8_metrics_events": int8_metrics_sql(),
        "seed_statistics_events": seed_statistics_sql(),
        "seed_summary_events": seed_summary_sql(),
    }
