"""DuckDB SQL of the one-feature ridge studies (see ``studyqueries``).

For one feature x and label k, the ridge fit on the train rows is
``slope = covar_pop(x, k) / (var_pop(x) + l2)`` with the mean-matching
intercept.  A blended label ``a*y + (1-a)*t`` of a linear teacher
``t = b0 + b1*x`` stays within the same moments.
"""

from __future__ import annotations

import math

from .catalog import EVENTS_ALL, EVENTS_BY_TYPE
from .oracle import prepared_ctes

SEEDS = (42, 123, 2024, 7, 99)
# Search dimensions of the two stages: (name, low, high, log-uniform).
LINEAR = (("l2", 1e-7, 1e-3, True),)
STUDENT = (("l2", 1e-8, 5e-4, True), ("kd_alpha", 0.25, 1.0, False))

BOOSTED = (("max_depth", (2, 3, 4)), ("max_iter", tuple(range(10, 41))), ("step_size", (0.05, 0.1, 0.2)), ("subsampling_rate", (0.75, 1.0)))


def _draw(i: int, dim: tuple) -> str:
    name, low, high, log = dim
    u = f"(CAST('0x' || substr(md5(seed || '|' || trial || '|{i}|{name}'), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE)"
    if log:
        return f"exp({math.log(low)!r}::DOUBLE + {u} * {math.log(high / low)!r}::DOUBLE) AS {name}"
    return f"({low!r}::DOUBLE + {u} * {high - low!r}::DOUBLE) AS {name}"


def _choice(i: int, name: str, values: tuple) -> str:
    """Draw of a whole number or of one of some values."""
    u = f"(CAST('0x' || substr(md5(seed || '|' || trial || '|{i}|{name}'), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE)"
    kind = "INTEGER" if isinstance(values[0], int) else "DOUBLE"
    listed = ", ".join(f"{v!r}::{kind}" for v in values)
    return f"([{listed}])[1 + CAST(floor({u} * {len(values)}) AS INTEGER)] AS {name}"


def boosted_trials_sql() -> str:
    draws = ", ".join(_choice(i, name, values) for i, (name, values) in enumerate(BOOSTED))
    return (f"SELECT CAST(seed AS INTEGER) AS seed, CAST(trial AS INTEGER) AS trial, {draws}, 'success' AS status, true AS within_rounds, true AS scored "
            f"FROM (SELECT unnest([{', '.join(map(str, SEEDS))}]) AS seed) CROSS JOIN (SELECT unnest(range(1, 31)) AS trial)")


def _trials(space: tuple, n: int, shift: int) -> str:
    draws = ", ".join(_draw(i, d) for i, d in enumerate(space))
    seeds = ", ".join(str(x + shift) for x in SEEDS)
    return (f"SELECT seed - {shift} AS study, seed, trial, {draws} FROM (SELECT unnest([{seeds}]) AS seed) "
            f"CROSS JOIN (SELECT unnest(range(1, {n + 1})) AS trial)")


def _metrics(pred: str, y: str = "y") -> str:
    sse = f"sum(({y} - ({pred})) * ({y} - ({pred})))"
    return (f"1.0 - {sse} / (count(*) * var_pop({y})) AS r2, avg(abs({y} - ({pred}))) AS mae, "
            f"sqrt({sse} / count(*)) AS rmse, {sse} / count(*) AS mse")


def ctes(kind_trials: int) -> str:
    """CTEs: w (windows with x, y and scaling), mom, tt (first stage trials with
    scores), tbest, tfit; st, sbest, sfit for the student."""
    src = EVENTS_ALL
    return f"""{prepared_ctes(src)},
w AS (SELECT v.series_id, v.idx, v.split, v.y_raw AS y, v.y_scaled AS ys, s.x_first AS x, p.y_mean, p.y_std
      FROM wins v JOIN scaled s ON v.series_id = s.series_id AND v.idx = s.idx JOIN params p ON v.series_id = p.series_id),
val AS (SELECT * FROM w WHERE split = 'val'),
mom AS (SELECT avg(x) AS mx, avg(ys) AS my, var_pop(x) AS vx, covar_pop(x, ys) AS cxy FROM w WHERE split = 'train'),
t0 AS ({_trials(LINEAR, kind_trials, 0)}),
t1 AS (SELECT t0.*, cxy / (vx + l2) AS b1, my - cxy / (vx + l2) * mx AS b0 FROM t0 CROSS JOIN mom),
tt AS (SELECT t1.study, t1.seed, t1.trial, t1.l2, t1.b0, t1.b1, {_metrics("(b0 + b1 * x) * y_std + y_mean")}
       FROM t1 LEFT JOIN val w ON true GROUP BY ALL),
tbest AS (SELECT * FROM tt QUALIFY row_number() OVER (PARTITION BY seed ORDER BY coalesce(1.0 - r2, 1000000.0), trial) = 1),
s0 AS ({_trials(STUDENT, 30, 10000)}),
s1 AS (SELECT s0.*, (kd_alpha * cxy + (1 - kd_alpha) * tb.b1 * vx) / (vx + s0.l2) AS c1,
              kd_alpha * my + (1 - kd_alpha) * (tb.b0 + tb.b1 * mx) - (kd_alpha * cxy + (1 - kd_alpha) * tb.b1 * vx) / (vx + s0.l2) * mx AS c0
       FROM s0 JOIN tbest tb ON tb.seed = s0.study CROSS JOIN mom),
st AS (SELECT s1.study, s1.seed, s1.trial, s1.l2, s1.kd_alpha, s1.c0, s1.c1, {_metrics("(c0 + c1 * x) * y_std + y_mean")}
       FROM s1 LEFT JOIN val w ON true GROUP BY ALL),
sbest AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY seed ORDER BY coalesce(1.0 - r2, 1000000.0), trial) = 1)"""


def _rows(best: str, b0: str, b1: str, model: str, teacher: str) -> str:
    return f"""SELECT 'events' AS dataset, '{model}' AS model, '{teacher}' AS teacher, b.study AS seed, split, {_metrics(f"({b0} + {b1} * x) * y_std + y_mean")}
FROM {best} b CROSS JOIN w WHERE split <> 'train' GROUP BY b.study, split"""


def _results(parts: list[str]) -> str:
    return f"""m AS ({' UNION ALL '.join(parts)}),
res AS (SELECT dataset, model, teacher, CAST(seed AS INTEGER) AS seed,
  max(r2) FILTER (split = 'val') AS vr2, max(mae) FILTER (split = 'val') AS vmae, max(rmse) FILTER (split = 'val') AS vrmse,
  max(r2) FILTER (split = 'test') AS r2, max(mae) FILTER (split = 'test') AS mae, max(rmse) FILTER (split = 'test') AS rmse, max(mse) FILTER (split = 'test') AS mse
  FROM m GROUP BY ALL)"""


_FP32 = """SELECT dataset, model, teacher, seed, 'success' AS status, CAST(2 AS BIGINT) AS params, R6(vr2, 6) AS validation_R2,
R6(vmae, 6) AS validation_MAE_ugm3, R6(vrmse, 6) AS validation_RMSE_ugm3, R6(r2, 6) AS R2, R6(mae, 6) AS MAE_ugm3, R6(rmse, 6) AS RMSE_ugm3, R6(mse, 6) AS MSE_ugm3_sq FROM res"""


def _code(x: str, s: str, z: str) -> str:
    """Unclipped 8-bit code."""
    return f"round_even(({x}) / {s} + {z}, 0)"


def _affine(s: str, lo: str) -> str:
    return f"CASE WHEN {s} > 0 THEN least(greatest(round_even(-128.0 - {lo} / {s}, 0), -128.0), 127.0) END"


def int8_sql(samples: int = 250) -> str:
    """The fitted student through 8-bit inputs and outputs: calibration on the
    evenly spaced train windows, then scores, drop and saturation rates."""
    clip = "least(greatest({}, -128.0), 127.0)"
    rates = ", ".join(f"max({a}) FILTER (split = '{s}') AS {s}_{a}" for s in ("val", "test") for a in ("r2", "mae", "rmse", "isr", "osr"))
    return f"""WITH {ctes(30)},
tw AS (SELECT series_id, x, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS pos,
              count(*) OVER (PARTITION BY series_id) AS n FROM w WHERE split = 'train'),
pi AS (SELECT series_id, n, least({samples}, n) AS k, unnest(range(0, least({samples}, n))) AS i FROM (SELECT DISTINCT series_id, n FROM tw)),
ps AS (SELECT series_id, CASE WHEN k = 1 THEN 0 WHEN i = k - 1 THEN n - 1
              ELSE CAST(floor(i * ((n - 1.0::DOUBLE) / (k - 1))) AS BIGINT) END AS pos FROM pi),
samp AS (SELECT x FROM tw SEMI JOIN ps ON tw.series_id = ps.series_id AND tw.pos = ps.pos),
ci0 AS (SELECT (greatest(max(x), 0.0) - least(min(x), 0.0)) / 255.0 AS si, least(min(x), 0.0) AS lo FROM samp),
ci AS (SELECT si, {_affine("si", "lo")} AS zi FROM ci0),
co0 AS (SELECT study, (greatest(max(c0 + c1 * x), 0.0) - least(min(c0 + c1 * x), 0.0)) / 255.0 AS so, least(min(c0 + c1 * x), 0.0) AS lo
        FROM sbest CROSS JOIN samp GROUP BY study),
co AS (SELECT study, so, {_affine("so", "lo")} AS zo FROM co0),
q0 AS (SELECT b.study, w.split, w.y, w.y_mean, w.y_std, so, zo, c0, c1, c0 + c1 * w.x AS fp, si, zi, {_code("w.x", "si", "zi")} AS raw
       FROM sbest b JOIN co USING (study) CROSS JOIN ci CROSS JOIN w WHERE w.split <> 'train'),
q1 AS (SELECT *, {clip.format(_code(f"c0 + c1 * (({clip.format('raw')} - zi) * si)", "so", "zo"))} AS code FROM q0),
q2 AS (SELECT study, split, {_metrics("(code - zo) * so * y_std + y_mean")}, 1.0 - sum((y - (fp * y_std + y_mean)) * (y - (fp * y_std + y_mean))) / (count(*) * var_pop(y)) AS fp_r2,
              sum(CASE WHEN raw < -128 OR raw > 127 THEN 1 ELSE 0 END) / count(*) AS isr, sum(CASE WHEN code <= -128 OR code >= 127 THEN 1 ELSE 0 END) / count(*) AS osr
       FROM q1 GROUP BY study, split),
q3 AS (SELECT study, {rates}, max(fp_r2) FILTER (split = 'test') AS fp_r2 FROM q2 GROUP BY study)
SELECT 'events' AS dataset, 'distilled student' AS model, 'teacher' AS teacher, CAST(b.study AS INTEGER) AS seed, 'strict_int8_success' AS status,
       R6(val_r2, 6) AS validation_R2, R6(val_mae, 6) AS validation_MAE_ugm3, R6(val_rmse, 6) AS validation_RMSE_ugm3, R6(test_r2, 6) AS R2, R6(test_mae, 6) AS MAE_ugm3,
       R6(test_rmse, 6) AS RMSE_ugm3, R6(fp_r2 - test_r2, 6) AS quantization_R2_drop, R6(val_isr, 6) AS validation_input_saturation_rate,
       R6(val_osr, 6) AS validation_output_saturation_rate, R6(test_isr, 6) AS input_saturation_rate, R6(test_osr, 6) AS output_saturation_rate,
       R6(si, 6) AS in_scale, zi AS in_zero_point, R6(so, 6) AS out_scale, zo AS out_zero_point
FROM sbest b JOIN co USING (study) CROSS JOIN ci LEFT JOIN q3 ON b.study = q3.study"""


def specifications_sql() -> str:
    """the selected specification that each result row carries."""
    spec = "R6(l2 * 1000000.0::DOUBLE, 6) AS l2_e6"
    return f"""WITH {ctes(30)}
SELECT 'teacher' AS model, 'FP32' AS precision, CAST(study AS INTEGER) AS seed, 'l2' AS dimensions, {spec}, NULL::DOUBLE AS kd_alpha FROM tbest
UNION ALL SELECT 'distilled student', v.precision, CAST(study AS INTEGER), 'kd_alpha,l2', {spec.replace(" AS l2_e6", "")}, R6(kd_alpha, 6)
FROM sbest CROSS JOIN (VALUES ('FP32'), ('INT8')) v(precision)"""


def rerun_sql() -> str:
    """Predictions by seed after two seeds were written again, one unit higher."""
    part = "SELECT CAST(b.study AS INTEGER) AS seed, '{m}' AS model, w.y, ({a} + {b} * w.x) * y_std + y_mean AS p FROM {t} b CROSS JOIN w WHERE split <> 'train'"
    both = " UNION ALL ".join(part.format(m=m, a=a, b=b, t=t) for m, a, b, t in (("teacher", "b0", "b1", "tbest"), ("distilled student", "c0", "c1", "sbest")))
    return f"""WITH {ctes(30)},
p AS ({both})
SELECT seed, model, count(*) AS "rows", R6(avg(p + CASE WHEN seed IN (7, 42) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS mean_predicted, R6(avg(y), 6) AS mean_observed
FROM p GROUP BY seed, model"""


def moments_sql(window: int = 8) -> str:
    """Covariances of whole train windows (features time-major, then the label)."""
    return f"""WITH {prepared_ctes(EVENTS_BY_TYPE)},
flat AS (SELECT series_id, idx, flatten(list(xs) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)) AS x FROM scaled),
z AS (SELECT row_number() OVER () AS r, list_append(x, y_scaled) AS z FROM flat JOIN wins USING (series_id, idx) WHERE split = 'train'),
u AS (SELECT r, unnest(range(len(z))) AS i, unnest(z) AS v FROM z)
SELECT a.i AS i, b.i AS j, count(*) AS train_windows, R6(avg(a.v), 6) AS mean_i, R6(covar_pop(a.v, b.v), 6) AS covariance
FROM u a JOIN u b ON a.r = b.r AND a.i <= b.i GROUP BY a.i, b.i"""


def registered_sql() -> dict[str, str]:
    distil = _results([_rows("tbest", "b0", "b1", "teacher", "None"), _rows("sbest", "c0", "c1", "distilled student", "teacher")])
    linear = _results([_rows("tbest", "b0", "b1", "linear", "None")])
    who = "(VALUES ('teacher', 'None', 'FP32'), ('distilled student', 'teacher', 'FP32'), ('distilled student', 'teacher', 'INT8')) v(model, teacher, precision)"
    seeds = f"(SELECT CAST(unnest([{', '.join(map(str, SEEDS))}]) AS INTEGER) AS seed)"
    return {
        "ridge_moments_events": moments_sql(),
        "boosted_trials_events": boosted_trials_sql(),
        "sink_rerun_events": rerun_sql(),
        "distill_int8_events": int8_sql(),
        "distill_specifications_events": specifications_sql(),
        "distill_results_events": f"WITH {ctes(30)},\n{distil}\n{_FP32}",
        "baseline_results_events": f"WITH {ctes(60)},\n{linear}\n{_FP32}",
        "distill_summary_events": f"""WITH {ctes(30)},
{distil}
SELECT dataset, model, teacher, count(DISTINCT seed) AS number_of_seeds, R6(avg(r2), 6) AS R2_mean, R6(stddev_samp(r2), 6) AS R2_std,
       R6(avg(mae), 6) AS MAE_ugm3_mean, R6(avg(rmse), 6) AS RMSE_ugm3_mean FROM res GROUP BY ALL""",
        "distill_trials_events": f"""WITH {ctes(30)}
SELECT 'teacher' AS stage, CAST(seed AS INTEGER) AS seed, CAST(trial AS INTEGER) AS trial, R6(l2 * 1000000.0::DOUBLE, 6) AS l2_e6, -1.0::DOUBLE AS kd_alpha, 'success' AS status,
       CAST(2 AS BIGINT) AS params, R6(r2, 6) AS validation_R2, R6(rmse, 6) AS validation_RMSE_ugm3 FROM tt
UNION ALL SELECT 'student', CAST(seed AS INTEGER), CAST(trial AS INTEGER), R6(l2 * 1000000.0::DOUBLE, 6), R6(kd_alpha, 6), 'success', CAST(2 AS BIGINT), R6(r2, 6), R6(rmse, 6) FROM st""",
        "distill_predictions_events": f"""WITH {prepared_ctes(EVENTS_ALL)}
SELECT w.series_id, CASE split WHEN 'val' THEN 'validation' ELSE split END AS split, v.model, v.teacher, v.precision, s.seed, count(*) AS "rows", count(*) AS predicted
FROM wins w CROSS JOIN {who} CROSS JOIN {seeds} s WHERE split <> 'train' GROUP BY ALL""",
        "distill_status_events": f"""SELECT v.model, v.teacher, s.seed, v.precision, CASE v.precision WHEN 'INT8' THEN 'strict_int8_success' ELSE 'success' END AS status,
CAST(2 AS BIGINT) AS params, true AS no_device_size, true AS size_ok, 0 AS failed_seeds FROM {who} CROSS JOIN {seeds} s""",
    }
