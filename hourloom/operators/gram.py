"""Ridge search by sufficient statistics (M2, M3, M5 for linear learners).

A ridge fit needs of its train rows only the count, the means and the matrix
of cross products of features and labels.  ``gramian`` sums it in one pass
(each task adds up its own batches, so what is shuffled has the size of the
matrix), and every trial of every seed, penalty and blend of the labels is
then a small dense solve.  ``score_trials`` takes the coefficients of all
trials over the validation rows in one more pass.  The number of Spark jobs
of a search does not depend on its trials.

The solution is that of MLlib's ``LinearRegression`` without standardisation
and with the penalty as ``modeling.build_estimator`` passes it:
``(Cov(X) + l2 I) b = Cov(X, label)``, the intercept unpenalised.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LabelMoments:
    """Spread of the labels over the train rows (one aggregate per study stage)."""

    n: int
    var_y: float
    var_t: float
    cov: float

    def std(self, alpha: float = 1.0, sample: bool = False) -> float:
        """Standard deviation of ``alpha * y + (1 - alpha) * teacher``."""
        v = alpha ** 2 * self.var_y + 2 * alpha * (1 - alpha) * self.cov + (1 - alpha) ** 2 * self.var_t
        return math.sqrt(max(v, 0.0) * (self.n / (self.n - 1) if sample and self.n > 1 else 1.0))


@dataclass(frozen=True)
class Gramian:
    """Moments over ``n`` rows: of the features first, then of the labels."""

    n: int
    mean: np.ndarray
    cov: np.ndarray          # population covariance of (features, labels)
    labels: tuple[str, ...]

    @property
    def width(self) -> int:
        return len(self.mean) - len(self.labels)

    @cached_property
    def _axes(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues and eigenvectors of the features' covariance: one
        decomposition serves every penalty."""
        w, v = np.linalg.eigh(self.cov[: self.width, : self.width])
        return np.maximum(w, 0.0), v

    def with_linear_label(self, name: str, coefficients: np.ndarray, intercept: float) -> Gramian:
        """With one more label, a linear function of the features (the soft
        labels of a linear teacher): its moments follow without a pass."""
        d = self.width
        up = np.concatenate([coefficients, np.zeros(len(self.labels))])
        cross = self.cov @ up
        cov = np.block([[self.cov, cross[:, None]], [cross[None, :], np.array([[up @ cross]])]])
        return Gramian(self.n, np.append(self.mean, self.mean[:d] @ coefficients + intercept), cov, (*self.labels, name))

    def ridge(self, l2: float, blend: Mapping[str, float]) -> tuple[np.ndarray, float]:
        """Coefficients and intercept for the label ``sum(weight * label)``."""
        if not np.isfinite(l2) or l2 < 0:
            raise ValueError(f"a penalty of {l2!r}")
        d = self.width
        pick = np.zeros(len(self.labels))
        for name, weight in blend.items():
            pick[self.labels.index(name)] = weight
        w, v = self._axes
        spread = w + l2
        # directions without spread or penalty get no weight (the least-norm solution)
        gain = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 1e-14 * max(float(w.max(initial=0.0)), 1e-300))
        b = v @ (gain * (v.T @ (self.cov[:d, d:] @ pick)))
        return b, float(self.mean[d:] @ pick - self.mean[:d] @ b)

    def label_moments(self) -> LabelMoments:
        """Spread of the target and, if they are among the labels, the soft labels."""
        d, t = self.width, len(self.labels) - 1
        return LabelMoments(self.n, float(self.cov[d, d]), float(self.cov[d + t, d + t]), float(self.cov[d, d + t]))

    def descent(self, l2: float, blend: Mapping[str, float], most: int = 200, tol: float = 1e-10) -> list[float]:
        """M8: the objective (half the mean squared error plus the penalty) at
        the start and after each conjugate-gradient step of the same problem,
        until the gradient has shrunk by ``tol``; no pass over rows."""
        d = self.width
        pick = np.array([blend.get(name, 0.0) for name in self.labels])
        a = self.cov[:d, :d] + l2 * np.eye(d)
        c = self.cov[:d, d:] @ pick
        b, r = np.zeros(d), c.copy()
        way, floor, start = r.copy(), float(r @ r) * tol * tol, 0.5 * float(pick @ self.cov[d:, d:] @ pick)
        out = [start]
        while len(out) <= most and (now := float(r @ r)) > floor:
            ahead = a @ way
            step = now / float(way @ ahead)
            b, r = b + step * way, r - step * ahead
            way = r + way * (float(r @ r) / now)
            out.append(start + 0.5 * float(b @ (a @ b)) - float(b @ c))
        return out


def gramian(rows: DataFrame, labels: tuple[str, ...] = ("y_scaled",), features: str = "features") -> Gramian:
    """Moments of features and labels over the train rows, one pass.  Rows with
    a null label are left out; a task's sums are taken about its own means."""
    train = rows.where(F.col("split") == "train").select(vector_to_array(features).alias("x"), *[F.col(c).cast("double") for c in labels])
    for c in labels:
        train = train.where(F.col(c).isNotNull())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            z = np.column_stack([x, *(b.column(c).to_numpy(zero_copy_only=False) for c in labels)])
            m = z.mean(axis=0)
            s = (z - m).T @ (z - m)
            n, mean, scatter = (len(z), m, s) if mean is None else _merged(n, mean, scatter, len(z), m, s)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([scatter.ravel().tolist()])], names=["n", "mean", "scatter"])

    parts = train.mapInArrow(add_up, "n long, mean array<double>, scatter array<double>")
    # merge of the tasks' moments: scatter = sum(scatter_i) + sum(n_i mean_i mean_i') - n mean mean'
    d = F.size("mean")
    at = F.sequence(F.lit(0), d * d - 1)
    outer = F.transform(at, lambda i: F.col("n") * F.get("mean", F.floor(i / d).cast("int")) * F.get("mean", (i % d).cast("int")))
    pieces = parts.select("n", F.posexplode(F.concat("scatter", outer, F.transform("mean", lambda m: F.col("n") * m))).alias("i", "v"))
    sums = {r["i"]: (r["v"], r["n"]) for r in pieces.groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()}  # features squared
    if not sums:
        raise ValueError("no train rows with labels")
    n = sums[0][1]
    k = round((-1 + (1 + 8 * len(sums)) ** 0.5) / 4)  # 2 k * k + k sums
    flat = np.array([sums[i][0] for i in range(len(sums))])
    mean = flat[2 * k * k:] / n
    total = (flat[: k * k] + flat[k * k: 2 * k * k]).reshape(k, k) / n - np.outer(mean, mean)
    return Gramian(n, mean, (total + total.T) / 2, tuple(labels))


def _merged(n: int, mean: np.ndarray, scatter: np.ndarray, n2: int, mean2: np.ndarray, scatter2: np.ndarray):
    both, gap = n + n2, mean2 - mean
    return both, mean + gap * (n2 / both), scatter + scatter2 + np.outer(gap, gap) * (n * n2 / both)


def score_trials(rows: DataFrame, coefficients: np.ndarray, intercepts: np.ndarray, features: str = "features") -> DataFrame:
    """(trial index, R2, MAE_ugm3, RMSE_ugm3) of all coefficient vectors over
    the rows, in target units, one pass (A8 for many predictions at once)."""
    weights, offsets = coefficients.T.copy(), intercepts
    known = rows.where(F.col("y_raw").isNotNull())
    x = known.select(vector_to_array(features).alias("x"), *[F.col(c).cast("double") for c in ("y_raw", "y_mean", "y_std")])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(offsets)))
        for b in batches:
            if not b.num_rows:
                continue
            y, mean, std = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y_raw", "y_mean", "y_std"))
            p = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) @ weights + offsets
            e = y[:, None] - (p * std[:, None] + mean[:, None])
            sums += np.abs(e).sum(axis=0), (e * e).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(offsets))), pa.array(sums[0]), pa.array(sums[1])], names=["i", "sae", "sse"])

    found = x.mapInArrow(errors, "i long, sae double, sse double").groupBy("i").agg(F.sum("sae").alias("sae"), F.sum("sse").alias("sse"))
    truth = known.agg(F.count("y_raw").alias("n"), (F.count("y_raw") * F.var_pop("y_raw")).alias("sst"))  # one row
    r2 = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
           .when(F.col("sst") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(1.0 - F.col("sse") / F.col("sst")))
    out = found.crossJoin(F.broadcast(truth)).where("n > 0")  # one-row side
    return out.select("i", r2.alias("R2"), (F.col("sae") / F.col("n")).alias("MAE_ugm3"), F.sqrt(F.col("sse") / F.col("n")).alias("RMSE_ugm3"))


def blend_of(spec: Mapping, label: str = "y_scaled") -> dict[str, float]:
    """Weights of the labels that a spec is fitted to (M2: blended)."""
    if "kd_alpha" not in spec:
        return {label: 1.0}
    a = float(spec["kd_alpha"])
    return {"y_scaled": a, "teacher_scaled": 1 - a}


def search(specs: list[dict], rows: DataFrame, moments: Gramian, label: str = "y_scaled") -> list[dict]:
    """Metrics of every spec (``l2``; with ``kd_alpha``: of the blended label),
    or the error of a spec that cannot be solved."""
    found, solved = [dict(s) for s in specs], []
    for i, spec in enumerate(specs):
        try:
            solved.append((i, *moments.ridge(float(spec["l2"]), blend_of(spec, label))))
        except Exception as e:  # noqa: BLE001 - failure isolation per trial
            found[i] |= {"status": "failed", "error": repr(e)}
    if solved:
        val = rows.where(F.col("split") == "val")
        scores = {r["i"]: r for r in score_trials(val, np.array([s[1] for s in solved]), np.array([s[2] for s in solved])).collect()}  # a row per trial
        for k, (i, _, _) in enumerate(solved):
            m = scores.get(k)
            found[i] |= {"status": "success", "error": "", "R2": m and m["R2"], "MAE_ugm3": m and m["MAE_ugm3"], "RMSE_ugm3": m and m["RMSE_ugm3"]}
    return found

