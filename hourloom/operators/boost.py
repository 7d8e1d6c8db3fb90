"""Boosted searches by prefix scoring (M1, M5, M8, M9 for GBT learners).

Boosting adds one tree at a time and never looks back, so the first r trees of
a long fit are the fit of r rounds.  Trials that differ in their rounds alone
therefore form a *family* and share one fit, made with the most rounds that any
of them asks for.  Early stopping (M9) judges each round by the rounds before
it, so a trial of r rounds keeps r trees, or as many as the shared fit kept if
that stopped sooner.  One pass over the validation rows takes the predictions
at every tree count: losses (M8) and scores in target units, for all
trials of the family at once.

A row's prefixes come from the leaf that each tree sends it to: the values of
the leaves (bounded by rounds and depth, whatever the rows) are literals of one
projection, a running sum over the trees gives the prefixes, and metrics are
grouped by tree count with partial aggregation, so what is shuffled is one row
per task and round.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scaling import inverse_standard
from . import evaluate as ev

ROUNDS = "max_iter"
_LEAF = re.compile(r"Predict: (\S+)")


@dataclass(frozen=True)
class Curve:
    """One fit seen at every tree count: ``rows[r - 1]`` are the metrics of
    its first r trees over the validation rows, ``nodes[r - 1]`` their nodes."""

    rows: list[dict]
    nodes: list[int]


def leaf_values(model: GBTRegressionModel) -> list[list[float]]:
    """Per tree the weighted values of its leaves, left to right (the order of
    the leaf indices that the model's ``leafCol`` gives)."""
    return [[w * float(v) for v in _LEAF.findall(t.toDebugString)] for w, t in zip(model.treeWeights, model.trees, strict=True)]


def prefix_predictions(model: GBTRegressionModel, rows: DataFrame, out: str = "prefixes") -> DataFrame:
    """The rows with the scaled predictions of the first 1, 2, ... trees."""
    model = model.copy({model.leafCol: "_leaves"})
    values = F.array(*[F.array(*[F.lit(v) for v in tree]) for tree in leaf_values(model)])
    steps = F.zip_with(F.transform(vector_to_array("_leaves"), lambda x: x.cast("int")), values, lambda i, tree: F.get(tree, i))
    sums = F.aggregate(steps, F.array().cast("array<double>"),
                       lambda acc, v: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + v))
    return model.transform(rows).withColumn(out, sums).drop("_leaves", "prediction")


def curve(model: GBTRegressionModel, val: DataFrame) -> Curve:
    """Losses and metrics (A8, target units) at every tree count, one pass."""
    pre = prefix_predictions(model, val.where(F.col("y_raw").isNotNull()))
    long = pre.select("y_raw", "y_scaled", "y_mean", "y_std", F.posexplode("prefixes").alias("tree", "p"))
    found = long.groupBy("tree").agg(F.avg((F.col("y_scaled") - F.col("p")) ** 2).alias("loss"),
                                     *ev.metric_columns("y_raw", inverse_standard("p", "y_mean", "y_std")))
    rows = [r.asDict() for r in found.orderBy("tree").collect()]   # one row per round
    nodes, total = [], 0
    for t in model.trees:
        total += t.numNodes
        nodes.append(total)
    return Curve(rows, nodes)


def families(specs: list[dict]) -> dict[tuple, list[int]]:
    """Positions of the specs by everything but their rounds."""
    found: dict[tuple, list[int]] = {}
    for i, s in enumerate(specs):
        found.setdefault(tuple((k, v) for k, v in s.items() if k not in (ROUNDS, "trial")), []).append(i)
    return found


def search(specs: list[dict], rows: DataFrame, fit_longest, parallelism: int = 4, pool: ThreadPoolExecutor | None = None) -> list[dict]:
    """Metrics of every spec, one fit per family by ``fit_longest(spec,
    early_stop)``, ``parallelism`` at once or as many as a pool that searches
    share has threads.  A family whose fit fails gives its error to each of its
    trials (failure isolation); without validation rows there is no early
    stop, and the trials have no scores."""
    val = rows.where((F.col("split") == "val") & F.col("y_raw").isNotNull())
    judged = not val.isEmpty()

    def run(members: list[int]) -> dict[int, dict]:
        longest = max(members, key=lambda i: specs[i][ROUNDS])
        try:
            seen = curve(fit_longest(specs[longest], judged), val)
            out = {}
            for i in members:
                kept = min(int(specs[i][ROUNDS]), len(seen.nodes))
                out[i] = (seen.rows[kept - 1] if seen.rows else {}) | {"rounds": kept, "nodes": seen.nodes[kept - 1], "status": "success", "error": ""}
            return out
        except Exception as e:  # noqa: BLE001 - failure isolation per family of trials
            return {i: {"status": "failed", "error": repr(e)} for i in members}

    with nullcontext(pool) if pool else ThreadPoolExecutor(max_workers=max(1, parallelism)) as workers:
        found = {i: r for part in workers.map(run, families(specs).values()) for i, r in part.items()}
    return [specs[i] | found[i] for i in range(len(specs))]
