"""Exact grouped quantiles with bounded state per group.

``percentile`` keeps every distinct value of a group in one aggregation
buffer, so one series holding a third of all rows would be one huge buffer in
one task.  Here one path serves every size:

1. ``count`` and a ``percentile_approx`` sketch (memory set by ``accuracy``,
   rank error at most n/accuracy) bracket every target rank with values
   ``[L, U]``;
2. rows are counted by (key, feature, value) when the value lies in a bracket
   and by (key, feature, which brackets it is below or above) when not, so
   ties and the values outside shrink to counts before the shuffle;
3. per (key, feature) the distinct values inside the brackets with their
   counts, and the nearest value on each side, give the order statistics,
   interpolated exactly as ``percentile`` does (``(hi-pos)*a + (pos-lo)*b``).

What one task gathers is the distinct values inside a bracket: about
``4n/accuracy`` of them for a column without ties, a handful for one with ties
(``filled_quartiles``, whose ranks depend on the group: about ``n/1000``).
A rank outside its bracket (impossible by the sketch's bound) raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10_000


def _at_rank(inside: Column, below: Column, n_inside: Column, before: Column, after: Column, rank: Column) -> Column:
    """Value of the given rank: inside the bracket, or its neighbour."""
    start = F.struct(below.alias("seen"), F.lit(None).cast("double").alias("v"))
    walk = F.aggregate(inside, start, lambda acc, x: F.struct(
        (acc["seen"] + x["c"]).alias("seen"),
        F.when(acc["v"].isNotNull(), acc["v"]).when(acc["seen"] + x["c"] > rank, x["v"]).alias("v")))
    return (F.when((rank >= below) & (rank < below + n_inside), walk["v"])
            .when(rank == below - 1, before).when(rank == below + n_inside, after)
            .otherwise(F.raise_error(F.lit("quantile rank outside its bracket")).cast("double")))


def _long(df: DataFrame, keys: list[str], exprs: list[Column]) -> DataFrame:
    """One row per row and expression: ``keys, fid, v``."""
    pairs = F.array(*[F.struct(F.lit(i).alias("fid"), e.cast("double").alias("v")) for i, e in enumerate(exprs)])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.fid", "_p.v")


def _order_statistics(long: DataFrame, bounds: DataFrame, keys: list[str], count: int) -> DataFrame:
    """``bounds`` (one row per keys and fid) with, per target j, the values
    ``a{j}`` and ``b{j}`` at its ranks ``lo{j}`` and ``hi{j}``; both lie within
    its bracket ``l{j}`` to ``u{j}`` or next to it."""
    t = range(count)
    rows = long.where(F.col("v").isNotNull()).join(bounds.select(*keys, "fid", *[f"{c}{j}" for j in t for c in "lu"]), [*keys, "fid"])
    lows, highs = [F.col("v") < F.col(f"l{j}") for j in t], [F.col("v") > F.col(f"u{j}") for j in t]
    within = [~lo & ~hi for lo, hi in zip(lows, highs, strict=True)]
    kept = within[0]
    for w in within[1:]:
        kept = kept | w
    sides = F.array(*[F.when(lo, -1).when(hi, 1).otherwise(0) for lo, hi in zip(lows, highs, strict=True)])
    counted = (rows.select(*keys, "fid", sides.alias("side"), F.when(kept, F.col("v")).alias("slot"), "v")
               .groupBy(*keys, "fid", "side", "slot")
               .agg(F.count("v").alias("c"), F.min("v").alias("least"), F.max("v").alias("most")))
    aggs = []
    for j in t:
        side = F.get("side", j)
        aggs += [F.coalesce(F.sum(F.when(side == -1, F.col("c"))), F.lit(0)).alias(f"below{j}"),
                 F.coalesce(F.sum(F.when(side == 0, F.col("c"))), F.lit(0)).alias(f"inside_n{j}"),
                 F.max(F.when(side == -1, F.col("most"))).alias(f"before{j}"),
                 F.min(F.when(side == 1, F.col("least"))).alias(f"after{j}"),
                 F.sort_array(F.collect_list(F.when(side == 0, F.struct(F.col("slot").alias("v"), "c")))).alias(f"inside{j}")]
    per = bounds.join(counted.groupBy(*keys, "fid").agg(*aggs), [*keys, "fid"])
    found = [_at_rank(F.col(f"inside{j}"), F.col(f"below{j}"), F.col(f"inside_n{j}"), F.col(f"before{j}"), F.col(f"after{j}"),
                      F.col(f"{end}{j}")).alias(f"{name}{j}") for j in t for end, name in (("lo", "a"), ("hi", "b"))]
    return per.select(*[F.col(c) for c in bounds.columns], *found)


def _between(a: Column, b: Column, lo: Column, hi: Column, pos: Column) -> Column:
    return F.when((hi == lo) | (a == b), a).otherwise((hi.cast("double") - pos) * a + (pos - lo.cast("double")) * b)


def _positions(n: Column, p: float) -> tuple[Column, Column, Column]:
    pos = (n - 1).cast("double") * F.lit(float(p))
    return pos, F.floor(pos).cast("long"), F.ceil(pos).cast("long")


def group_quantiles(df: DataFrame, keys: list[str], exprs: list[Column], probs: list[float],
                    accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """``keys`` + one ``ARRAY<DOUBLE>`` column ``_q{i}`` per expression with
    the exact quantiles at ``probs`` (NULLs skipped; all-NULL -> NULL)."""
    d = 2.0 / accuracy
    ends = [(max(0.0, p - d), min(1.0, p + d)) for p in probs]
    bprobs = sorted({b for pair in ends for b in pair})
    at = {b: i for i, b in enumerate(bprobs)}
    long = _long(df, keys, exprs).where(F.col("v").isNotNull())
    sketch = long.groupBy(*keys, "fid").agg(
        F.count("v").alias("n"),
        F.percentile_approx("v", F.array(*[F.lit(b) for b in bprobs]), accuracy).alias("ap"))
    targets = []
    for j, (p, (lo, hi)) in enumerate(zip(probs, ends, strict=True)):
        pos, below, above = _positions(F.col("n"), p)
        targets += [pos.alias(f"pos{j}"), below.alias(f"lo{j}"), above.alias(f"hi{j}"),
                    F.col("ap")[at[lo]].alias(f"l{j}"), F.col("ap")[at[hi]].alias(f"u{j}")]
    ranked = _order_statistics(long, sketch.select(*keys, "fid", *targets), keys, len(probs))
    q = F.array(*[_between(*[F.col(f"{c}{j}") for c in ("a", "b", "lo", "hi", "pos")]) for j in range(len(probs))])
    wide = ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("fid") == i, q)).alias(f"_q{i}") for i in range(len(exprs))])
    # groups with no non-null value at all still get a row (NULL quantiles)
    return df.select(*keys).distinct().join(wide, keys, "left")


# Sketch points of ``filled_quartiles``: both ends and a grid around the quartiles.
_FROM, _TO, _STEPS = 0.2, 0.8, 2000


def filled_quartiles(df: DataFrame, keys: list[str], exprs: list[Column], accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """``keys`` + per expression ``_m{i}``, its exact median (NULLs skipped; 0
    if all are NULL), and ``_lo{i}``, ``_hi{i}``, the exact quartiles of the
    expression after its NULLs were filled with that median.

    The filled column is the raw one with m copies of its median, which lie
    after the raw values of rank below ``n div 2``.  A rank of the filled
    column is therefore a copy of the median or a raw rank (the same one before
    the copies, m less behind them), and medians and quartiles come from one
    sketch and one count of the raw column.  The median of the filled column is
    the median."""
    points = [0.0, *[_FROM + i / _STEPS for i in range(round((_TO - _FROM) * _STEPS) + 1)], 1.0]
    last = len(points) - 1
    long = _long(df, keys, exprs)
    sketch = long.groupBy(*keys, "fid").agg(
        F.count("v").alias("n"), F.count(F.lit(1)).alias("total"),
        F.percentile_approx("v", F.array(*[F.lit(b) for b in points]), accuracy).alias("ap"))
    n, total, d = F.col("n"), F.col("total"), 2.0 / accuracy
    half, copies = F.floor(n / 2), total - n

    def raw(rank: Column) -> Column:
        """Raw rank of a rank of the filled column; null for a copy of the median."""
        return F.when(rank < half, rank).when(rank >= half + copies, rank - copies)

    def point(rank: Column, shift: float) -> Column:
        """Sketch value surely at or below (above, for a positive shift) a raw rank."""
        p = rank / F.greatest(n - 1, F.lit(1)) + F.lit(shift)
        steps = (p - _FROM) * _STEPS
        if shift < 0:
            at = F.when(p < _FROM, 0).otherwise(1 + F.floor(F.least(steps, F.lit(float(last - 2)))))
        else:
            at = F.when(p > _TO, last).otherwise(1 + F.ceil(F.greatest(steps, F.lit(0.0))))
        return F.get("ap", at.cast("int"))

    targets = []
    for j, (p, size) in enumerate(((0.5, n), (0.25, total), (0.75, total))):
        pos, below, above = _positions(size, p)
        ranks = (below, above) if j == 0 else tuple(F.coalesce(raw(r), F.least(half, n - 1)) for r in (below, above))
        targets += [pos.alias(f"pos{j}"), below.alias(f"at_lo{j}"), above.alias(f"at_hi{j}"), ranks[0].alias(f"lo{j}"), ranks[1].alias(f"hi{j}"),
                    (F.lit(False) if j == 0 else raw(below).isNull()).alias(f"copy_lo{j}"),
                    (F.lit(False) if j == 0 else raw(above).isNull()).alias(f"copy_hi{j}"),
                    point(F.least(*ranks), -d).alias(f"l{j}"), point(F.greatest(*ranks), d).alias(f"u{j}")]
    bounds = sketch.where("n > 0").select(*keys, "fid", *targets)
    ranked = _order_statistics(long, bounds, keys, 3)
    at = [[F.col(f"{c}{j}") for c in ("a", "b", "at_lo", "at_hi", "pos")] for j in range(3)]
    ranked = ranked.withColumn("_m", _between(*at[0]))
    q = [_between(F.when(F.col(f"copy_lo{j}"), F.col("_m")).otherwise(at[j][0]), F.when(F.col(f"copy_hi{j}"), F.col("_m")).otherwise(at[j][1]), *at[j][2:])
         for j in (1, 2)]
    ranked = ranked.select(*keys, "fid", F.col("_m").alias("m"), q[0].alias("lo"), q[1].alias("hi"))
    wide = ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("fid") == i, F.col(c))).alias(f"_{c}{i}") for i in range(len(exprs)) for c in ("m", "lo", "hi")])
    found = df.select(*keys).distinct().join(wide, keys, "left")
    return found.select(*keys, *[F.coalesce(f"_{c}{i}", F.lit(0.0)).alias(f"_{c}{i}") for i in range(len(exprs)) for c in ("m", "lo", "hi")])
