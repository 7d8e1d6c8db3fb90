"""Mixing sources to target weights: hierarchical token budgets, seeded prefixes.

Leaves are (domain, language, source).  A leaf's capacity is its tokens times
the epochs allowed; an inner node's is the sum of its children's.  The total
budget is handed down the tree: at each node it is split by the children's
weights, and what a child cannot hold goes to its siblings, in proportion to
their weights, before any of it is felt by the level above (a node asks its
parent for no more than its capacity).  The split is exact water filling: in
order of capacity / weight, the children below the water level are full and
the others get ``level * weight``.

Each leaf then takes whole seeded epochs and, of the last epoch, the documents
with the smallest seeded hashes whose running token sum stays within the
budget (a token prefix of a seeded order).  A hot leaf is never sorted as one
group: token sums per (leaf, hash range) find the one range in which the
budget ends, finer sums the range within it, and only the rows of the last,
one in 2**24 of the leaf, are put in order.

Defined cases: a null level value is the level ``(null)``; a null or empty text
has 0 tokens and is taken with whatever surrounds it; rows alike in id and
text share one place in the order and are taken or left together; a weight
that is missing is 1, a weight of 0 gives nothing; an empty table gives no row.
All of it is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.common import land, replaced

LEVELS = ("domain", "lang", "source")
#: A leaf's rows are summed in 256 hash ranges, then 256 ranges of the one in which its budget ends, and again.
RANGE_BITS = 8
SHIFTS = (56, 48, 40)


def text_tokens(text: Column) -> Column:
    """Token estimate: a quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(4)).cast("long")


def water_fill(nodes: DataFrame, parent: list[str], given: str, weight: str, cap: str, out: str) -> DataFrame:
    """Splits ``given`` (same value for all children of a parent) over the
    children by weight, at most ``cap`` each.  One row per node of one level."""
    ratio = F.when(F.col(weight) > 0, F.try_divide(F.col(cap).cast("double"), F.col(weight))).otherwise(F.lit(float("inf")))
    rows = nodes.withColumn("_c_cap", F.when(F.col(weight) > 0, F.col(cap).cast("double")).otherwise(0.0)).withColumn("_c_ratio", ratio)
    keys = [F.col(c) for c in parent] or [F.lit(0)]
    up = Window.partitionBy(*keys).orderBy("_c_ratio", *[c for c in nodes.columns if c in LEVELS])
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    above = up.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col(given) - F.coalesce(F.sum("_c_cap").over(below), F.lit(0.0)))
    level = F.try_divide(level, F.sum(weight).over(above))
    rows = rows.withColumn("_c_level", level)
    full = F.col("_c_ratio") <= F.col("_c_level")
    # from the first child that is not full on, levels only fall: the highest of them is the water level
    rows = rows.withColumn("_c_water", F.max(F.when(~full, F.col("_c_level"))).over(Window.partitionBy(*keys)))
    got = F.when(F.col(weight) <= 0, 0.0).otherwise(F.least(F.col("_c_cap"), F.coalesce(F.col("_c_water") * F.col(weight), F.col("_c_cap"))))
    return rows.withColumn(out, got).drop("_c_cap", "_c_ratio", "_c_level", "_c_water")


def _weight(level: str, weights: Mapping[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*pairs), lambda k, _: k == F.col(level))), 0), F.lit(1.0))


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, float]], budget: Column, epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget`` tokens each."""
    for level in LEVELS:
        leaves = leaves.withColumn(f"_c_w_{level}", _weight(level, weights.get(level, {})))
    leaves = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("double"))
    # a node whose weight is 0 anywhere above gets nothing: its capacity does not count
    live = [F.when(F.col(f"_c_w_{lv}") > 0, F.col("cap")).otherwise(0.0) for lv in LEVELS]
    leaves = leaves.withColumn("cap", F.least(*live)).withColumn("_c_given", F.least(F.sum("cap").over(Window.partitionBy(F.lit(0))), budget.cast("double")))
    for depth, level in enumerate(LEVELS):
        above, here = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*here).agg(F.first(f"_c_w_{level}").alias("w"), F.sum("cap").alias("c"), F.first("_c_given").alias("g"))
        got = water_fill(nodes, above, "g", "w", "c", "_c_got").select(*here, "_c_got")
        leaves = leaves.join(got, here).withColumn("_c_given", F.col("_c_got")).drop("_c_got")
    return leaves.select(*LEVELS, "tokens", F.floor(F.col("_c_given") + 1e-6).cast("long").alias("budget"))


def mix_sources(docs: DataFrame, weights: Mapping[str, Mapping[str, float]], share: float = 0.6, epochs: int = 2, seed: int = 29,
                domain: Column | None = None, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator: the selected rows with all their columns plus ``domain``,
    ``n_tokens`` and ``epoch`` (0, 1, ..); a row taken in two epochs appears
    twice.  ``share``: total budget as a part of all tokens."""
    level = {"domain": F.lit("all") if domain is None else domain, "lang": F.col("lang"), "source": F.col("source")}
    names = {c: f"_c_{c}" for c in LEVELS}
    rows = docs.withColumns({names[c]: F.coalesce(v.cast("string"), F.lit("(null)")) for c, v in level.items()})
    rows = rows.withColumn("_c_tokens", text_tokens(F.col(text_col)) if tokens is None else tokens)
    rows = rows.withColumn("_c_place", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    keys = list(names.values())
    narrow = land(rows.select(*keys, "_c_place", "_c_tokens"), "mix-rows")
    leaves = narrow.groupBy(*keys).agg(F.sum("_c_tokens").alias("tokens")).select(*[F.col(names[c]).alias(c) for c in LEVELS], "tokens")
    leaves = land(leaves, "mix-leaves")
    total = leaves.agg(F.sum("tokens").alias("s")).first()["s"] or 0
    budgets = leaf_budgets(leaves, weights, F.lit(float(total) * share), epochs)
    some = F.col("tokens") > 0
    ends = land(budgets.select(*[F.col(c).alias(names[c]) for c in LEVELS],
                               F.when(some, F.floor(F.try_divide("budget", "tokens"))).otherwise(F.lit(0)).cast("int").alias("_c_full"),
                               F.when(some, F.try_mod("budget", "tokens")).otherwise(F.lit(0)).alias("_c_part")), "mix-budgets")
    # the hash range in which a leaf's last epoch ends, in ever finer ranges; one small sum per (leaf, range)
    ends = ends.withColumns({"_c_base": F.lit(0).cast("long"), "_c_last": F.lit(0).cast("long")})
    for shift in SHIFTS:
        near = narrow.join(ends.where(F.col("_c_part") > 0), keys).where(_range("_c_place", shift + RANGE_BITS) == F.col("_c_last"))
        sums = near.groupBy(*keys, "_c_part", "_c_base", _range("_c_place", shift).alias("r")).agg(F.sum("_c_tokens").alias("t"))
        up = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        b = F.col("_c_base") + F.coalesce(F.sum("t").over(up), F.lit(0))
        at = sums.withColumn("b", b).where((F.col("b") <= F.col("_c_part")) & (F.col("b") + F.col("t") > F.col("_c_part")))
        at = at.groupBy(*keys).agg(F.min(F.struct("r", "b")).alias("e")).select(*keys, F.col("e.r").alias("_c_last"), F.col("e.b").alias("_c_base"))
        ends = land(ends.select(*keys, "_c_full", "_c_part").join(at, keys, "left"), f"mix-ends-{shift}")
    # order the rows of that range only; the cut is the last place within the budget
    spot = _unsigned("_c_place")
    edge = narrow.join(ends, keys).where(_range("_c_place", SHIFTS[-1]) == F.col("_c_last"))
    edge = edge.groupBy(*keys, "_c_place").agg(F.sum("_c_tokens").alias("t"), F.first("_c_base").alias("_c_base"), F.first("_c_part").alias("_c_part"))
    run = F.col("_c_base") + F.sum("t").over(Window.partitionBy(*keys).orderBy(spot))
    cut = edge.withColumn("r", run).where(F.col("r") <= F.col("_c_part")).groupBy(*keys).agg(F.max(spot).alias("_c_cut"))
    ends = land(ends.join(cut, keys, "left"), "mix-cuts")
    # one map-only pass: how often is the row taken?
    here = _range("_c_place", SHIFTS[-1])
    inside = (here < F.col("_c_last")) | ((here == F.col("_c_last")) & (spot <= F.col("_c_cut")))
    copies = F.col("_c_full") + F.coalesce(inside, F.lit(False)).cast("int")
    out = rows.join(ends, keys).withColumn("_c_copies", copies).where(F.col("_c_copies") > 0)
    return out.select(*[F.col(f"`{c}`") for c in replaced(docs, ["domain", "n_tokens", "epoch"])], F.col("_c_domain").alias("domain"),
                      F.col("_c_tokens").alias("n_tokens"), F.explode(F.sequence(F.lit(0), F.col("_c_copies") - 1)).alias("epoch"))


def _range(place: str, shift: int) -> Column:
    """The hash's leading bits; all in one range for a shift of 64."""
    return F.lit(0).cast("long") if shift >= 64 else F.shiftrightunsigned(place, shift)


def _unsigned(place: str) -> Column:
    """Unsigned order of a 64-bit hash, as a signed number."""
    return F.col(place).bitwiseXOR(F.lit(-(2**63)))
