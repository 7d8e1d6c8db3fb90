"""Document fingerprints: one-permutation MinHash, optimally densified, b-bit packed.

The distinct five-word shingles of a text are hashed once.  The top bits of a
hash choose one of ``BINS`` bins, the other bits compete for the bin's minimum.
An empty bin borrows from the first non-empty bin of its own fixed random order
of all bins (optimal densification: every bin probes independently), so two
sets borrow alike.  Only the low ``BITS`` bits of each minimum are kept and
written as hexadecimal text; the likeness of two fingerprints subtracts the
share of bins that agree by chance, 2**-BITS.

Everything is a built-in column function: one row in, one row out, no shuffle.
A shared sort of the shingle hashes with one sentinel per bin replaces any
per-bin search: in sorted order the first value of each bin is its minimum,
or its sentinel if the bin is empty.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` unchanged; fewer than five words
are one shingle; no word at all (or null) gives a fingerprint of zeros, which
is alike (1.0) to another such and 0.0 to the rest.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.common import block_of, id_steps, plain_columns, replaced, shuffle_partitions

SHINGLE_WORDS = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
#: Probes written out per empty bin; after them the rest of the order is ranked.
PROBES = 8
_VALUE_BITS = 63 - BIN_BITS
_SENTINEL = (1 << _VALUE_BITS) - 1


def words(text: Column) -> Column:
    """Words of a text: runs of characters other than space and \\t..\\r."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _shingle_hashes(wh: Column) -> Column:
    """63-bit hashes of the shingles, from the words' hashes."""
    n = F.size(wh)
    positive = F.lit(2**63 - 1)
    many = F.transform(F.slice(wh, F.lit(1), F.greatest(n - (SHINGLE_WORDS - 1), F.lit(0))),
                       lambda x, i: F.xxhash64(x, *[F.get(wh, i + j) for j in range(1, SHINGLE_WORDS)]).bitwiseAND(positive))
    few = F.array(F.xxhash64(wh).bitwiseAND(positive))
    return F.when(n >= SHINGLE_WORDS, many).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the packed fingerprint of column ``text`` (hex string)."""
    t = "_c_fp"
    sentinels = F.array(*[F.lit((b << _VALUE_BITS) + _SENTINEL).cast("long") for b in range(BINS)])  # folded to one literal
    bin_of = lambda x: F.shiftright(x, _VALUE_BITS)
    filled = lambda x: x.bitwiseAND(F.lit(_SENTINEL)) != _SENTINEL
    df = df.withColumn(t, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    df = df.withColumn(t, F.sort_array(F.concat(_shingle_hashes(F.col(t)), sentinels)))
    s = F.col(t)
    df = df.withColumn(t, F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))
    df = df.withColumn("_c_full", F.filter(s, filled))

    def probe(i: Column, j: int) -> Column:
        x = F.get(s, F.pmod(F.xxhash64(i, F.lit(j)), F.lit(BINS)).cast("int"))
        return F.when(filled(x), x)

    rest = lambda i: F.array_min(F.transform(F.col("_c_full"), lambda x: F.struct(
        F.xxhash64(i, F.lit(-1), bin_of(x)).alias("r"), x.alias("x"))))["x"]
    digits = F.array(*[F.lit(format(i, f"0{BITS // 4}x")) for i in range(1 << BITS)])
    value = lambda x, i: F.when(filled(x), x).otherwise(F.coalesce(*[probe(i, j) for j in range(PROBES)], rest(i)))
    dense = F.transform(s, lambda x, i: F.get(digits, value(x, i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))
    zeros = F.lit("0" * (BINS * BITS // 4))
    return df.withColumn(out, F.when(F.size("_c_full") > 0, F.array_join(dense, "")).otherwise(zeros)).drop(t, "_c_full")


def with_likeness(df: DataFrame, out: str, a: str, b: str, a_empty: Column, b_empty: Column) -> DataFrame:
    """Adds ``out``: the estimated Jaccard likeness (0 to 1) of the packed
    fingerprints in columns ``a`` and ``b``: share of agreeing bins, less chance.
    The flags tell texts without a word apart."""
    df = df.withColumns({"_c_x": F.unhex(a), "_c_y": F.unhex(b)})
    step = BITS // 8
    at = F.sequence(F.lit(1), F.least(F.octet_length("_c_x"), F.octet_length("_c_y")), F.lit(step))
    same = F.aggregate(at, F.lit(0), lambda n, i: n + (
        F.substr(F.col("_c_x"), i, F.lit(step)) == F.substr(F.col("_c_y"), i, F.lit(step))).cast("int"))
    chance = 2.0 ** -BITS
    est = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))
    return df.withColumn(out, F.when(a_empty & b_empty, 1.0).when(a_empty | b_empty, 0.0).otherwise(est)).drop("_c_x", "_c_y")


@plain_columns
def fingerprint_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The operator: documents plus ``fingerprint``; map-only."""
    return with_fingerprint(docs, text_col, "fingerprint").select(*replaced(docs, ["fingerprint"]), "fingerprint")


def with_next(df: DataFrame, id_col: str, order: list[str], carry: list[str], tie: Column | None = None) -> DataFrame:
    """Adds ``_c_next_<c>`` for each carried column: its value in the row that
    follows in descending order of ``id_col`` (then ``tie``, a hash as a long,
    then ``order``); the last row is followed by the first.

    Rows are dealt to blocks of neighbouring ids, and the head of each block is
    also sent to the block before it in this order, so every block is a window
    of its own and no task sees the whole table.  The head table has one row
    per block.  An id that fills several blocks' worth of rows (the null id, say)
    is split by ranges of ``tie``; rows alike in id and tie stay together.
    """
    tie = F.lit(0).cast("long") if tie is None else tie
    df = df.withColumns({"_c_id": F.coalesce(F.col(id_col), F.lit(-(2**63))), "_c_tie": tie})
    ids = df.select("_c_id", "_c_tie")
    steps = id_steps(ids, "_c_id", 2 * shuffle_partitions(df.sparkSession))
    bounds = sorted(set(steps))
    parts = {b: n for b, n in Counter(steps).items() if n > 1}  # ids that fill several steps, at most half as many as steps
    base, width = block_of("_c_id", bounds), max(parts.values(), default=0) + 1
    n = F.coalesce(F.get(F.array(*[F.lit(parts.get(b, 0)) for b in bounds], F.lit(0)), base), F.lit(0))
    hot = (n > 0) & (F.col("_c_id") == F.get(F.array(*[F.lit(b).cast("long") for b in bounds], F.lit(None).cast("long")), base))
    part = F.least(F.floor((F.col("_c_tie") / F.lit(2.0**64) + 0.5) * n).cast("int"), n - 1)  # 0 holds the smallest ties
    block = (base * width + F.when(hot, n - part).otherwise(0)).cast("int")  # the order goes from the highest block to the lowest
    heads = ids.withColumn("_c_block", block).groupBy("_c_block").agg(F.max(F.struct("_c_id", F.bitwise_not("_c_tie").alias("t"))).alias("f"))
    up = Window.orderBy("_c_block")  # one row per block
    goes = F.coalesce(F.lead("_c_block").over(up), F.first("_c_block").over(up))
    heads = heads.select(F.col("f._c_id").alias("_c_id"), F.bitwise_not("f.t").alias("_c_tie"), goes.alias("_c_goes"))
    df = df.withColumn("_c_block", block).join(F.broadcast(heads), ["_c_id", "_c_tie"], "left")  # one row per block
    places = F.filter(F.array(F.struct(F.col("_c_block").alias("b"), F.lit(0).alias("h")),
                              F.struct(F.col("_c_goes").alias("b"), F.lit(1).alias("h"))), lambda p: p["b"].isNotNull())
    df = df.withColumn("_c_place", F.explode(places)).withColumns({"_c_b": F.col("_c_place.b"), "_c_h": F.col("_c_place.h")})
    w = Window.partitionBy("_c_b").orderBy(F.col("_c_h"), F.col("_c_id").desc(), "_c_tie", *order)
    df = df.withColumns({f"_c_next_{c}": F.lead(c).over(w) for c in carry})
    return df.where(F.col("_c_h") == 0).drop("_c_place", "_c_b", "_c_h", "_c_goes", "_c_block", "_c_id", "_c_tie")
