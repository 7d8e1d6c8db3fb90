"""Sharding: two-pass external shuffle of whole records into shards of equal
row counts.

Pass one scatters the records, texts and all, uniformly into memory-sized
buckets by a seeded hash: ``BUCKET_ROWS`` rows and ``BUCKET_BYTES`` bytes on
average, whichever gives more buckets.  The buckets are written, each row with
its place by content hash.  Pass two shuffles each bucket (``shuffle``:
Fisher-Yates with a seed, over the bucket's places, so that no row has to hold
a bucket's texts) and gives the records their new places.  The buckets laid
end to end are one random permutation of the table; its positions are dealt to
the shards in turn, so row counts differ by one at most (law ``rows``).

The hash mixes the record's content and its place in its input split, so a
third of all rows being the same row does not fill one bucket.  Same input
files, settings and seed: same result.

Defined cases: a null text has size 1 and checksum 0 in the query; null ids and
repeated rows are rows like any other; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import land, replaced, shuffle_partitions

#: Rows and bytes that a bucket holds at most on average; one task sorts it in memory.
BUCKET_ROWS = 20_000
BUCKET_BYTES = 16_000_000


def record_bytes(docs: DataFrame, cols: list[str]) -> Column:
    """About the bytes of a record: texts by their length, other values 8 or as written."""
    size = F.lit(8 * len(cols)).cast("long")
    for c in cols:
        kind, col = docs.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            col = col.cast("string")
        elif not isinstance(kind, (T.StringType, T.BinaryType)):
            continue
        size = size + F.coalesce(F.octet_length(col), F.lit(0))
    return size


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 17, bucket_rows: int = BUCKET_ROWS,
                        row_hash: Column | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The operator: input rows plus ``shard`` (0..shards-1), ``slot`` (gapless
    from 0 in a shard) and ``bucket``.  ``row_hash`` may name columns to hash;
    by default all."""
    keep = replaced(docs, ["shard", "slot", "bucket"])
    spark = docs.sparkSession
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(record_bytes(docs, keep)), F.lit(0)).alias("b")).first()
    buckets = max(1, -(-total["n"] // bucket_rows), -(-total["b"] // bucket_bytes), 4 * shuffle_partitions(spark))
    cols = [F.col(f"`{c}`") for c in keep]
    own = F.xxhash64(*cols) if row_hash is None else row_hash
    bucket = F.pmod(F.xxhash64(F.lit(seed), own, F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    scattered = docs.select(*cols, bucket.alias("bucket"), F.xxhash64(F.lit(seed), *cols).alias("_c_h"), F.xxhash64(F.lit(seed + 1), *cols).alias("_c_h2"))
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("_c_h", "_c_h2"))
    scattered = land(scattered.withColumn("_c_at", at).drop("_c_h", "_c_h2"), "scattered-buckets")
    sizes = scattered.groupBy("bucket").agg(F.count(F.lit(1)).cast("int").alias("_c_n")).sortWithinPartitions("bucket")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    mixed = land(sizes.select("bucket", "_c_n", F.shuffle(F.sequence(F.lit(0), F.col("_c_n") - 1), seed).alias("_c_to")), "shuffled-buckets")
    starts = mixed.select("bucket", F.coalesce(F.sum("_c_n").over(before), F.lit(0)).alias("_c_start"))  # one row per bucket
    placed = scattered.join(mixed.join(starts, "bucket").select("bucket", "_c_start", "_c_to"), "bucket")
    place = F.col("_c_start") + F.get("_c_to", F.col("_c_at") - 1)
    return placed.select(*cols, F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
                         F.floor(place / shards).cast("long").alias("slot"), "bucket")


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 17) -> None:
    """Writes the shuffled rows, one folder per shard, in slot order within files."""
    out = shuffle_into_shards(docs, shards, seed)
    out.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
