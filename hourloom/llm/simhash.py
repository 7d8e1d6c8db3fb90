"""SimHash near-dedup: byte-position inverted index with count filtering.

The 64-bit SimHash of a text's 4-word shingles (repeats included) is cut into
eight bytes.  Two fingerprints at 4 or fewer differing bits differ in at most
four bytes, so they share at least four (byte, position) postings: the
guaranteed minimum.  Lists of single bytes would each hold 1/256 of the table,
and tallying pairs in them would emit nearly all pairs; so the index is kept
by *four positions at once* (70 lists per fingerprint).  Two fingerprints meet
in such a list exactly when their tally of shared positional bytes reaches
four, which is the count filter; what meets is verified by its bit distance.

Only distinct fingerprints are indexed (copies collapse first), and a list
emits a spanning forest of its links, found by breadth-first search with
vectorised bit counts, never its pairs: at most one link fewer than members,
in memory for the list's 8-byte members.  Components are then joined up by
large-star / small-star rounds over written tables.

Defined cases: A-Z are lowered, words are ``[^\\x20\\x09-\\x0D]+``; fewer than four
words are one shingle; no word (or null): fingerprint zero, linked like any
other.  A null id never names a component unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import land, plain_columns, replaced, sized, texts

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42


def simhash(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one UTF-8 text."""
    words = text.lower().split()  # of bytes: only A-Z are lowered, only ASCII blanks split
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    n = min(shingle_words, len(words))
    digest, votes, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - n + 1
    s, e = starts[:total].tolist(), ends[n - 1:].tolist()
    for at in range(0, total, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(s[at:at + (1 << 16)], e[at:at + (1 << 16)], strict=True)], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big")


def with_simhash(docs: DataFrame, text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Adds ``_c_fp`` (the fingerprint's bits as a long); drops the text."""
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_c_text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "_c_text"):
            fps = np.array([simhash(x, shingle_words) for x in texts(b, "_c_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fps)], names=[*keep, "_c_fp"])

    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema.add("_c_fp", "long")
    return rows.mapInArrow(go, schema)


def _forest(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the members (distinct) at the bit distance."""
    left, out = np.sort(members), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            differ = x ^ left
            shared = np.zeros(len(left), np.int8)
            for i in range(8):
                shared += (differ >> np.uint64(8 * i)) & np.uint64(255) == 0
            near = (shared >= 8 - max_bits) & (np.bitwise_count(differ) <= max_bits)
            hit = left[near]
            out += [(int(x), int(y)) for y in hit]
            queue += list(hit)
            left = left[~near]
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` at ``max_bits`` or fewer
    differing bits: a spanning forest of every index list."""
    masks = []
    for c in combinations(range(8), 8 - max_bits):
        m = sum(255 << (8 * i) for i in c)
        masks.append(m - 2**64 if m >= 2**63 else m)
    lists = fps.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("c", "m"))
    lists = lists.select(F.col("c").cast("byte").alias("c"), F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp")
    lists = lists.repartition("c", "k").sortWithinPartitions("c", "k", "fp")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def search(c: np.ndarray, k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1])
            at = np.append(np.flatnonzero(new), len(c))
            size = np.diff(at)
            fp = fp.view(np.uint64)
            two = at[:-1][size == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits
            pairs = [np.stack([fp[two][near], fp[two + 1][near]], axis=1)]
            for s, n in zip(at[:-1][size > 2], size[size > 2], strict=True):
                if f := _forest(fp[s:s + n], max_bits):
                    pairs.append(np.array(f, np.uint64))
            both = np.unique(np.concatenate(pairs), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        for b in batches:
            held = [np.concatenate([h, x.to_numpy(zero_copy_only=False)]) for h, x in zip(held, b.columns, strict=True)]
            c, k = held[0], held[1]
            if len(c):
                cut = int(np.flatnonzero((c != c[-1]) | (k != k[-1]))[-1] + 1) if (c[0] != c[-1] or k[0] != k[-1]) else 0
                if cut:
                    yield search(*[h[:cut] for h in held])
                    held = [h[cut:] for h in held]
        if len(held[0]):
            yield search(*held)

    return lists.mapInArrow(go, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected links (a, b): (node, root), root the
    smallest node; nodes without links are absent.  Alternating large-star and
    small-star rounds until nothing changes, one written table a round; minima
    are pre-aggregated, so a star with any number of arms is no hot group."""
    e = land(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = land(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = land(small.distinct(), name)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now


@plain_columns
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """The operator: input rows without the text plus ``fingerprint`` (16 hex
    digits), ``component_id`` (smallest id reachable over links) and
    ``component_fingerprint`` (the component's smallest fingerprint: its name
    where all ids are null)."""
    keep = [c for c in replaced(docs, ["fingerprint", "component_id", "component_fingerprint"]) if c != text_col]
    hashed = land(with_simhash(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])], ), text_col, shingle_words), "simhash")
    nodes = hashed.groupBy(F.col("_c_fp").alias("fp")).agg(F.min(id_col).alias("low"))
    found = components(land(links(nodes.select("fp"), max_bits).distinct(), "simhash-links"), "simhash-components")
    roots = land(nodes.join(found, nodes.fp == found.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    names = land(roots.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-components")  # plain tables: a hot root can be split
    ids = land(roots.join(names, "root").select(F.col("fp").alias("_c_fp"), "component_id", _hex("root").alias("component_fingerprint")), "simhash-names")
    return hashed.join(ids, "_c_fp").select(*[F.col(f"`{c}`") for c in keep], _hex("_c_fp").alias("fingerprint"), "component_id", "component_fingerprint")


def _hex(col: str) -> Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))


@plain_columns
def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that with the
    smallest id (of rows alike in id, the one with the smallest text hash)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumn("_c_hash", F.xxhash64(text))
    near = near_duplicates(marked.select(F.col(id_col), "_c_hash", F.col(text_col)).withColumnRenamed("_c_hash", "text_hash"), id_col, text_col)
    first = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("text_hash").alias("h"))
    kept = near.groupBy("component_fingerprint").agg(F.min(first).alias("k")).select(F.col("k.i").alias("_c_i"), F.col("k.h").alias("_c_h"))
    rows = marked.join(kept, F.col(id_col).eqNullSafe(F.col("_c_i")) & (F.col("_c_hash") == F.col("_c_h")), "left_semi")
    return rows.dropDuplicates([id_col, "_c_hash"]).drop("_c_hash")
