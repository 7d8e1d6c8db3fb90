"""Embedding near-dedup: collision-counting projections.

A vector is projected onto many random unit directions.  Directions come in
``TABLES`` tables of ``ROTATIONS`` random rotations; a table's direction for a
vector is the sum of the signed axes that its largest coordinates name (one
per rotation), so of all directions a vector enters only the lists of those
along which it lies far out: ``TABLES`` sorted lists, each of a few vectors in
(2 x dim) ** ROTATIONS.  In a list, sorted by the one-dimensional projection,
the window centred at a vector holds its collisions.  A pair's collisions are
counted over all tables, and pairs that reach the calibrated count are
verified by their cosine in double precision.

Window and count are calibrated without data: pairs at exactly the limit
cosine are simulated (a random rotation makes all such pairs alike), the
window covers ``WINDOW_PART`` of their differences, and the count is the
largest that ``RECALL`` of them reach.

No pair is emitted.  A vector carries its cells and projections of all tables,
so a task counts a pair's collisions by itself and takes the pair only in the
first table in which it collides; it gives link counts per vector and a
spanning forest of the links it found.  Equal vectors are one vector with a
weight.  A list with more than ``LIST_ROWS`` vectors is dealt out: its vectors
are split into parts by hash, and every two parts meet in a task of their own
(all links of a dense group have to be counted, so the work is that of its
links, but no task sees more than two parts).

Defined cases: a vector that is null, empty, zero, or holds null or non-finite
components links with nothing, as do vectors of different lengths; repeated
rows are rows of their own and link with each other; a null id is counted as a
link but names no component unless all its ids are null; an empty table gives
no row; other columns are handed on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import land, plain_columns, replaced
from hourloom.llm.simhash import components

COSINE = 0.9
TABLES = 32
ROTATIONS = 2
RECALL = 0.99
WINDOW_PART = 0.999
SEED = 20
#: Tables searched in one round: the disks hold one round's lists at a time.
ROUND_TABLES = 4
#: Cells are kept modulo this prime, in two bytes (an accidental collision is verified away), projections in one byte.
_CELLS, _STEPS = 65_521, 127
#: Vectors of a list that one task pairs; a longer list is split into parts.
LIST_ROWS = 2048
#: Rows that a task works on at once.
BATCH_ROWS = 16_384
_SIMULATED = 8_000


@functools.lru_cache(maxsize=8)
def rotations(dim: int, tables: int = TABLES, per_table: int = ROTATIONS) -> np.ndarray:
    """Random orthogonal matrices, (tables, per_table, dim, dim), the same everywhere."""
    r = np.random.default_rng([SEED, dim])
    q, tri = np.linalg.qr(r.standard_normal((tables, per_table, dim, dim)))
    return q * np.sign(np.diagonal(tri, axis1=-2, axis2=-1))[..., None, :]


def project(unit: np.ndarray, tables: int = TABLES, per_table: int = ROTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Cell (which direction) and projection (0 to 127) of each unit vector in each table."""
    n, dim = unit.shape
    turned = rotations(dim, tables, per_table)
    cells, values = np.zeros((n, tables), np.int64), np.zeros((n, tables))
    for t in range(tables):
        for k in range(per_table):
            y = unit @ turned[t, k]
            axis = np.abs(y).argmax(axis=1)
            at = y[np.arange(n), axis]
            cells[:, t] = cells[:, t] * (2 * dim) + 2 * axis + (at < 0)
            values[:, t] += np.abs(at)
    return (cells % _CELLS).astype(np.uint16).view(np.int16), np.rint(values * (_STEPS / per_table)).clip(0, _STEPS).astype(np.int8)


@functools.lru_cache(maxsize=8)
def calibrated(dim: int, cosine: float = COSINE, recall: float = RECALL, tables: int = TABLES, per_table: int = ROTATIONS) -> tuple[int, int]:
    """Half-width of the window and collision count for pairs at the cosine."""
    r = np.random.default_rng([SEED, dim, 1])
    x, z = (r.standard_normal((_SIMULATED, dim)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (x * z).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    (a, pa_), (b, pb) = project(x, tables, per_table), project(cosine * x + np.sqrt(1 - cosine * cosine) * z, tables, per_table)
    same, apart = a == b, np.abs(pa_.astype(int) - pb)
    window = int(np.quantile(apart[same], WINDOW_PART, method="higher")) if same.any() else 0
    count = np.sort((same & (apart <= window)).sum(axis=1))
    return window, max(1, int(count[int((1 - recall) * len(count))]))


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe for any magnitude."""
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``cells`` and ``vals``, the vector's place in all tables."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = b.take(pa.array(np.flatnonzero(dims == dim)))
            cells, values = project(unit_vectors(_matrix(part.column("vector"), int(dim))))
            at = pa.array(np.arange(0, cells.size + 1, TABLES, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (cells, values)]
            yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=[*part.schema.names, "cells", "vals"])


class _Forest:
    """Which rows are joined already; gives the links that joined new ones."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fresh = np.flatnonzero(self.root[a] != self.root[b])
        root, used = self.root, []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x
        for i in fresh:
            x, y = find(a[i]), find(b[i])
            if x != y:
                root[max(x, y)] = min(x, y)
                used.append(i)
        if used:
            while not (root == root[root]).all():
                self.root = root = root[root]
        return np.array(used, np.int64)


def _pairs(group: np.ndarray, side: np.ndarray, table: np.ndarray, cells: np.ndarray, values: np.ndarray, vectors: np.ndarray, node: np.ndarray,
           weight: np.ndarray, window: int, least: int, cosine: float) -> list[np.ndarray]:
    """Rows sorted by (group, value): collisions of every row with the rows
    behind it in its window -> (node, other node or itself, links)."""
    n = len(group)
    values = values.astype(np.int16)
    value = values[np.arange(n), table]
    links, forest, edges = np.zeros(n, np.int64), _Forest(n), []
    i, d = np.arange(n), 1
    while len(i):
        i = i[i + d < n]
        j = i + d
        i = i[(group[i] == group[j]) & (value[j] - value[i] <= window)]
        for s in range(0, len(i), 1 << 15):
            a = i[s:s + (1 << 15)]
            a = a[side[a] * side[a + d] <= 0]  # of two parts: a row of each
            hit = (cells[a] == cells[a + d]) & (np.abs(values[a] - values[a + d]) <= window)
            a = a[(hit.sum(axis=1) >= least) & (hit.argmax(axis=1) == table[a])]
            a = a[np.einsum("ij,ij->i", vectors[a], vectors[a + d]) >= cosine]
            np.add.at(links, a, weight[a + d])
            np.add.at(links, a + d, weight[a])
            new = a[forest.join(a, a + d)]
            edges.append(np.stack([new, new + d], axis=1))
        d += 1
    at = np.flatnonzero(links)
    e = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
    return [np.concatenate([node[at], node[e[:, 0]]]), np.concatenate([node[at], node[e[:, 1]]]), np.concatenate([links[at], np.zeros(len(e), np.int64)])]


def _search(lists: DataFrame, cosine: float) -> DataFrame:
    """Links of the lists: (a, b = a, links of a) and forest edges (a, b, 0)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            dims = rows.column("dim").to_numpy()
            for dim in np.unique(dims):
                p = rows.filter(pa.array(dims == dim)).combine_chunks()
                keys = np.stack([p.column(k).to_numpy() for k in _KEY], axis=1)
                group = np.cumsum(np.concatenate(([0], (keys[1:] != keys[:-1]).any(axis=1))))
                window, least = calibrated(int(dim), cosine)
                arrays = [p.column(c).combine_chunks() for c in ("cells", "vals", "vector")]
                found = _pairs(group, p.column("side").to_numpy(), p.column("t").to_numpy(), _matrix(arrays[0], TABLES), _matrix(arrays[1], TABLES),
                               unit_vectors(_matrix(arrays[2], int(dim))), p.column("node").to_numpy(), p.column("weight").to_numpy(), window, least, cosine)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < BATCH_ROWS:
                continue
            t = pa.Table.from_batches(held)
            keys = np.stack([t.column(k).to_numpy() for k in _KEY], axis=1)
            other = np.flatnonzero((keys != keys[-1]).any(axis=1))
            if len(other):  # whole lists so far; the last one may go on
                cut = int(other[-1]) + 1
                yield from solve(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    return lists.mapInArrow(go, "a long, b long, n long")


_KEY = ["t", "dim", "cell", "one", "two"]


def _long_lists(sketches: DataFrame) -> DataFrame:
    """The lists that are dealt out, and into how many parts."""
    sizes = sketches.select("dim", F.posexplode("cells").alias("t", "cell")).groupBy("t", "dim", "cell").agg(F.count(F.lit(1)).alias("m"))
    return sizes.where(F.col("m") > LIST_ROWS).select("t", "dim", "cell", F.ceil(F.col("m") / LIST_ROWS).cast("int").alias("parts"))


def _lists(sketches: DataFrame, long: DataFrame, tables: range) -> DataFrame:
    """The sorted lists of some tables, each vector with what counts its pairs."""
    t = F.explode(F.array(*[F.lit(x) for x in tables])).alias("t")
    lists = sketches.select(t, "*").withColumn("cell", F.get("cells", F.col("t"))).join(long, ["t", "dim", "cell"], "left")
    parts = F.coalesce("parts", F.lit(1))
    lists = lists.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    lists = lists.withColumns({"one": F.least("part", "other"), "two": F.greatest("part", "other"), "value": F.get("vals", F.col("t"))})
    # of two parts each row stands on its own side; a part by itself has no sides
    side = F.when(F.col("one") == F.col("two"), 0).when(F.col("part") == F.col("one"), 1).otherwise(-1)
    lists = lists.select(*_KEY, side.alias("side"), "node", "weight", "cells", "vals", "vector", "value")
    return lists.repartition(*_KEY).sortWithinPartitions(*_KEY, "value", "node").drop("value")


@plain_columns
def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """The operator: input rows without the vector plus ``n_links``,
    ``component_id`` (smallest id reachable over links) and ``kept``."""
    keep = [c for c in replaced(rows, ["n_links", "component_id", "kept"]) if c != vector_col]
    v, i = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    fit = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = land(rows.select(*[F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(keep)], i.alias("_c_id"), F.when(F.coalesce(fit, F.lit(False)), v).alias("vector"),
                            F.monotonically_increasing_id().alias("_c_row")), "vectors")
    classes = rows.where(F.col("vector").isNotNull()).groupBy("vector").agg(F.count(F.lit(1)).alias("weight"), F.min("_c_id").alias("low"), F.min("_c_row").alias("node"))
    classes = land(classes, "vector-classes")
    vector = classes.schema["vector"].dataType.simpleString()
    sketches = classes.select("node", "weight", F.size("vector").alias("dim"), "vector").mapInArrow(
        _sketch, f"node long, weight long, dim int, vector {vector}, cells array<smallint>, vals array<tinyint>")
    sketches = land(sketches, "vector-sketches")
    long = land(_long_lists(sketches), "vector-long-lists")
    found = None
    for at in range(0, TABLES, ROUND_TABLES):
        links = land(_search(_lists(sketches, long, range(at, min(at + ROUND_TABLES, TABLES))), cosine), "vector-links")
        found = links if found is None else found.unionByName(links)
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("n = 0").select("a", "b"), "vector-components")
    classes = land(classes.join(counts, "node", "left").join(roots, "node", "left")
                   .select("vector", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "vector-roots")
    names = land(classes.groupBy("root").agg(F.min("low").alias("component_id")), "vector-names")
    classes = land(classes.join(names, "root").select("vector", "n_links", "component_id"), "vector-verdicts")
    out = rows.where(F.col("vector").isNotNull()).join(classes, "vector").unionByName(
        rows.where(F.col("vector").isNull()).withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("_c_id")}), allowMissingColumns=True)
    return out.select(*[F.col(f"_k{k}").alias(c) for k, c in enumerate(keep)], "n_links", "component_id", F.col("_c_id").eqNullSafe(F.col("component_id")).alias("kept"))
