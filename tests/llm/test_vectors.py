"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest
from conftest import ROOT  # noqa: F401

from hourloom.llm import projections
from hourloom.llm import queries as q


def all_pairs(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector or None)."""
    def fit(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    at = [k for k, (_, v) in enumerate(rows) if fit(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n in {len(rows[k][1]) for k in at}:
        same = [k for k in at if len(rows[k][1]) == n]
        x = np.array([rows[k][1] for k in same], np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near), strict=True):
            links[same[a]] += 1
            root[find(same[a])] = find(same[b])
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = find(k)
            low[r] = min(low.get(r, i), i)
    return [(i, links[k], low.get(find(k)), i == low.get(find(k))) for k, (i, _) in enumerate(rows)]


def planted(seed=0, dim=64, n=1500, cluster=300):
    """Random vectors, chains and clusters around the limit, copies and odd rows."""
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [list(map(float, v)) for v in base.astype(np.float32)]
    for k in range(60):  # pairs at cosines from 0.88 to 1
        z = r.standard_normal(dim)
        z -= (z @ base[k]) * base[k]
        c = 0.88 + 0.12 * k / 60
        rows.append(list(map(float, (3 * (c * base[k] + np.sqrt(1 - c * c) * z / np.linalg.norm(z))).astype(np.float32))))
    rows += [list(map(float, (base[100] + 0.03 * r.standard_normal(dim)).astype(np.float32))) for _ in range(cluster)]
    rows += [rows[200]] * 50
    out = [(k, v) for k, v in enumerate(rows)]
    bad = list(rows[0])
    bad[3] = float("nan")
    worse = list(rows[0])
    worse[3] = None
    return out + [(9001, None), (9002, [0.0] * dim), (9003, bad), (9004, worse), (9005, []), (None, rows[5]), (None, None), (9007, [1.0, 2.0]), (9008, [2.0, 4.0]), (7, rows[8]),
                  (9009, [float("inf")] + rows[0][1:])]


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("list_rows", [2048, 40])
def test_links_of_planted_vectors(spark, monkeypatch, list_rows):
    monkeypatch.setattr(projections, "LIST_ROWS", list_rows)  # small: dense lists are dealt out in parts
    rows = planted()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, t string, node int").repartition(3)
    out = projections.near_vectors(df)
    assert {"t", "node"} < set(out.columns)
    want, got = sorted(all_pairs(rows), key=repr), found(out)
    assert len(got) == len(want)
    of = {repr(w[0]): w for w in want if w[0] is not None}
    assert all(g[1] <= of[repr(g[0])][1] for g in got if repr(g[0]) in of and g[0] != 7)  # no link below the limit
    links = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.99 * links
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= len(want) - 6


def test_query_is_exact_on_the_table(spark, sf):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(q.op12_embedding_near_dedup(spark, sf)) == sorted(all_pairs(table), key=repr)


def test_recall_at_the_limit():
    """Pairs at cosine 0.9 exactly, not those of the calibration."""
    window, least = projections.calibrated(64)
    assert least >= 2
    r = np.random.default_rng(99)
    x, z = r.standard_normal((2, 5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (x * z).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    (a, p), (b, s) = projections.project(x), projections.project(0.9 * x + np.sqrt(0.19) * z)
    hit = (a == b) & (np.abs(p.astype(int) - s) <= window)
    assert (hit.sum(1) >= least).mean() >= 0.99


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert projections.near_vectors(df).collect() == []
