"""Fingerprints, sharding and mixing: column functions only."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from conftest import odd_rows
from pyspark.sql import functions as F

from hourloom.llm import fingerprints, mixing, sharding
from hourloom.llm import queries as q

PAIRS = [(i, t) for i, t, *_ in odd_rows()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_python(df):
    assert not any(x in plan_of(df) for x in ("Python", "Pandas", "Arrow"))


def test_fingerprint_query(spark, sf, table):
    df = q.op1_fingerprints(spark, sf)
    no_python(df)
    got = {r.doc_id: r for r in df.collect()}
    order = sorted(table, reverse=True)
    errors = []
    for k, (i, t) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        edited = t[:len(t) - n] + follow[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors.append(abs(r.near_edited - brute.jaccard(t, edited)))
        assert abs(r.near_next - brute.jaccard(t, follow)) < 0.2 and 0 <= r.near_edited <= 1
    assert len(got) == len(table) and np.mean(errors) < 0.05 and max(errors) < 0.2


def test_equal_texts_have_equal_fingerprints(odd):
    rows = fingerprints.fingerprint_documents(odd).collect()
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text or ""].add(r.fingerprint)
    assert all(len(v) == 1 and len(next(iter(v))) == 512 for v in by_text.values())
    assert by_text[""] == {"0" * 512} == by_text[" \t\n\x0b "]
    assert rows[0].key == "k"


def test_likeness_follows_jaccard(spark):
    from conftest import prose
    a = prose(1, 600, 5000).split()
    rows = []
    for share in (0.0, 0.1, 0.3, 0.6, 0.9, 1.0):
        cut = int(len(a) * share)
        b = a[:cut] + prose(9, len(a) - cut, 5000).split()
        rows.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb")
    for r in fingerprints.with_likeness(df, "j", "fa", "fb", F.lit(False), F.lit(False)).collect():
        assert abs(r.j - brute.jaccard(r.a, r.b)) < 0.12
    assert [x.j for x in fingerprints.with_likeness(df.limit(1), "j", "fa", "fa", F.lit(False), F.lit(False)).collect()] == [1.0]


def test_next_row_over_blocks(spark):
    ids = [*range(0, 300, 3), 1000, 1001, 5000, None, 7, 7]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = fingerprints.with_next(df, "doc_id", [F.col("text")], ["doc_id", "text"]).collect()
    rows = sorted(((-(2**62) if r.doc_id is None else -r.doc_id), r.text) for r in got)
    del rows
    order = sorted(got, key=lambda r: (-(r.doc_id if r.doc_id is not None else -1), r.text))
    assert len(got) == len(ids)
    for k, r in enumerate(order):
        follow = order[(k + 1) % len(order)]
        assert (r._c_next_doc_id, r._c_next_text) == (follow.doc_id, follow.text)
    one = fingerprints.with_next(df.limit(1), "doc_id", [F.col("text")], ["text"]).collect()
    assert one[0]._c_next_text == one[0].text


def test_next_row_splits_a_hot_id(spark):
    ids = [None] * 400 + [7] * 300 + list(range(500)) + [2**63 - 1] * 50
    df = spark.createDataFrame([(i, f"t{k // 2}") for k, i in enumerate(ids)], "doc_id long, text string")  # every text twice
    tie = F.xxhash64("text")
    df = df.withColumn("h", tie)
    out = fingerprints.with_next(df, "doc_id", [], ["doc_id", "text"], tie=tie)
    got = out.collect()
    order = sorted(got, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    assert len(got) == len(ids) and out.columns == ["doc_id", "text", "h", "_c_next_doc_id", "_c_next_text"]
    for k, r in enumerate(order):
        if k + 1 < len(order) and (order[k + 1].doc_id, order[k + 1].text) == (r.doc_id, r.text):
            continue  # twins: one is followed by the other, the other by what comes next
        pair = {(x._c_next_doc_id, x._c_next_text) for x in order[max(0, k - 1):k + 1] if (x.doc_id, x.text) == (r.doc_id, r.text)}
        follow = order[(k + 1) % len(order)]
        assert (follow.doc_id, follow.text) in pair
    share = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert share <= 0.3 * len(ids)  # the null id's rows, a third of all, lie in several tasks


def test_fingerprints_of_nothing(none):
    assert fingerprints.fingerprint_documents(none).collect() == []
    assert fingerprints.with_next(none, "doc_id", [F.col("text")], ["text"]).collect() == []


def check_shards(rows, n, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_query(spark, sf, table):
    df = q.op3_sharding(spark, sf)
    no_python(df)
    rows = df.collect()
    check_shards(rows, len(table), 8)
    text = dict(table)
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode())) for r in rows)
    assert sorted(r.doc_id for r in rows) == sorted(text) and {r.law for r in rows} == {"rows"}


def test_sharding_repeats_itself_and_mixes(odd):
    runs = [sorted(((r.shard, r.slot), r.doc_id or -1, r.text or "") for r in sharding.shuffle_into_shards(odd, 3, seed=s).collect()) for s in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2]
    out = sharding.shuffle_into_shards(odd, 3, seed=1)
    check_shards(out.collect(), len(PAIRS), 3)
    assert {"key", "lo", "bucket"} < set(out.columns)


def test_sharding_spreads_equal_rows(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shuffle_into_shards(df, 8, bucket_rows=500).collect()
    check_shards(rows, 4000, 8)
    assert max(Counter(r.bucket for r in rows).values()) < 300


def test_sharding_order_is_uniform(spark):
    rows = sharding.shuffle_into_shards(spark.range(20_000).withColumnRenamed("id", "doc_id"), 4, bucket_rows=3000).collect()
    rows.sort(key=lambda r: r.slot * 4 + r.shard)
    ids = np.array([r.doc_id for r in rows])
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.03
    assert abs(np.mean(np.diff(ids) == 1)) < 0.01


def test_sharding_query_shuffles_the_texts(spark, sf, monkeypatch):
    taken = []
    monkeypatch.setattr(q, "shuffle_into_shards", lambda docs, *a: taken.append(docs) or sharding.shuffle_into_shards(docs, *a))
    q.op3_sharding(spark, sf).collect()
    assert set(taken[0].columns) == set(q.documents(spark, sf).columns)


def test_sharding_buckets_are_bounded_by_bytes(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long "), 2000).alias("text"))
    out = sharding.shuffle_into_shards(df, 4, bucket_bytes=50_000)
    rows = out.collect()
    check_shards(rows, 600, 4)
    assert {(r.doc_id, r.text) for r in rows} == {(i, "long " * 2000) for i in range(600)}
    assert max(Counter(r.bucket for r in rows).values()) < 25


def test_write_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, f"file://{tmp_path}/s", 3)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == len(PAIRS)


def test_sharding_of_nothing(none):
    assert sharding.shuffle_into_shards(none, 8).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_water_filling(spark, seed):
    r = np.random.default_rng(seed)
    n = 12
    weights, caps = r.choice([0.0, 1.0, 2.0, 5.0], n), r.integers(0, 100, n).astype(float)
    total = float(r.integers(1, 500))
    df = spark.createDataFrame([("p", str(i), total, float(w), float(c)) for i, (w, c) in enumerate(zip(weights, caps, strict=True))], "domain string, lang string, g double, w double, c double")
    got = {x.lang: x.a for x in mixing.water_fill(df, ["domain"], "g", "w", "c", "a").collect()}
    want = brute.fill(total, weights.tolist(), caps.tolist())
    assert np.allclose([got[str(i)] for i in range(n)], want, atol=1e-6)


def leaf_want(leaves, weights, total, epochs):
    """Budgets top down, by bisection."""
    w = lambda lv, v: weights.get(lv, {}).get(v, 1.0)
    cap = {k: (t * epochs if all(w(lv, v) > 0 for lv, v in zip(mixing.LEVELS, k, strict=True)) else 0.0) for k, t in leaves.items()}
    given = {(): min(total, sum(cap.values()))}
    for depth, level in enumerate(mixing.LEVELS):
        nodes = sorted({k[:depth + 1] for k in leaves})
        fresh = {}
        for p in given:
            kids = [k for k in nodes if k[:depth] == p]
            got = brute.fill(given[p], [w(level, k[-1]) for k in kids], [sum(c for x, c in cap.items() if x[:depth + 1] == k) for k in kids])
            fresh.update(zip(kids, got, strict=True))
        given = fresh
    return given


def test_mixing_query(spark, sf):
    df = q.op10_mixing(spark, sf)
    no_python(df)
    rows = df.collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("domain", q.domain_of(F.col("source"))).collect()
    tokens = {r.doc_id: -(-len(r.text.encode()) // 4) for r in docs}
    leaf = {r.doc_id: (r.domain, r.lang, r.source) for r in docs}
    supply = Counter()
    for i, k in leaf.items():
        supply[k] += tokens[i]
    budgets = leaf_want(supply, q.MIX_WEIGHTS, q.MIX_SHARE * sum(supply.values()), q.MIX_EPOCHS)
    got, taken = Counter(), Counter()
    for r in rows:
        assert (r.domain, r.lang, r.source) == leaf[r.doc_id] and r.n_tokens == tokens[r.doc_id]
        got[leaf[r.doc_id]] += r.n_tokens
        taken[r.doc_id, r.epoch] += 1
    assert set(taken.values()) == {1}
    for k, b in budgets.items():
        left = [tokens[i] for i in leaf if leaf[i] == k and sum((i, e) in taken for e in range(2)) * 1 < 2]
        assert got[k] <= b + 1e-6 and (b - got[k] < max(left, default=1))  # a prefix: the next document would not fit
        assert b - got[k] <= max(tokens[i] for i in leaf if leaf[i] == k)
    for (i, e) in taken:
        assert e == 0 or (i, e - 1) in taken


def test_mixing_odd_rows(odd, none):
    out = mixing.mix_sources(odd, {"source": {"src0": 0.0}}, share=0.5, epochs=2)
    rows = out.collect()
    assert rows and all(r.source != "src0" for r in rows) and {"key", "epoch", "lo"} < set(out.columns)
    again = mixing.mix_sources(odd, {"source": {"src0": 0.0}}, share=0.5, epochs=2).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    everything = mixing.mix_sources(odd, {}, share=1.0, epochs=1).collect()
    assert Counter(r.text for r in everything if r.n_tokens) == Counter(t for _, t in PAIRS if t)
    assert mixing.mix_sources(none, {}).collect() == []


def test_mixing_takes_repeated_rows_together(spark):
    df = spark.createDataFrame([(1, "x" * 40, "en", "a")] * 50 + [(i, "y" * 40, "en", "a") for i in range(2, 60)], "doc_id long, text string, lang string, source string")
    got = Counter(r.doc_id for r in mixing.mix_sources(df, {}, share=0.5, epochs=1).collect())
    assert got.get(1, 0) in (0, 50) and sum(got.values()) <= 54
