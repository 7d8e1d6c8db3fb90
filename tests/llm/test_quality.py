"""Quality rules, ordinal classifier and the corpus pipeline."""

from collections import Counter

import brute
import numpy as np
import pytest
from conftest import odd_rows
from pyspark.sql import functions as F

import corpus_pipeline
from hourloom.llm import ordinal, rules
from hourloom.llm import queries as q

PAIRS = [(i, t) for i, t, *_ in odd_rows()]
BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def js(p, q_):
    p, q_ = np.array(p, float) / sum(p), np.array(q_, float) / sum(q_)
    m = (p + q_) / 2
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    return max(0.0, (kl(p) + kl(q_)) / 2) ** 0.5


def test_rules_query(spark, sf, table):
    rows = q.op9_quality_rules(spark, sf).collect()
    assert sorted(tuple(r[c] for c in BASE) for r in rows) == sorted((i, *brute.base_counts(t)) for i, t in table)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by, n = {}, Counter()
    found = {i: rules.measures(t.encode()) for i, t in table}
    for i, m in found.items():
        if not brute.base_counts(dict(table)[i])[-1] and 20 * m[2] <= m[0]:
            by[lang[i]] = by.get(lang[i], 0) + np.array([*m[5], *m[6]])
            n[lang[i]] += 1
    for r in rows:
        m, ref = found[r.doc_id], by.get(lang[r.doc_id])
        char = js(m[5], ref[:7]) if n[lang[r.doc_id]] >= 20 and m[0] >= 50 else None
        word = js(m[6], ref[7:]) if n[lang[r.doc_id]] >= 20 and m[0] >= 80 else None
        assert r.char_distance == pytest.approx(char, abs=1e-8) if char is not None else r.char_distance is None
        assert r.word_distance == pytest.approx(word, abs=1e-8) if word is not None else r.word_distance is None
        assert r.kept == (not r.base_failed and not (char or 0) > rules.MAX_CHAR_DISTANCE and not (word or 0) > rules.MAX_WORD_DISTANCE)


def test_rules_part_good_from_bad(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = q.op9_quality_rules(spark, sf).where("n_words >= 50").join(labels, "doc_id").collect()
    bad = [r.kept for r in rows if r.quality == 0]
    good = [r.kept for r in rows if r.quality == 1]
    assert np.mean(bad) < 0.05 and np.mean(good) > 0.98


def test_rules_odd_rows(odd, none):
    out = rules.judge_documents(odd)
    rows = out.collect()
    assert sorted((tuple(r[c] for c in BASE) for r in rows), key=repr) == sorted(((i, *brute.base_counts(t)) for i, t in PAIRS), key=repr)
    assert {"key", "text", "lo"} < set(out.columns) and all(not r.kept for r in rows if not (r.text or "").strip())
    assert rules.judge_documents(none).collect() == []


def test_class_counts_are_code_points():
    text = "Aé ß\t9,#　x"
    m = rules.measures(text.encode())
    assert sum(m[5]) == len(text) and m[1] == sum(len(w) for w in text.encode().decode().replace("\t", " ").split(" "))


def test_js_distance():
    a, b = np.array([[1.0, 0, 3], [0, 0, 0]]), np.array([[2.0, 2, 0], [1, 1, 1]])
    assert rules.js_distance(a, b).tolist() == pytest.approx([js([1, 0, 3], [2, 2, 0]), 0.0])


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = q.documents(spark, sf).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = ordinal.fit(*ordinal.labelled_sample(docs, labels, 1900))  # about the first half of the hash range
    x, y = ordinal.labelled_sample(docs, labels, 10**9, held_out=True)
    tail = 1 - model.at_most(model.scores(x))[:, -1]
    kept = tail >= ordinal.KEEP_TAIL
    assert len(y) > 1500
    assert np.mean(kept[y == 2]) > 0.98 and np.mean(kept[y == 0]) < 0.1 and np.mean(kept[y == 1]) < 0.1
    assert model.thresholds[0] < model.thresholds[1]


def test_classifier_query(spark, sf, table):
    df = q.op8_classifier(spark, sf)
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in table)
    assert all(0 <= r.expected_grade <= 2 and r.kept == (r.tail_probability >= 0.5) for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, q.op8_classifier(spark, sf).collect()))


def test_classifier_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 1, 0), (11, 0, 0), (None, 1, 0), (12, None, None), (13, 0, None), (14, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    out = ordinal.rate_documents(odd, labels)
    assert out.count() == len(PAIRS) and {"key", "lo", "score"} < set(out.columns)
    blank_ids = [i for i, t in PAIRS if not (t or "").strip()]
    assert all(r.score == 0.0 for r in out.collect() if r.doc_id in blank_ids and r.doc_id is not None)
    blank = ordinal.rate_documents(odd, labels.limit(0)).collect()
    assert {r.score for r in blank} == {0.0} and all(r.kept for r in blank)
    assert ordinal.rate_documents(none, labels).collect() == []


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(600):
        g = int(r.integers(0, 3))
        rows.append(np.unique(np.concatenate([r.integers(100, 200, 5), [g], r.integers(5000, 200_000, 3)])))
        grades.append(g)
    m = ordinal.fit(rows, np.array(grades))
    s = m.scores(rows)
    means = [s[np.array(grades) == g].mean() for g in range(3)]
    assert means[0] < means[1] < means[2]
    p = m.at_most(s)
    assert (p[:, 0] <= p[:, 1]).all()
    assert np.mean(((1 - p).sum(axis=1).round()) == grades) > 0.95


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        after = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        if name == "quality rules":
            kept = {r.doc_id for r in q.op9_quality_rules(spark, sf).collect() if r.kept}
            assert {r.doc_id for r in after} == kept and len(after) < n
        if name == "SimHash near-dedup":
            assert sorted(r.doc_id for r in after) == sorted({c for *_, c in brute.near_groups([(r.doc_id, r.text) for r in before])})
        if name == "substring dedup":
            want = {i: (n_, s) for i, _, n_, s in brute.substring([(r.doc_id, r.text) for r in before])}
            text = {r.doc_id: r.text for r in before}
            assert len(after) == len(before)
            for r in after:
                assert r.n_chars == len(r.text) and (brute.sha(r.text.encode()) == want[r.doc_id][1] if want[r.doc_id][0] else r.text == text[r.doc_id])
        if name == "mixing sources to target weights":
            texts = {r.doc_id: r.text for r in before}
            assert 0 < len(after) < len(before) and all(texts[r.doc_id] == r.text for r in after)
        if name == "packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before} and max(r.offset + r.length for r in after) <= 1024


def test_pipeline_query_and_odd_rows(spark, odd, none, sf):
    assert q.pipeline(spark, sf).count() > 0
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).collect()


def test_sample_has_one_row_per_id(spark):
    from hourloom.llm.ordinal import labelled_sample
    df = spark.createDataFrame([(1, "same text")] * 500 + [(1, "other text"), (2, "two words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    found, grades = labelled_sample(df, labels)
    assert len(found) == len(grades) == 2
