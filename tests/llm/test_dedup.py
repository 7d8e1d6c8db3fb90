"""Substring, suffix-array and SimHash operators against brute force."""

import brute
import pytest
from conftest import odd_rows, prose
from pyspark.sql import functions as F

from hourloom.llm import queries as q
from hourloom.llm import simhash, substring, suffixes, windows64
from hourloom.llm.repeats import key_groups
from hourloom.llm.substring import SuffixAutomaton, cover_spans, remove_repeats
from hourloom.llm.suffixes import remove_repeated_bytes

PAIRS = [(i, t) for i, t, *_ in odd_rows()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_substring_query(spark, sf, table):
    assert rows(q.op2_substring_dedup(spark, sf)) == sorted(brute.substring(table), key=repr)


def test_substring_odd_rows(odd):
    out = remove_repeats(odd)
    assert {"key", "shard", "kept", "lo", "u", "lang"} < set(out.columns)
    got = rows(out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)))
    assert got == sorted(brute.substring(PAIRS), key=repr)


def test_substring_hot_key_in_parts(odd, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_BYTES", 300)  # every hot key takes several automata
    got = rows(remove_repeats(odd).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)))
    assert got == sorted(brute.substring(PAIRS), key=repr)


def test_suffix_query(spark, sf, table):
    assert rows(q.op5_suffix_dedup(spark, sf)) == sorted(brute.suffixes(table), key=repr)


def test_suffix_odd_rows(odd):
    out = remove_repeated_bytes(odd)
    got = rows(out.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans"), F.sha2("kept_bytes", 256)))
    assert got == sorted(brute.suffixes(PAIRS), key=repr)


def test_suffix_small_batches(odd, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 2_000)
    got = rows(remove_repeated_bytes(odd).select("doc_id", "n_bytes", "n_removed", F.size("removed_spans"), F.sha2("kept_bytes", 256)))
    assert got == sorted(brute.suffixes(PAIRS), key=repr)


@pytest.mark.parametrize("bucket", [64, 1 << 16])
def test_sorted_suffixes_are_in_order(bucket, monkeypatch):
    import numpy as np
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    raw = ("abracadabra" * 40 + prose(3, 50) + "abracadabra" * 40).encode()
    text = np.zeros(len(raw) + 416, np.uint8)
    text[:len(raw)] = np.frombuffer(raw, np.uint8)
    eights = np.zeros(len(text) - 8, np.uint64)
    for i in range(8):
        eights |= text[i:len(text) - 8 + i].astype(np.uint64) << np.uint64(8 * (7 - i))
    starts = np.arange(len(raw) - 200)
    ranks = suffixes.cover_ranks(eights, len(raw), 200)
    got = np.concatenate(list(suffixes.sorted_suffixes(eights, starts, ranks)))
    cut = [text[i:i + 200].tobytes() for i in got]
    assert sorted(got.tolist()) == starts.tolist() and cut == sorted(cut)


def test_cover_meets_every_pair():
    steps = suffixes.cover_steps()
    inside = set(suffixes.COVER)
    for i in range(suffixes.PERIOD):
        for j in range(suffixes.PERIOD):
            assert (i + steps[i, j]) % suffixes.PERIOD in inside and (j + steps[i, j]) % suffixes.PERIOD in inside


def test_automaton_first_owners():
    texts = [prose(s, 60, 6).split() for s in range(8)]
    a = SuffixAutomaton()
    for i, t in enumerate(texts):
        a.add(t, 50 - i)
    a.close()
    other = prose(77, 50, 6).split()
    for t in [*texts, other]:
        want = [min([50 - i for i, u in enumerate(texts) if any(u[k:k + 4] == t[s:s + 4] for k in range(len(u) - 3))], default=2**63 - 1) for s in range(len(t) - 3)]
        assert a.first_owners(t, 4) == want


def test_long_documents_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(windows64, "CHUNK", 500)
    # workers import their own module: pieces themselves are checked here
    for n in (0, 5, 499, 500, 700, 1699, 1700, 5000):
        got = list(windows64.pieces(n, 200))
        starts = [s for a, e in got for s in range(a, max(a, e - 199))]
        assert starts == list(range(max(0, n - 199)))


def test_key_groups_hold_whole_keys():
    import pyarrow as pa
    data = [(k, d, 0, 1, 0, 1, b"x" * 10) for k in range(7) for d in range(k + 1)]
    batches = [pa.RecordBatch.from_pylist([dict(zip("abcdefg", r, strict=True)) for r in data[i:i + 3]]) for i in range(0, len(data), 3)]
    groups = list(key_groups(iter(batches), 40))
    assert [r for g in groups for r in g] == data
    keys = [{r[0] for r in g} for g in groups]
    assert all(not (a & b) for i, a in enumerate(keys) for b in keys[:i])


def test_cover_spans():
    assert cover_spans([5, 3, 30, 5], 4) == [[3, 9], [30, 34]]


def test_simhash_query(spark, sf, table):
    got = rows(q.op7_simhash(spark, sf))
    assert got == sorted(brute.near_groups(table), key=repr)


def test_simhash_odd_rows(odd):
    got = rows(simhash.near_duplicates(odd).select("doc_id", "fingerprint", "component_id"))
    assert got == sorted(brute.near_groups(PAIRS), key=repr)


def test_one_row_per_group(odd):
    kept = simhash.one_per_group(odd).select("doc_id", "text").collect()
    groups = brute.near_groups(PAIRS)
    by_fp = brute.linked([int(f, 16) for _, f, _ in groups])
    assert len(kept) == len(set(by_fp))
    assert {r.doc_id for r in kept} >= {c for *_, c in groups if c is not None}


@pytest.mark.parametrize("seed", range(3))
def test_links_join_all_that_are_near(spark, seed):
    import random
    r = random.Random(seed)
    values = {r.getrandbits(64) for _ in range(20)}
    for v in list(values):
        for _ in range(25):
            for b in r.sample(range(64), r.randrange(1, 7)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    found = {a.node: a.root for a in simhash.components(simhash.links(df)).collect()}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    got = [found.get(v, v) for v in signed]
    want = brute.linked(values)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    found = {a.node: a.root for a in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}


def test_empty_tables(none):
    assert remove_repeats(none).collect() == remove_repeated_bytes(none).collect() == []
    assert simhash.near_duplicates(none).collect() == simhash.one_per_group(none).collect() == []


@pytest.mark.parametrize("limit", [0, 3])
def test_hot_keys_are_dealt_out_by_their_windows(odd, monkeypatch, limit):
    from hourloom.llm import repeats
    monkeypatch.setattr(repeats, "HOT_CLASSES", limit)
    got = rows(remove_repeats(odd).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)))
    assert got == sorted(brute.substring(PAIRS), key=repr)
    got = rows(remove_repeated_bytes(odd).select("doc_id", "n_bytes", "n_removed", F.size("removed_spans"), F.sha2("kept_bytes", 256)))
    assert got == sorted(brute.suffixes(PAIRS), key=repr)


def test_marks_of_repeated_rows_are_gathered_once(spark):
    from hourloom.llm.repeats import per_document
    docs = spark.range(3000).select(F.lit(1).alias("_c_id"), F.lit(2).alias("_c_hash"))
    marks = spark.range(6000).select(F.lit(1).alias("_c_id"), F.lit(2).alias("_c_hash"), F.array(F.col("id") % 2 * 9, F.lit(5)).alias("s"))
    got = per_document(docs, marks, "s").select(F.array_sort("_c_marks").alias("m")).collect()
    assert len(got) == 3000 and {tuple(r.m) for r in got} == {(0, 5, 5, 9)}


@pytest.mark.parametrize("limit", [0, 1000])
def test_class_texts_of_repeated_rows_are_fetched_once(spark, monkeypatch, limit):
    from hourloom.llm import repeats
    monkeypatch.setattr(repeats, "HOT_CLASSES", limit)
    docs = repeats.keyed(spark.createDataFrame([(1, prose(1, 60))] * 2000 + [(2, prose(1, 60) + " other end")], "doc_id long, text string"))
    runs = repeats.runs_of(docs, "words", 13, 5)
    for df, names in zip(repeats.class_texts(docs, runs, "words", 13, "test"), (["key", "digest"], ["key", "digest", "j"]), strict=True):
        assert df.count() == df.select(names).distinct().count()


@pytest.mark.parametrize("limit", [0, 1000])
def test_some_thousand_repeated_rows(spark, monkeypatch, limit):
    from hourloom.llm import repeats
    monkeypatch.setattr(repeats, "HOT_CLASSES", limit)
    same = prose(1, 80)
    pairs = [(1, same), (2, same + " other end")] + [(7, same)] * 2000 + [(None, same)] * 2000
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    some = [(1, same), (2, same + " other end"), (7, same), (7, same), (None, same), (None, same)]
    got = rows(remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)))
    assert len(got) == 4002 and set(got) == set(brute.substring(some))
    got = rows(remove_repeated_bytes(df).select("doc_id", "n_bytes", "n_removed", F.size("removed_spans"), F.sha2("kept_bytes", 256)))
    assert len(got) == 4002 and set(got) == set(brute.suffixes(some))


def test_suffix_hot_key_is_cut_up_before_it_is_sorted(spark, monkeypatch):
    from hourloom.llm import repeats
    monkeypatch.setattr(repeats, "HOT_CLASSES", 5)
    seen = []

    def watched(classes, *a):
        seen.append(max((r["count"] for r in classes.groupBy("key").count().collect()), default=0))
        return repeats.judged(classes, *a)
    monkeypatch.setattr(suffixes, "judged", watched)
    passage = prose(2, 90)
    pairs = [(i, prose(50 + i, 30) + " " + passage + " " + prose(150 + i % 20, 30)) for i in range(60)]
    got = rows(remove_repeated_bytes(spark.createDataFrame(pairs, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", F.size("removed_spans"), F.sha2("kept_bytes", 256)))
    assert got == sorted(brute.suffixes(pairs), key=repr)
    assert len(seen) == 3 and max(seen) <= 5


def test_substring_tells_words_apart_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement collide under polynomial hashes modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    pairs = [(1, f"a b c d e f {one} g h i j k l"), (2, f"a b c d e f {two} g h i j k l"), (3, f"a b c d e f {one} g h i j k l")]
    out = remove_repeats(spark.createDataFrame(pairs, "doc_id long, text string"))
    got = rows(out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)))
    assert got == sorted(brute.substring(pairs), key=repr)


def test_texts_over_a_piece(spark):
    """One text of more than a MiB, a passage of which is in another."""
    long = prose(31, 260_000, 5_000)
    assert len(long) > 1 << 20
    pairs = [(1, long[:600_000]), (2, prose(32, 40) + " " + long + " " + prose(33, 40)), (3, prose(34, 60))]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert rows(remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))) == sorted(brute.substring(pairs), key=repr)
