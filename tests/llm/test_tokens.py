"""Token counts and packing against the tokenizer library itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import odd_rows, prose
from tokenizers import Tokenizer

from hourloom.llm import packing
from hourloom.llm import queries as q
from hourloom.llm.tokens import TextTokenizer, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PAIRS = [(i, t) for i, t, *_ in odd_rows()]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


TRICKY = ["", " ", "  a", "a  ", "\n\n a \n", "don't  stop\t\tnow", "a  b", "a  b", "x   y", "a\x1cb !\x1c!", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|>",
          "  <|endoftext|> ", "\r\n\r\nx", "tab\t x", "é  ü　 ß", "1234  5678", "!!! ...  ???", "a\x0b\x0cb", "\x85 a", "<|endof text|>"]


@pytest.mark.parametrize("text", TRICKY)
def test_ids_equal_the_library(library, text):
    t = TextTokenizer(PATH)
    assert t.ids([text])[0].tolist() == ids_of(library, text) and t.counts([text]) == [len(ids_of(library, text))]


def test_ids_of_random_blanks(library):
    import random
    r = random.Random(3)
    texts = ["".join(r.choice([" ", "  ", "\n", "\t", "a", "bc", "!", "'s", "7", "é", " ", "<|endoftext|>", "\x1f"]) for _ in range(40)) for _ in range(400)]
    got = TextTokenizer(PATH).ids(texts)
    assert [g.tolist() for g in got] == [ids_of(library, t) for t in texts]


def test_unit_cache_is_emptied(library, monkeypatch):
    monkeypatch.setattr("hourloom.llm.tokens.CACHE_UNITS", 50)
    t = TextTokenizer(PATH)
    for s in range(6):
        text = prose(s, 30, 1000)
        assert t.ids([text, "x"])[0].tolist() == ids_of(library, text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_kinds_go_to_the_library_whole(name):
    path = public_tokenizers.path(name)
    t, lib = TextTokenizer(path), Tokenizer.from_file(path)
    assert not t.by_unit and t.ids(["Some Text  here"])[0].tolist() == lib.encode("Some Text  here", add_special_tokens=False).ids


def test_counts_query(spark, sf, table, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in q.op4_token_counts(spark, sf).collect()}
    want = {i: (len(t.encode()), n := len(ids_of(library, t)), n > 1024) for i, t in table}
    assert got == want


def test_counts_odd_rows_and_cache(odd, none, library, tmp_path):
    cache = f"file://{tmp_path}/cache"
    want = sorted(((i, len((t or "").encode()), len(ids_of(library, t))) for i, t in PAIRS), key=repr)
    for _ in range(2):  # the second call finds every digest in the cache
        out = count_tokens(odd, PATH, cache)
        assert sorted((tuple(r) for r in out.select("doc_id", "n_bytes", "n_tokens").collect()), key=repr) == want
        stored = odd.sparkSession.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in PAIRS})
    assert {"key", "digest", "lang"} < set(out.columns)
    assert count_tokens(none, PATH).count() == 0


def check_pieces(rows, docs, library, window=1024):
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append([*ids_of(library, t), 0])
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= window
    for i, all_ids in ids.items():
        left = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[i])
        want_total = sorted(len(x) for x in all_ids)
        assert sum(n for _, n, _, _ in left) == sum(want_total)
        for start, n, crc, total in left:
            assert any(len(x) == total and zlib.crc32(np.array(x[start:start + n], "<u4").tobytes()) == crc for x in all_ids)
    total = sum(len(x) for v in ids.values() for x in v)
    return 1 - total / (window * len(seqs))


def test_packing_query(spark, sf, table, library):
    assert check_pieces(q.op6_packing(spark, sf).collect(), table, library) < 0.02


def test_few_cuts_fall_inside_sentences(spark, table, library):
    """A cut inside a sentence is the exception, though padding stays small."""
    from hourloom.llm.tokens import loaded
    ends, blank = packing.sentence_flags(loaded(PATH))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    inside = cuts = 0
    for r in packing.pack(docs, PATH).collect():
        stop = r.start + r.length
        if stop < r.doc_tokens:
            ids = [*ids_of(library, dict(table)[r.doc_id] or ""), 0]
            cuts += 1
            inside += not (ends[ids[stop - 1]] and blank[ids[stop]])
        else:
            cuts += 1
    assert inside < 0.15 * cuts


def test_packing_odd_rows(odd, none, library):
    out = packing.pack(odd, PATH)
    rows = out.collect()
    check_pieces(rows, PAIRS, library)
    assert {"key", "shard", "ids"} < set(out.columns)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(none, PATH).count() == 0


def brute_cost(pos, pen, window):
    best = [0] + [float("inf")] * (len(pos) - 1)
    for j in range(1, len(pos)):
        best[j] = min((best[i] + window - (pos[j] - pos[i]) + pen[j] for i in range(j) if pos[j] - pos[i] <= window), default=float("inf"))
    return best[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_optimal(seed):
    r = np.random.default_rng(seed)
    steps = r.integers(1, 12, 60)
    pos = np.concatenate(([0], np.cumsum(steps)))
    pen = r.choice([0, 2, 12], len(pos))
    pen[-1] = 0
    cuts = packing.choose_cuts(pos, pen, 40)
    cost = sum(40 - (pos[b] - pos[a]) + pen[b] for a, b in zip(cuts, cuts[1:], strict=False))
    assert cuts[0] == 0 and cuts[-1] == len(pos) - 1 and cost == brute_cost(pos.tolist(), pen.tolist(), 40)


def test_pipeline_keeps_the_packed_ids(spark, sf, table, library):
    import corpus_pipeline
    rows = corpus_pipeline.packing(spark, q.documents(spark, sf), sf).collect()
    text = dict(table)
    for r in rows:
        assert r.ids == [*ids_of(library, text[r.doc_id]), 0][r.start:r.start + r.length]
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert len({r.doc_id for r in rows}) == len(table)


def test_packing_query_takes_the_ids(spark, sf, monkeypatch):
    from hourloom.llm import packing
    taken = []
    monkeypatch.setattr(q, "pack", lambda *a, **k: taken.append(packing.pack(*a, **k)) or taken[0])
    q.op6_packing(spark, sf)
    assert {"ids", "ids_crc32"} < set(taken[0].columns)
