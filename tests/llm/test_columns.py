"""Every document operator beside columns whose names clash or hold dots."""

import pytest
from pyspark.sql import functions as F

from hourloom.llm import fingerprints, mixing, ordinal, packing, rules, sharding, simhash, substring, suffixes, tokens
from hourloom.llm import queries as q

EXTRA = ["part", "last", "full", "cut", "base", "x.y", "a b", "_p0", "key", "t", "n", "size"]
OPERATORS = {
    "fingerprints": fingerprints.fingerprint_documents,
    "substring": substring.remove_repeats,
    "sharding": lambda d: sharding.shuffle_into_shards(d, 4),
    "tokens": lambda d: tokens.count_tokens(d, q.TOKENIZER),
    "suffixes": suffixes.remove_repeated_bytes,
    "packing": lambda d: packing.pack(d, q.TOKENIZER, q.WINDOW),
    "simhash": simhash.near_duplicates,
    "one_per_group": simhash.one_per_group,
    "rules": rules.judge_documents,
    "mixing": lambda d: mixing.mix_sources(d, q.MIX_WEIGHTS),
    "classifier": lambda d: ordinal.rate_documents(d, d.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_clashing_and_dotted_names(spark, name):
    rows = [(i, f"some words of document {i} and more of them " * 9, "en", "src0", *[f"{c}{i}" for c in EXTRA]) for i in range(4)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string", *[f"`{c}` string" for c in EXTRA]]))
    out = OPERATORS[name](docs)
    kept = [c for c in EXTRA if c in out.columns]
    assert set(EXTRA) - {"size"} <= set(kept)
    for r in out.select("doc_id", *[F.col(f"`{c}`").alias(f"e{k}") for k, c in enumerate(kept)]).collect():
        assert list(r[1:]) == [f"{c}{r.doc_id}" for c in kept]
