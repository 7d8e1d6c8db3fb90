"""Registered queries of the operators, with production parameters, and
their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.common import documents
from hourloom.llm.fingerprints import with_fingerprint, with_likeness, with_next
from hourloom.llm.mixing import mix_sources
from hourloom.llm.ordinal import rate_documents
from hourloom.llm.packing import pack
from hourloom.llm.projections import near_vectors
from hourloom.llm.repair import damaged, digest_lines, repair_conversations
from hourloom.llm.rules import judge_documents
from hourloom.llm.rulesoracle import quality_rules_sql
from hourloom.llm.sharding import shuffle_into_shards
from hourloom.llm.simhash import near_duplicates
from hourloom.llm.substring import remove_repeats
from hourloom.llm.suffixes import remove_repeated_bytes
from hourloom.llm.tokens import count_tokens
from hourloom.llm.trie import prefix_trie, rebuilt
from hourloom.llm.turns import conversation_key

TOKENIZER = "byte_bpe_50k.json"
WINDOW = 1024
SHARDS = 8
#: Target weights of the mix (a level value that is not named weighs 1) and its budget.
MIX_WEIGHTS = {
    "domain": {"reference": 3.0, "web": 5.0, "forum": 2.0},
    "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.5},
    "source": {"src0": 2.0},
}
MIX_SHARE, MIX_EPOCHS = 0.6, 2


def domain_of(source: Column) -> Column:
    """Domain of a source, by its number (a source without one: ``web``)."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1)
    n = F.when(number != "", number.try_cast("bigint")) % 4
    return F.when(n == 1, "reference").when(n == 2, "forum").otherwise("web")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("_c_text"))
    docs = docs.withColumn("_c_none", F.trim(F.translate("_c_text", "\t\n\x0b\x0c\r", "     ")) == "")
    docs = with_fingerprint(docs, "_c_text", "fingerprint")
    docs = with_next(docs, "doc_id", [], ["_c_text", "fingerprint", "_c_none"], tie=F.xxhash64("_c_text"))
    docs = docs.withColumn("n_chars", F.length("_c_text").cast("long")).withColumn("_c_cut", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.substr("_c_text", F.lit(1), F.col("n_chars").cast("int") - F.col("_c_cut")), F.substr("_c_next__c_text", F.lit(1), F.col("_c_cut")))
    docs = docs.withColumn("_c_edited", edited).withColumn("edited_sha256", F.sha2("_c_edited", 256))
    docs = docs.withColumn("_c_none2", F.trim(F.translate("_c_edited", "\t\n\x0b\x0c\r", "     ")) == "").drop("_c_text", "_c_next__c_text")
    docs = with_fingerprint(docs, "_c_edited", "edited_fingerprint").drop("_c_edited")
    docs = with_likeness(docs, "near_edited", "fingerprint", "edited_fingerprint", F.col("_c_none"), F.col("_c_none2"))
    docs = with_likeness(docs, "near_next", "fingerprint", "_c_next_fingerprint", F.col("_c_none"), F.col("_c_next__c_none"))
    return docs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_into_shards(documents(spark, sf_dir), SHARDS)
    text = F.coalesce("text", F.lit(""))
    out = out.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER, WINDOW)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = rate_documents(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return out.select("doc_id", "expected_grade", "tail_probability", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_documents(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      F.round("char_distance", 9).alias("char_distance"), F.round("word_distance", 9).alias("word_distance"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, domain=domain_of(F.col("source")))
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def repair_table(rows: DataFrame) -> DataFrame:
    """Repair of the damaged table, one row per conversation of the original."""
    found = repair_conversations(damaged(rows))
    convs = rows.groupBy(F.col("conv_id")).agg(F.count(F.lit(1)).alias("n")).select("conv_id", conversation_key(F.col("conv_id")).alias("_c_conv"))
    audit = F.sort_array(F.collect_list(F.struct("_c_block", "audit")))  # as long as the column that is asked for
    audits = found.edits.groupBy("_c_conv").agg(F.array_join(F.transform(audit, lambda x: x["audit"]), "").alias("audit"))
    out = convs.join(found.report, "_c_conv", "left").join(audits, "_c_conv", "left").join(digest_lines(found.lines), "_c_conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


def trie_table(rows: DataFrame) -> DataFrame:
    """Prefix trie of the rebuilt conversations."""
    return prefix_trie(*rebuilt(rows))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def registered_queries() -> dict:
    found = [op1_fingerprints, op2_substring_dedup, op3_sharding, op4_token_counts, op5_suffix_dedup, op6_packing, op7_simhash, op8_classifier,
             op9_quality_rules, op10_mixing, op11_conversation_repair, op12_embedding_near_dedup, op13_prefix_trie, pipeline]
    return {f.__name__: f for f in found}


#: op2: windows as lists of words; first document of each; cover by window starts.
_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS s FROM d WHERE len(w) >= 13)),
firsts AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 12)) AS i FROM win JOIN firsts USING (g) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


#: op12: cosines of all pairs; components by the least reachable id.
_OP12 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM low LEFT JOIN deg USING (vec_id)
"""


def registered_sql() -> dict[str, str]:
    return {"op2_substring_dedup": _OP2, "op9_quality_rules": quality_rules_sql(), "op12_embedding_near_dedup": _OP12}
