"""Quality rules: base counts and divergence from the language's references.

Each document has a histogram of character classes and one of common words
(fixed lists below, all other words in one more bin).  The references are the
pooled histograms of all documents of a language that pass the base rules and
are not full of symbols.  A document is rejected when it fails the base rules or when the Jensen-Shannon
distance (base 2, 0 to 1) of a histogram to its reference is over its limit.
Guards: a histogram is judged only over enough words, and only if enough
documents made its reference.

Defined cases: null or blank texts have no words and fail the base rules; a
null language is a language of its own; repeated rows are judged alike; with
no document that passes there is no reference and the base rules decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import land, plain_columns, replaced, sized, texts

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Limits of the Jensen-Shannon distances, words needed to judge, documents behind a reference.
MAX_CHAR_DISTANCE, CHAR_WORDS = 0.18, 50
MAX_WORD_DISTANCE, COMMON_WORDS = 0.33, 80
REFERENCE_DOCS = 20
#: A document with more than one symbol in so many words is left out of the references.
SYMBOL_WORDS = 20

# Common function words of English, German, French and Spanish.
COMMON = (
    "the of and to in a is that it for as was with be by on this are at an or from",
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es",
    "le la les des et en un une que qui dans pour pas sur au plus par ce il est",
    "el los las del y se una con no su al lo como más pero sus le ya o",
)
WORDS = tuple(dict.fromkeys(w.encode() for line in COMMON for w in line.split()))
SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    """Class of every byte: 0 blank, 1 a-z, 2 A-Z, 3 digit, 4 common punctuation,
    5 other ASCII, 6 first byte of a longer character, 7 its other bytes (not counted)."""
    c = np.full(256, 5)
    c[[32, *range(9, 14)]] = 0
    c[ord("a"):ord("z") + 1] = 1
    c[ord("A"):ord("Z") + 1] = 2
    c[ord("0"):ord("9") + 1] = 3
    c[list(b".,;:!?'\"()-")] = 4
    c[0xC0:] = 6
    c[0x80:0xC0] = 7
    return c


CLASS = _classes()
N_CLASSES = 7


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more in the text, first included."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    times = Counter(grams)
    inside = np.zeros(len(words) + 2, bool)
    hit = np.fromiter((times[g] > 1 for g in grams), bool, len(grams))
    for d in range(3):
        inside[d:d + len(hit)] |= hit
    return int(inside.sum())


def measures(raw: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class and
    common-word counts of one UTF-8 text."""
    words = raw.split()
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by_class = np.bincount(CLASS, weights=by_byte, minlength=8).astype(np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    common = Counter(raw.lower().split())
    known = [common[w] for w in WORDS]
    return (len(words), int(by_class[:7].sum() - by_class[0]), int(by_byte[list(SYMBOLS)].sum()), len(lines) - len(set(lines)),
            repeat_words(words), by_class[:N_CLASSES].tolist(), [*known, len(words) - sum(known)])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the divergence, base 2) of rows of
    counts; a row without counts is at distance 0."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        r = np.divide(x, m, out=np.ones_like(m), where=x > 0)
        return (x * np.log2(r)).sum(axis=1)
    return np.sqrt(np.maximum((part(p) + part(q)) / 2, 0)) * ((p.sum(axis=1) > 0) & (q.sum(axis=1) > 0))


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _failed(m: tuple) -> bool:
    return m[0] < MIN_WORDS or 100 * m[4] > MAX_REPEAT_PERCENT * m[0]


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per language: ``_c_lang`` and ``_c_ref``, the pooled class counts,
    common-word counts and number of the documents that may make one.
    Tasks add up their own batches first, so what is shuffled is small."""
    rows = docs.select(_lang(lang_col).alias("_c_lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_c_text"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in sized(batches, "_c_text"):
            for lang, raw in zip(b.column("_c_lang").to_pylist(), texts(b, "_c_text"), strict=True):
                m = measures(raw)
                if not _failed(m) and SYMBOL_WORDS * m[2] <= m[0]:
                    sums[lang] = sums.get(lang, 0) + np.array([*m[5], *m[6], 1], np.int64)
            if len(sums) > 1000:
                yield _reference_rows(sums)
                sums = {}
        if sums:
            yield _reference_rows(sums)

    bins = rows.mapInArrow(add_up, "_c_lang string, s array<long>").select("_c_lang", F.posexplode("s").alias("i", "n"))
    sums = bins.groupBy("_c_lang", "i").agg(F.sum("n").alias("n"))
    return land(sums.groupBy("_c_lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("_c_ref")), "rules-references")


def _reference_rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["_c_lang", "s"])


def _lang(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit("(null)"))


@plain_columns
def judge_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The operator: input rows plus the base counts, ``base_failed``,
    ``char_distance``, ``word_distance`` (null: not judged) and ``kept``.

    Two passes: the references (one small row per language), then the verdicts
    beside each document, whose text is not shuffled as long as Spark can
    broadcast the written references."""
    own = [*_BASE, "base_failed", "char_distance", "word_distance", "kept"]
    keep = replaced(docs, own)
    refs = references(docs, text_col, lang_col)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], _lang(lang_col).alias("_c_lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_c_text"))
    joined = rows.join(refs, "_c_lang", "left")
    schema = joined.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name in own:
        schema = schema.add(name, "boolean" if name in ("base_failed", "kept") else "double" if name.endswith("distance") else "long")
    width = N_CLASSES + len(WORDS) + 2

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "_c_text"):
            found = [measures(x) for x in texts(b, "_c_text")]
            cols = list(zip(*found, strict=True))
            ref = np.array([r or [0] * width for r in b.column("_c_ref").to_pylist()], np.float64)
            n_words = np.array(cols[0])
            enough = ref[:, -1] >= REFERENCE_DOCS
            char = js_distance(np.array(cols[5], np.float64), ref[:, :N_CLASSES])
            word = js_distance(np.array(cols[6], np.float64), ref[:, N_CLASSES:-1])
            char_judged, word_judged = enough & (n_words >= CHAR_WORDS), enough & (n_words >= COMMON_WORDS)
            bad = (char_judged & (char > MAX_CHAR_DISTANCE)) | (word_judged & (word > MAX_WORD_DISTANCE))
            failed = np.array([_failed(m) for m in found])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(failed),
                 pa.array(char, mask=~char_judged), pa.array(word, mask=~word_judged), pa.array(~failed & ~bad)], names=[*keep, *own])

    return joined.mapInArrow(judge, schema)
