"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 not toxic but of low quality, 2 good.  One weight vector
over hashed text features is shared by all grades and ordered thresholds cut
its score: P(grade <= k) = logistic(threshold_k - score).  The expected grade
and the tail probability P(grade = 2) select documents.

Features are hashed text: the distinct lower-case words of the whole text
without outer punctuation, the distinct symbol remainders of its words, and a
few tokens that state the text's shape (share of distinct words, of repeated
lines, of words with symbols, and length).  The penalty is an absolute one in
proportion to the square root of a feature's documents, about the noise of its
gradient, so features that say nothing get no weight.  The model is fitted on a bounded sample of labelled rows (``SAMPLE`` at most in
expectation, chosen by a hash of the id); features seen in fewer than ``MIN_DOCS``
sampled documents carry no weight.  All documents are scored whole, map-only.

Defined cases: a null or blank text has no feature and the score 0; labels
with a null id or grade are not used; a document with several labels takes
its lowest grade; without labels every document gets the same score and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import plain_columns, replaced, sized, texts

#: Bound of the labelled sample; feature space; least documents of a feature.
SAMPLE = 6_000
FEATURE_BITS = 18
MIN_DOCS = 4
GRADES = 3
#: A document is kept when P(grade = 2) is at least this.
KEEP_TAIL = 0.5
ROUNDS, STEP, ABSOLUTE_PENALTY, SQUARE_PENALTY = 300, 0.3, 0.15, 0.1

_MASK = (1 << FEATURE_BITS) - 1
_PLAIN = bytes([*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 0x100)])
_PUNCTUATION = b".,;:!?'\"()-"
_OUTER = _PUNCTUATION + b"|#*$%&<>"


def features(text: bytes) -> np.ndarray:
    """Hashed feature numbers of a text, distinct and sorted."""
    every = text.lower().split()
    if not every:
        return np.zeros(0, np.int64)
    words, n = set(every), len(every)
    names = {w.strip(_OUTER) for w in words} | {b"\x00" + s for w in words if (s := w.translate(None, _PLAIN))}
    names.discard(b"")
    lines = [x for x in text.split(b"\n") if x.strip()]
    odd = sum(1 for w in every if w.translate(None, _PLAIN + _PUNCTUATION))
    names |= {b"\x01u%d" % (20 * len(words) // n), b"\x01n%d" % n.bit_length(), b"\x01s%d" % (10 * odd // n),
              b"\x01d%d" % (10 * (len(lines) - len(set(lines))) // len(lines))}
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(w) & _MASK for w in names), np.int64, len(names)))


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows]) if rows else np.zeros(0)

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k = 0 .. GRADES - 2, one row per score."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray) -> OrdinalModel:
    """Full-batch proximal AdaGrad on the penalised likelihood."""
    weights, cuts = np.zeros(1 << FEATURE_BITS), np.array([-2.0, 0.0])  # first threshold, log of the gap
    if not rows:
        return OrdinalModel(weights, np.array([-2.0, -1.0]))
    flat = np.concatenate(rows)
    times = np.bincount(flat, minlength=len(weights))
    names = np.flatnonzero(times >= MIN_DOCS)
    place = np.full(len(weights), -1)
    place[names] = np.arange(len(names))
    rows_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used = place[flat] >= 0
    flat, rows_of = place[flat][used], rows_of[used]
    n, w = len(rows), np.zeros(len(names))
    past_w, past_c = np.full(len(names), 1e-8), np.full(2, 1e-8)
    absolute = ABSOLUTE_PENALTY * np.sqrt(times[names])
    for _ in range(ROUNDS):
        s = np.bincount(rows_of, weights=w[flat], minlength=n)
        t = np.array([cuts[0], cuts[0] + np.exp(cuts[1])])
        sig = 1 / (1 + np.exp(-np.clip(t[None, :] - s[:, None], -40, 40)))
        upper = np.where(grades == 0, sig[:, 0], np.where(grades == 1, sig[:, 1], 1.0))
        lower = np.where(grades == 0, 0.0, np.where(grades == 1, sig[:, 0], sig[:, 1]))
        p = np.maximum(upper - lower, 1e-9)
        g = np.bincount(flat, weights=(1 - upper - lower)[rows_of], minlength=len(names)) + SQUARE_PENALTY * w
        up, low = -upper * (1 - upper) / p, lower * (1 - lower) / p
        g0 = np.where(grades == 0, up, 0).sum() + np.where(grades == 1, low, 0).sum()
        g1 = np.where(grades == 1, up, 0).sum() + np.where(grades == 2, low, 0).sum()
        gc = np.array([g0 + g1, g1 * np.exp(cuts[1])])
        past_w += g * g
        past_c += gc * gc
        rate = STEP / np.sqrt(past_w)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * absolute, 0)
        cuts = cuts - STEP * gc / np.sqrt(past_c)
    weights[names] = w
    return OrdinalModel(weights, np.array([cuts[0], cuts[0] + np.exp(cuts[1])]))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
                    held_out: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of about ``sample`` labelled documents (or, held out,
    of about as many others); of rows with one id, the one with the smallest
    text hash."""
    rated = labels.select(F.col(id_col).alias("_c_id"), grade(F.col("quality"), F.col("toxic")).alias("_c_grade"))
    rated = rated.where(F.col("_c_id").isNotNull() & F.col("_c_grade").isNotNull()).groupBy("_c_id").agg(F.min("_c_grade").alias("_c_grade"))
    n = rated.count()
    share = min(1.0, sample / max(n, 1)) * (0.5 if held_out else 1.0)
    spot = F.pmod(F.xxhash64("_c_id", F.lit(5)), F.lit(1_000_000)) / 1e6
    picked = rated.where((spot >= 0.5) & (spot < 0.5 + share) if held_out else spot < share)
    rows = docs.select(F.col(id_col).alias("_c_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_c_text")).join(picked, "_c_id")
    one = F.min(F.struct(F.xxhash64("_c_text").alias("_c_hash"), "_c_text")).alias("_c_one")
    rows = rows.groupBy("_c_id", "_c_grade").agg(one).select("_c_id", "_c_grade", F.col("_c_one._c_text").alias("_c_text"))  # one row per id

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "_c_text"):
            yield pa.RecordBatch.from_arrays([b.column("_c_id"), b.column("_c_grade"), pa.array([features(x) for x in texts(b, "_c_text")], pa.list_(pa.int64()))],
                                             names=["id", "grade", "features"])

    got = rows.select("_c_id", "_c_grade", "_c_text").mapInArrow(go, "id long, grade int, features array<long>").toArrow()  # bounded by `sample`
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    found = [np.array(x, np.int64) for x in got.column("features").to_pylist()]
    return [found[i] for i in order], got.column("grade").to_numpy()[order]


def rate_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
                   keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The operator: input rows without the text plus ``score``, ``expected_grade``,
    ``tail_probability`` and ``kept``."""
    return score_documents(docs, fit(*labelled_sample(docs, labels, sample, id_col, text_col)), text_col, keep_tail)


@plain_columns
def score_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep_tail: float = KEEP_TAIL) -> DataFrame:
    """``rate_documents`` with a model that is there already."""
    own = ["score", "expected_grade", "tail_probability", "kept"]
    keep = [c for c in replaced(docs, own) if c != text_col]
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 1 MB, whatever the input
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_c_text"))
    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema.add("score", "double").add("expected_grade", "double").add("tail_probability", "double").add("kept", "boolean")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = OrdinalModel(*sent.value)
        for b in sized(batches, "_c_text"):
            s = m.scores([features(x) for x in texts(b, "_c_text")]).astype(np.float64)
            low = m.at_most(s)
            tail = 1 - low[:, -1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s), pa.array((1 - low).sum(axis=1)), pa.array(tail), pa.array(tail >= keep_tail)],
                                             names=[*keep, *own])

    return rows.mapInArrow(go, schema)
