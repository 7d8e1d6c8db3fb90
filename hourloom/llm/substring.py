"""Substring dedup: suffix automata of reference shards, matching statistics.

A word is removed when a window of 13 consecutive words that covers it also
starts in a document with a smaller id.  Windows are judged on the input.

The reference is the corpus itself, so broadcasting an automaton of each part
to every task would stream every document past every part.  Instead the parts
are cut by content: texts that can share a window (equal anchor keys, see
``repeats``) go to the same reference shard, and only those are streamed past
its automaton.  A shard is a bounded batch of whole keys; its generalised
suffix automaton over words is built in one task, carries the smallest
document id of every state, and is dropped when the batch is done.  Streaming
a text gives its matching statistics; where 13 or more words match, the state
of the 13-word suffix names the first document that has the window.

A key with one text under it (only exact copies of that run) needs no automaton:
its first document has every window.  A key whose texts are more than one shard's worth is matched part by part: all
its texts stream past the automaton of each part, and the smallest id wins.
A key with over ``HOT_CLASSES`` texts builds no automaton: its windows are decided
by 128-bit hashes of their words, and equal digests count as equal texts.

Defined cases: null or blank texts have no words; fewer than 13 words are
kept; rows with equal id never remove from one another; a null id counts as
the largest; repeated rows (same id, same text) get the same verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import keyed, land, plain_columns, replaced, sized, texts
from hourloom.llm.repeats import class_texts, judged, lo, per_document, repeated_runs, starts_of_run

MIN_WORDS = 13
ANCHOR_WORDS = 5
#: Bytes of reference text per shard: about 60,000 words, some 30 MB as an automaton.
SHARD_BYTES = 400_000


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences; every state keeps the
    smallest owner id of the sequences in which its strings end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner = [2**63 - 1]

    def _clone(self, q: int, length: int) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(length)
        self.owner.append(2**63 - 1)
        return len(self.link) - 1

    def add(self, symbols: list, owner: int) -> None:
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for c in symbols:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    clone = self._clone(q, length[last] + 1)
                    link[q] = clone
                    p = last
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    last = clone
            else:
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                owners.append(2**63 - 1)
                cur = len(link) - 1
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    if length[q] == length[p] + 1:
                        link[cur] = q
                    else:
                        clone = self._clone(q, length[p] + 1)
                        link[q] = link[cur] = clone
                        while p >= 0 and nxt[p].get(c) == q:
                            nxt[p][c] = clone
                            p = link[p]
                last = cur
            if owner < owners[last]:
                owners[last] = owner

    def close(self) -> None:
        """Hands the smallest owners up the suffix links, longest states first."""
        link, owners = self.link, self.owner
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            p = link[v]
            if owners[v] < owners[p]:
                owners[p] = owners[v]

    def first_owners(self, symbols: list, least: int) -> list[int]:
        """For each window of ``least`` symbols, the smallest owner that has it
        (2**63 - 1: none), from the matching statistics of the sequence."""
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        out, v, matched = [], 0, 0
        for i, c in enumerate(symbols):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                matched += 1
            while length[link[v]] >= least if v else False:  # the state of the last `least` symbols
                v = link[v]
                matched = length[v]
            if i >= least - 1:
                out.append(owners[v] if matched >= least else 2**63 - 1)
        return out


def _first_owners(group: list[tuple], least: int, shard_bytes: int) -> Iterator[tuple]:
    """(key, digest, firsts) of the texts of a group of whole keys."""
    words = [row[6].split(b" ") for row in group]
    best: list[list[int]] = []
    at = 0
    while at < len(group):
        shard, size = SuffixAutomaton(), 0
        while at < len(group) and (size < 2 * shard_bytes):
            shard.add(words[at], group[at][2])
            size += len(group[at][6])
            at += 1
        shard.close()
        found = [shard.first_owners(w, least) for w in words]
        best = [list(map(min, a, b)) for a, b in zip(best, found, strict=True)] if best else found
    for row, firsts in zip(group, best, strict=True):
        yield row[0], row[1], firsts


@plain_columns
def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                   anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """The operator: input rows plus ``n_words``, ``n_removed``, ``removed_spans``
    (list of [first word, word after the last]) and ``kept_text``."""
    own = ["n_words", "n_removed", "removed_spans", "kept_text"]
    keep = replaced(docs, own)
    base = keyed(docs.select(*[F.col(f"`{c}`") for c in keep]), id_col, text_col)
    ids = [F.min("_c_id").alias("first"), F.max("_c_id").alias("final")]
    runs = repeated_runs(base, "words", min_words, anchor_words, ids, F.col("first") < F.col("final"), "substring")
    several = runs.where(~F.col("same")).drop("first")
    cold, hot = class_texts(base, several, "words", min_words, "substring")
    firsts = judged(cold, lambda g: _first_owners(g, min_words, SHARD_BYTES),
                    "key long, digest long, firsts array<long>", [pa.int64(), pa.int64(), pa.list_(pa.int64())], SHARD_BYTES)
    late = F.filter(F.transform("firsts", lambda f, j: F.when(f < F.col("_c_id"), lo() + j)), lambda x: x.isNotNull())
    marks = several.join(firsts, ["key", "digest"]).select("_c_id", "_c_hash", late.alias("s")).where(F.size("s") > 0)
    first = hot.groupBy("h1", "h2").agg(F.min("first").alias("f"))
    first = land(hot.join(first, ["h1", "h2"]).select("key", "digest", "j", "f"), "substring-hot")
    hot_marks = several.join(first, ["key", "digest"]).where(F.col("f") < F.col("_c_id"))
    marks = marks.unionByName(hot_marks.select("_c_id", "_c_hash", F.array(lo() + F.col("j")).alias("s")))
    alone = runs.where(F.col("same") & (F.col("first") < F.col("_c_id")))  # one text under the key: its first document has every window
    marks = marks.unionByName(alone.select("_c_id", "_c_hash", F.sequence(lo(), lo() + starts_of_run() - 1).alias("s")))
    rows = per_document(base, marks, "s").select(*[F.col(f"`{c}`") for c in keep], "_c_text", "_c_marks")
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept_text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "_c_text"):
            marks = b.column("_c_marks")
            cols: list[list] = [[], [], [], []]
            for i, raw in enumerate(texts(b, "_c_text")):
                words = raw.split()
                spans = cover_spans(marks[i].as_py() or [], min_words)
                kept, at = [], 0
                for s, e in spans:
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                for col, v in zip(cols, (len(words), len(words) - len(kept), spans, b" ".join(kept).decode()), strict=True):
                    col.append(v)
            ints = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(cols[0], ints), pa.array(cols[1], ints), pa.array(cols[2], pa.list_(pa.list_(ints))), pa.array(cols[3], pa.string())],
                names=[*keep, *own])

    return rows.mapInArrow(cut, schema)


def cover_spans(starts: list[int], length: int) -> list[list[int]]:
    """Maximal spans covered by windows of ``length`` at the given starts."""
    spans: list[list[int]] = []
    for s in sorted(set(starts)):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = s + length
        else:
            spans.append([s, s + length])
    return spans
