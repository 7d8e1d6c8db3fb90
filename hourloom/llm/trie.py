"""Conversation prefix trie: double-array tries per prefix shard.

Every distinct sequence of the first d turns is a node.  Sequences are cut
into segments of at most ``SEGMENT`` turns, equal segments behind equal
prefixes collapse, and segments are dealt to shards by their prefix and first
turn (a first turn with more turns than a shard: by the whole segment), so
that most shared prefixes meet in one shard.  A shard numbers its distinct
turns densely, packs its segments into one double array (BASE: where a node's
children start; CHECK: whose child a slot is) and walks all segments through
it to count its nodes.  Nodes that several shards share (the upper ones, and
those of a dealt-out first turn) are merged globally by the 128-bit digest of
their prefix.  Sums over subtrees take a second walk: every node is owned by
one shard, shards add up their own nodes from the leaves to the top, and the
parts of shared nodes are added again; segments are done from the deepest
level up, each handing its total to the node that it hangs from.

A prefix digest is the exclusive or over its turns of two 64-bit hashes of
(SHA-256 of the turn, place), so it needs no pass along a conversation.

Defined cases: null turns come first, rows alike in turn are ordered by role,
then text; a null role or text is empty; a null conversation id is one
conversation, a member after all others with the empty text as its decimal id;
a conversation without turns is a member of the root alone; other columns are
ignored; an empty table has no node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.common import land
from hourloom.llm.turns import WORD, conversation_key, numbered, runs, streamed_sha256

#: Turns of a segment, and distinct turns with their places of a shard.
SEGMENT = 256
SHARD_TURNS = 100_000
LAST = 2**63 - 1


def _zero() -> Column:
    return F.lit(0).cast("long")


class DoubleArray:
    """A trie over sequences of symbols 1..m in two integer arrays.

    The child of node s by symbol c is slot t = BASE[s] + c if CHECK[t] = s;
    slot 0 is the root.  A slot that is free has CHECK -1.
    """

    def __init__(self, sequences: list[np.ndarray], symbols: int):
        self.base = np.zeros(2 * symbols + 2, np.int64)
        self.check = np.full(2 * symbols + 2, -1, np.int64)
        self.check[0] = 0
        self._free = 1
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].tolist())
        seqs = [sequences[i].tolist() for i in order]
        level = [(0, 0, len(seqs))]  # node, range of the sequences that reach it
        depth = 0
        while level:
            below = []
            for node, lo, hi in level:
                while lo < hi and len(seqs[lo]) <= depth:
                    lo += 1
                children, at = [], lo
                while at < hi:
                    c, end = seqs[at][depth], at
                    while end < hi and seqs[end][depth] == c:
                        end += 1
                    children.append((c, at, end))
                    at = end
                if children:
                    b = self._place([c for c, _, _ in children])
                    self.base[node] = b
                    for c, s, e in children:
                        self.check[b + c] = node
                        below.append((b + c, s, e))
            level, depth = below, depth + 1

    def _place(self, symbols: list[int]) -> int:
        """Least base at or after the first free slot where all symbols fit."""
        while self._free < len(self.check) and self.check[self._free] >= 0:
            self._free += 1
        codes = np.array(symbols, np.int64)
        b = max(0, self._free - symbols[0])
        while True:
            while b + symbols[-1] + 1 >= len(self.check):
                self.base = np.concatenate([self.base, np.zeros_like(self.base)])
                self.check = np.concatenate([self.check, np.full_like(self.check, -1)])
            if (self.check[b + codes] < 0).all():
                return b
            later = np.flatnonzero(self.check[b + symbols[0] + 1:] < 0)  # the next free slot for the first symbol
            b = b + 1 + int(later[0]) if len(later) else len(self.check) - symbols[0]

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of the nodes by the symbols."""
        to = self.base[nodes] + symbols
        if not (self.check[to] == nodes).all():
            raise KeyError("no such child")
        return to


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key after another (sorted input), each at once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        at = runs(b.column(key).to_numpy(zero_copy_only=False))
        for s, e in zip(at[:-1], at[1:], strict=True):
            part = b.slice(int(s), int(e - s))
            if held and held[0].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


_NODES = ("shard long, slot long, up long, seg long, depth long, d1 long, d2 long, p1 long, p2 long, n long, low long, words long, child boolean, top boolean")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's segments -> its nodes.  A segment's first symbol stands for
    the prefix it hangs from, so a shard may hold segments of many prefixes."""
    names = [x.split()[0] for x in _NODES.split(", ")]
    for t in _grouped(batches, "shard"):
        t = t.combine_chunks()
        col = lambda c: t.column(c).to_numpy()
        turns = t.column("turns").combine_chunks()
        at = turns.offsets.to_numpy()
        flat = [turns.values.field(i).to_numpy(zero_copy_only=False) for i in range(4)]  # place, two hashes of the turn, words
        if at[0]:
            flat, at = [x[at[0]:at[-1]] for x in flat], at - at[0]
        size = np.diff(at)
        prefix = np.stack([col("seg"), col("r1"), col("r2")], axis=1)
        tops, top_of = np.unique(prefix, axis=0, return_inverse=True)
        distinct, symbol = np.unique(np.stack(flat[1:3], axis=1), axis=0, return_inverse=True)  # the turns' dense ids
        symbol, top_of = symbol.ravel() + len(tops) + 1, top_of.ravel() + 1
        trie = DoubleArray([np.concatenate(([r], symbol[s:e])) for r, s, e in zip(top_of, at[:-1], at[1:], strict=True)], len(tops) + len(distinct))
        n = len(trie.check)
        count, low, words, depth = np.zeros(n, np.int64), np.full(n, LAST), np.zeros(n, np.int64), np.full(n, -1)
        digest, seg, child = np.zeros((n, 2), np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        weight, smallest = col("n"), col("low")
        live, place = np.arange(len(size)), 0
        nodes = trie.step(np.zeros(len(size), np.int64), top_of)
        top = np.zeros(n, bool)
        top[nodes] = True
        seg[nodes], depth[nodes], digest[nodes] = prefix[:, 0], flat[0][at[:-1]], prefix[:, 1:]
        while len(live):
            live, nodes = (x[size[live] > place] for x in (live, nodes))
            i = at[live] + place
            below = trie.step(nodes, symbol[i])
            child[nodes] = True
            np.add.at(count, below, weight[live])
            np.minimum.at(low, below, smallest[live])
            words[below], seg[below], depth[below] = flat[3][i], prefix[live, 0], flat[0][i] + 1
            digest[below] = digest[nodes] ^ np.stack([flat[1][i], flat[2][i]], axis=1)
            nodes, place = below, place + 1
        slots = np.flatnonzero(depth >= 0)
        up = np.where(top[slots], -1, trie.check[slots])
        cols = [np.full(len(slots), t.column("shard")[0].as_py()), slots, up, seg[slots], depth[slots], digest[slots, 0], digest[slots, 1],
                np.where(top[slots], 0, digest[up, 0]), np.where(top[slots], 0, digest[up, 1]), count[slots], low[slots], words[slots], child[slots], top[slots]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


_SUMS = "d1 long, d2 long, depth long, n_leaves long, saved_tokens long, top boolean"


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's nodes with their own parts -> sums over its part of each subtree."""
    for t in _grouped(batches, "shard"):
        slot, up, depth = (t.column(c).to_numpy() for c in ("slot", "up", "depth"))
        sums = [t.column(c).to_numpy().copy() for c in ("leaf", "saved")]
        order = np.argsort(slot, kind="stable")
        parent = np.where(up < 0, 0, order[np.searchsorted(slot, up, sorter=order).clip(0, len(slot) - 1)])
        for d in range(int(depth.max()), -1, -1):
            at = np.flatnonzero((depth == d) & (up >= 0))
            for s in sums:
                np.add.at(s, parent[at], s[at])
        names = ["d1", "d2", "depth", "n_leaves", "saved_tokens", "top"]
        yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in names[:3]), *map(pa.array, sums), t.column("top").combine_chunks()], names=names)


def _hashes(turn: Column, place: Column) -> tuple[Column, Column]:
    return F.xxhash64(turn, place), F.xxhash64(place, turn, F.lit("second"))


def prefix_trie(turns: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The operator.  ``turns``: (conv, place from 0 without gaps, role, text)
    without nulls but in conv; ``conversations``: every conv once.  Gives a row
    per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    turn = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    rows = turns.select(F.col(conv_col).alias("conv"), F.col("place").cast("long").alias("place"), turn.alias("t"),
                        F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"))).cast("long").alias("words"))
    h1, h2 = _hashes(F.col("t"), F.col("place"))
    rows = rows.select("conv", "place", h1.alias("h1"), h2.alias("h2"), "words", F.floor(F.col("place") / SEGMENT).cast("long").alias("seg"),
                       conversation_key(F.col("conv")).alias("key"))
    segs = rows.groupBy("key", "seg").agg(F.min("conv").alias("conv"), F.sort_array(F.collect_list(F.struct("place", "h1", "h2", "words"))).alias("turns"),
                                          F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))  # at most SEGMENT turns
    before = Window.partitionBy("key").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)  # a row per segment, no turns kept
    lanes = [F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(r) for x, r in (("x1", "r1"), ("x2", "r2"))]
    segs = land(segs, "trie-segments")
    heads = land(segs.select("key", "seg", "conv", "x1", "x2", *lanes), "trie-heads")

    ends = heads.groupBy("key").agg(F.bit_xor("x1").alias("d1"), F.bit_xor("x2").alias("d2"))
    members = conversations.select(F.col(conv_col).alias("conv"), conversation_key(F.col(conv_col)).alias("key")).join(ends, "key", "left")
    members = land(members.select("conv", F.coalesce("d1", _zero()).alias("d1"), F.coalesce("d2", _zero()).alias("d2")), "trie-members")
    last = streamed_sha256(members.select("d1", "d2", F.col("conv").isNull().alias("z"), "conv", F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("line")),
                           ["d1", "d2"], ["z", "conv"], "line", ",").withColumnRenamed("sha256", "ends_sha256")

    alike = ["seg", "r1", "r2", "x1", "x2"]
    kinds = heads.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("conv", F.lit(LAST))).alias("low"), F.min("key").alias("key"))
    kinds = kinds.join(segs.select("key", "seg", "turns"), ["key", "seg"]).drop("key")
    first = F.xxhash64("seg", "r1", "r2", F.col("turns")[0]["h1"])
    kinds = land(kinds.withColumn("first", first), "trie-kinds")
    size = F.sum(F.size("turns").cast("long"))
    total = kinds.agg(size.alias("s")).first()["s"] or 0
    shards = max(1, -(-total // SHARD_TURNS))
    hot = land(kinds.groupBy("first").agg(size.alias("s")).where(F.col("s") > SHARD_TURNS // 2).select("first", F.lit(True).alias("hot")), "trie-hot")
    kinds = kinds.join(hot, "first", "left")
    dealt = F.when(F.col("hot"), F.xxhash64("first", "x1", "x2")).otherwise(F.xxhash64("first"))
    kinds = kinds.select(F.pmod(dealt, F.lit(shards)).cast("long").alias("shard"), "seg", "r1", "r2", "n", "low", "turns")
    nodes = land(kinds.repartition("shard").sortWithinPartitions("shard").mapInArrow(_walk, _NODES), "trie-nodes")

    name = ["d1", "d2", "depth"]
    own = nodes.where(~F.col("top"))
    merged = own.groupBy(*name).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("words").alias("words"), F.max("child").alias("child"),
                                    F.min("shard").alias("owner"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    deeper = nodes.where(F.col("top") & (F.col("seg") > 0)).select(*name).distinct().withColumn("more", F.lit(True))  # segments that hang from a node
    merged = land(merged.join(deeper, name, "left").withColumn("child", F.col("child") | F.col("more").isNotNull()).drop("more"), "trie-merged")
    owned = F.col("owner") == F.col("shard")
    parts = nodes.join(merged.select(*name, "owner", F.when(F.col("child"), 0).otherwise(1).alias("l"), ((F.col("n") - 1) * F.col("words")).alias("s")), name, "left")
    parts = land(parts.select("shard", "slot", "up", "seg", *name, "top", *[F.when(owned & ~F.col("top"), F.col(c)).otherwise(0).cast("long").alias(a)
                                                                        for c, a in (("l", "leaf"), ("s", "saved"))], (owned & ~F.col("top")).alias("mine")), "trie-parts")
    levels = (parts.agg(F.max("seg").alias("m")).first()["m"] or 0) + 1 if total else 0
    sums, below = None, None
    for level in range(levels - 1, -1, -1):
        part = parts.where(F.col("seg") == level)
        if below is not None:  # what hangs from the nodes of this level, counted by their owners
            part = part.join(below, name, "left").withColumns({a: F.col(a) + F.when(F.col("mine"), F.coalesce(b, F.lit(0))).otherwise(0)
                                                               for a, b in (("leaf", "b_leaves"), ("saved", "b_saved"))})
        part = part.select("shard", "slot", "up", *name, "top", "leaf", "saved")
        found = part.repartition("shard").sortWithinPartitions("shard").mapInArrow(_sum_up, _SUMS)
        found = land(found.groupBy(*name, "top").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "trie-sums")
        below = found.where("top").select(*name, F.col("n_leaves").alias("b_leaves"), F.col("saved_tokens").alias("b_saved"))
        inner = found.where(~F.col("top")).drop("top")
        sums = inner if sums is None else sums.unionByName(inner)

    root = members.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(_zero().alias("d1"), _zero().alias("d2"), _zero().alias("depth"), "n_convs", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"))
    if sums is None:
        return (root.withColumns({"n_children": _zero(), "n_leaves": _zero() + 1, "saved_tokens": _zero()}).join(last, ["d1", "d2"], "left").transform(_columns))
    id_of = F.when(F.col("low") < LAST, F.col("low"))
    inner = merged.join(sums, name).select(*name, F.col("n").alias("n_convs"), id_of.alias("conv_id"), "n_leaves", "saved_tokens", "p1", "p2")
    inner = land(inner, "trie-inner")
    above = root.select("d1", "d2", "depth", "conv_id").unionByName(inner.select("d1", "d2", "depth", "conv_id"))
    above = above.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    up = ["p1", "p2", "depth"]
    children = inner.groupBy(*up).agg(F.count(F.lit(1)).alias("n_children")).select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), (F.col("depth") - 1).alias("depth"), "n_children")
    inner = inner.join(above, up).drop("p1", "p2")
    root = root.join(below.select(*name, F.col("b_leaves").alias("n_leaves"), F.col("b_saved").alias("saved_tokens")), name)
    out = inner.unionByName(root).join(land(children, "trie-children"), name, "left").withColumn("n_children", F.coalesce("n_children", _zero()))
    return out.join(last, ["d1", "d2"], "left").transform(_columns)


def _columns(nodes: DataFrame) -> DataFrame:
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def ordered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, total, role, text): turns numbered in order, nulls empty."""
    q = [F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col)]
    rows = rows.select(q[0].alias("conv_id"), q[1].alias("turn"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(q[2:], ("role", "text"), strict=True)],
                       conversation_key(q[0]).alias("_c_conv"))
    rows = numbered(rows, "_c_conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "trie-turns")
    return rows.select("conv_id", F.col("_c_pos").alias("place"), F.col("_c_total").alias("total"), "role", "text")


def rebuilt(rows: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations of the table in which conversation c begins with
    the first h = crc32(c) % ``most`` turns of conversation c - c % ``group``
    and goes on with its own turns after its first h.  A null id stays as it is."""
    turns = land(ordered_turns(rows), "trie-ordered")
    convs = land(turns.where("place = 0").select("conv_id", F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, F.lit(0)).alias("h"),
                                                 (F.col("conv_id") - F.col("conv_id") % group).alias("of"), conversation_key(F.col("conv_id")).alias("k")), "trie-convs")
    heads = turns.where(F.col("place") < most - 1).where(F.col("conv_id") % group == 0)
    heads = heads.select(F.col("conv_id").alias("of"), "place", F.col("total").alias("given"), "role", "text")
    lengths = heads.where("place = 0").select("of", "given")
    convs2 = land(convs.join(lengths, "of", "left").withColumn("given", F.coalesce(F.least("given", "h"), F.lit(0))), "trie-lengths")
    taken = convs2.where("h > 0").join(heads.drop("given"), "of").where(F.col("place") < F.col("h")).select("conv_id", "place", "role", "text")
    own = turns.withColumn("k", conversation_key(F.col("conv_id"))).join(convs2.select("k", "h", "given"), "k").where(F.col("place") >= F.col("h"))
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("place"), "role", "text")
    return taken.unionByName(own), convs.select("conv_id")
