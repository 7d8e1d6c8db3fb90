"""Conversation structure repair: square-root checkpointed dynamic programming.

A conversation should read ``(s?(ua)+)?`` by the first letters of its roles.
Its rows are kept, reroled to user or assistant, deleted, and empty user or
assistant turns inserted at least cost; of several cheapest edit scripts the
ASCII-least is taken.  The program over n rows has four states (start, after
system, after user, after assistant) and runs backward:

1. a conversation is cut into blocks of about sqrt(n) rows; each block gives
   the 4 x 4 least costs from its entry to its exit state;
2. these are chained backward into the state-cost vectors at the blocks'
   starts, the checkpoints, the only vectors that are stored;
3. each block recomputes its inner vectors from the checkpoint behind it and
   walks forward from every entry state, taking the ASCII-least tight edit;
   the exits, chained forward, name the entry state that counts.

Blocks run as Spark rows in parallel, the two chains see sqrt(n) small rows of
a conversation, so a conversation with a third of all rows is spread too.

Faults, the first of which counts: blank (no word character), duplicate (role
and text occur earlier in the conversation), truncated (the last non-blank
character is not one of ``.!?``).  Blank and duplicate rows must be deleted.

Defined cases: a null role or text is one space; null turns come first; rows
alike in turn are ordered by role, then text (bytes), equal rows are repeats;
a null conversation id is a conversation of its own; a role with another first
letter than s, u, a (or none) cannot be kept as it is; other columns are
ignored; an empty table gives no conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import land
from hourloom.llm.turns import BLANKS, conversation_key, numbered, streamed_sha256

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Least rows of a block: shorter conversations are one block.
BLOCK = 256
START, SYSTEM, USER, ASSISTANT = range(4)
_INF = 1 << 60
#: A row's code: role class (0 system, 1 user, 2 assistant, 3 other) + 4 x fault (0 none, 1 must go, 2 truncated).
_NEXT = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}
_FILL = (USER, USER, ASSISTANT, USER)  # what an inserted or reroled turn leads to
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Cost to go behind the last row, inserts included.
END = (0, 2 * INSERT, INSERT, 0)


def _edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that consume a row, ASCII order."""
    role, fault = code & 3, code >> 2
    out = [("D", DELETE, state)]
    if fault != 1:
        more = TRUNCATED if fault == 2 else 0
        if state in _NEXT[role]:
            out.append(("K", more, _NEXT[role][state]))
        out.append(("R", REROLE + more, _FILL[state]))
    return out


_EDITS = [[_edits(c, s) for s in range(4)] for c in range(12)]


def _closed(v: list[int]) -> tuple[int, int, int, int]:
    """Costs once turns may also be inserted before the next row."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant


def _back(code: int, after: tuple) -> tuple[int, int, int, int]:
    """Cost to go before a row from that behind it."""
    return _closed([min(cost + after[to] for _, cost, to in _EDITS[code][s]) for s in range(4)])


def block_costs(codes: list[int]) -> list[int]:
    """Least cost from each entry to each exit state (row by row, 16 numbers)."""
    columns = []
    for e in range(4):
        v = tuple(0 if s == e else _INF for s in range(4))
        for c in reversed(codes):
            v = _back(c, v)
        columns.append(v)
    return [min(columns[e][s], _INF) for s in range(4) for e in range(4)]


def walk(codes: list[int], exit_costs: tuple, state: int, last: bool) -> tuple[str, int]:
    """ASCII-least tight edits of a block from an entry state, and the exit
    state; the inserts behind the last row belong to the last block."""
    costs = [tuple(exit_costs)]
    for c in reversed(codes):
        costs.append(_back(c, costs[-1]))
    costs.reverse()
    out, i, n = [], 0, len(codes)
    while True:
        left = costs[i][state]
        if left >= _INF:
            return "", state  # an entry state that no script reaches the end from
        letter, to = None, state
        if i < n:
            tight = {x: t for x, cost, t in _EDITS[codes[i]][state] if cost + costs[i + 1][t] == left}
        elif not last or left == 0:
            return "".join(out), state
        else:
            tight = {}
        if INSERT + costs[i][_FILL[state]] == left:
            tight["I"] = _FILL[state]
        letter = min(tight)
        to = tight[letter]
        out.append(letter)
        i += letter != "I"
        state = to


def chain_back(matrices: list[list[int]]) -> list[tuple]:
    """The checkpoints: cost to go at each block's start, and at the end."""
    out = [END]
    for m in reversed(matrices):
        v = out[-1]
        out.append(tuple(min(min(m[4 * s + e] + v[e] for e in range(4)), _INF) for s in range(4)))
    return out[::-1]


@dataclass
class Repaired:
    """``report``: a row per conversation; ``edits``: (_c_conv, _c_block,
    audit) in order; ``lines``: the repaired turns with their order."""
    report: DataFrame
    edits: DataFrame
    lines: DataFrame


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: cost matrix, illegal neighbours inside, first and last role class."""
    schema = [("_c_conv", pa.string()), ("_c_block", pa.int64()), ("m", pa.list_(pa.int64())), ("bad", pa.int64()), ("head", pa.int32()), ("tail", pa.int32())]
    for b in batches:
        rows = []
        for conv, block, codes in zip(*(c.to_pylist() for c in b.select(["_c_conv", "_c_block", "codes"]).columns), strict=True):
            roles = [c & 3 for c in codes]
            bad = sum(x not in _LEGAL for x in zip(roles, roles[1:], strict=False))
            rows.append((conv, block, block_costs(codes), bad, roles[0], roles[-1]))
        yield _table(schema, rows)


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation (its blocks in order): a row per block with the costs
    at its end; illegal neighbours over all and the least cost."""
    schema = [("_c_conv", pa.string()), ("_c_block", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_()), ("illegal", pa.int64()), ("cost", pa.int64())]
    for b in batches:
        rows = []
        for conv, blocks in zip(b.column("_c_conv").to_pylist(), b.column("blocks").to_pylist(), strict=True):
            points = chain_back([x["m"] for x in blocks])
            bad = sum(x["bad"] for x in blocks) + sum((x["tail"], y["head"]) not in _LEGAL for x, y in zip(blocks, blocks[1:], strict=False))
            rows += [(conv, i, list(points[i + 1]), i + 1 == len(blocks), bad, points[0][START]) for i in range(len(blocks))]
        yield _table(schema, rows)


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: audit and exit state from each entry state (the first block: start)."""
    schema = [("_c_conv", pa.string()), ("_c_block", pa.int64()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32()))]
    names = ["_c_conv", "_c_block", "codes", "after", "last"]
    for b in batches:
        rows = []
        for conv, block, codes, after, last in zip(*(c.to_pylist() for c in b.select(names).columns), strict=True):
            found = [walk(codes, after, s, last) for s in (range(4) if block else (START,))]
            rows.append((conv, block, [f[0] for f in found], [f[1] for f in found]))
        yield _table(schema, rows)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: the entry state of each block."""
    schema = [("_c_conv", pa.string()), ("_c_block", pa.int64()), ("state", pa.int32())]
    for b in batches:
        rows = []
        for conv, blocks in zip(b.column("_c_conv").to_pylist(), b.column("blocks").to_pylist(), strict=True):
            state = START
            for i, x in enumerate(blocks):
                rows.append((conv, i, state))
                state = x["exits"][state]
        yield _table(schema, rows)


def _script(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per edit that leaves a turn: its number, the row it uses (none: inserted), its new role (none: as it was)."""
    schema = [("_c_conv", pa.string()), ("_c_block", pa.int64()), ("_c_edit", pa.int64()), ("_c_at", pa.int64()), ("_c_role", pa.string())]
    for b in batches:
        rows = []
        for conv, block, state, audit, codes in zip(*(c.to_pylist() for c in b.select(["_c_conv", "_c_block", "state", "audit", "codes"]).columns), strict=True):
            at = 0
            for n, letter in enumerate(audit):
                if letter == "K":
                    rows.append((conv, block, n, at, None))
                    state = _NEXT[codes[at] & 3][state]
                elif letter != "D":
                    state = _FILL[state]
                    rows.append((conv, block, n, None if letter == "I" else at, _ROLE[state]))
                at += letter != "I"
        yield _table(schema, rows)


def _block_size(total: Column) -> Column:
    return F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(total))).cast("long")


def _fault(text: Column, first: Column) -> Column:
    """blank / duplicate / truncated / null; ``first``: no equal row earlier."""
    trimmed = F.rtrim(text, F.lit(BLANKS))
    return (F.when(trimmed == "", "blank").when(~first, "duplicate")
            .when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated"))


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """The operator.  The report has ``_c_conv`` (see ``conversation_key``) and
    gaps, blank, duplicate, truncated, illegal, cost (longs)."""
    q = [F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col)]
    rows = rows.select(conversation_key(q[0]).alias("_c_conv"), q[1].alias("turn"), F.coalesce(q[2].cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(q[3].cast("string"), F.lit(" ")).alias("text"))
    rows = rows.withColumn("_c_same", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    rows = numbered(rows, "_c_conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "repair-rows")
    firsts = land(rows.groupBy("_c_conv", "_c_same").agg(F.min("_c_pos").alias("_c_first")), "repair-firsts")
    rows = rows.join(firsts, ["_c_conv", "_c_same"])
    size = _block_size(F.col("_c_total"))
    rows = rows.withColumns({"_c_block": F.floor(F.col("_c_pos") / size).cast("long"), "_c_at": F.col("_c_pos") % size,
                             "fault": _fault(F.col("text"), F.col("_c_first") == F.col("_c_pos"))})
    rows = land(rows.drop("_c_same", "_c_first", "_c_total"), "repair-faults")

    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = code + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(F.col("fault") == "truncated", 8).otherwise(0)
    blocks = rows.groupBy("_c_conv", "_c_block").agg(F.sort_array(F.collect_list(F.struct("_c_pos", code.alias("c")))).alias("r"))  # about sqrt(n) rows
    blocks = land(blocks.select("_c_conv", "_c_block", F.col("r.c").alias("codes")), "repair-blocks")

    def chained(df: DataFrame, *cols: str) -> DataFrame:
        row = F.sort_array(F.collect_list(F.struct("_c_block", *cols)))
        return df.groupBy("_c_conv").agg(row.alias("blocks"))  # sqrt(n) small rows

    costs = blocks.mapInArrow(_costs, "_c_conv string, _c_block long, m array<long>, bad long, head int, tail int")
    points = land(chained(costs, "m", "bad", "head", "tail").mapInArrow(
        _checkpoints, "_c_conv string, _c_block long, after array<long>, last boolean, illegal long, cost long"), "repair-checkpoints")
    walks = land(blocks.join(points, ["_c_conv", "_c_block"]).select("_c_conv", "_c_block", "codes", "after", "last")
                 .mapInArrow(_walks, "_c_conv string, _c_block long, audits array<string>, exits array<int>"), "repair-walks")
    entries = chained(walks, "exits").mapInArrow(_entries, "_c_conv string, _c_block long, state int")
    edits = land(walks.join(entries, ["_c_conv", "_c_block"]).select("_c_conv", "_c_block", "state", F.get("audits", F.col("state")).alias("audit")), "repair-edits")
    script = (edits.join(blocks, ["_c_conv", "_c_block"])
              .mapInArrow(_script, "_c_conv string, _c_block long, _c_edit long, _c_at long, _c_role string"))
    key = ["_c_conv", "_c_block", "_c_at"]
    old = script.where(F.col("_c_at").isNotNull()).join(rows.select(*key, "turn", "role", "text"), key)
    new = script.where(F.col("_c_at").isNull())
    lines = old.select("_c_conv", "_c_block", "_c_edit", "turn", F.coalesce("_c_role", "role").alias("role"), "text").unionByName(
        new.select("_c_conv", "_c_block", "_c_edit", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.col("_c_role").alias("role"), F.lit("").alias("text")))

    turns = rows.groupBy("_c_conv", "turn").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = turns.groupBy("_c_conv").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    report = counts.join(points.where("last").select("_c_conv", "illegal", "cost"), "_c_conv")
    return Repaired(report, edits, lines)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table with planted faults: crc32 of ``conv:turn`` modulo 20 says what
    happens to a row (0 dropped, 1 text emptied, 2 sentence marks removed,
    3 repeated, 4 made the user's); nulls read as one space."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    name = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)])
    text, role = F.coalesce(text.cast("string"), F.lit(" ")), F.coalesce(role.cast("string"), F.lit(" "))
    rows = rows.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("_c_do")).where("_c_do <> 0")
    do = F.col("_c_do")
    rows = rows.withColumns({"text": F.when(do == 1, "").when(do == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
                             "role": F.when(do == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_c_copy", F.explode(F.when(do == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_c_copy", "_c_do")


def digest_lines(lines: DataFrame) -> DataFrame:
    """(_c_conv, sha256) of the repaired ``role:text`` lines of each conversation."""
    return streamed_sha256(lines.withColumn("_c_text", F.concat_ws(":", "role", "text")), ["_c_conv"], ["_c_block", "_c_edit"], "_c_text", "\n")


