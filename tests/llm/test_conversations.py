"""Conversation repair and prefix trie against brute force."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import ROOT  # noqa: F401

from hourloom.llm import queries as q
from hourloom.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, audit string, seg long, `x.y` string"
BLANK = " \t\n\x0b\x0c\r"


def odd_conversations(seed=1, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        turn = 0
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None])
            text = r.choice(["Hello there.", "same words", "What? ", "", None, "  \n", "end!", f"say {r.randrange(4)}."])
            rows.append((c, r.choice([turn, turn, turn, None]), role, text))
            turn += r.choice([1, 1, 1, 2, 0])
    rows += [(None, 1, "user", "null id."), (None, None, "assistant", "x"), (None, 2, "user", "y. ")]
    rows += [(500, t, "user" if t % 2 else "assistant", r.choice(["a.", "b", f"c{t}.", f"d{t}"])) for t in range(700)]  # several blocks
    rows += [(501, 3, "user", "repeated row.")] * 5
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "a", 1, "z") for x in rows], SCHEMA).repartition(3)


def order_key(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role.encode(), text.encode())


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        do = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        out[conv]  # every conversation stays
        if do == 0:
            continue
        text = "" if do == 1 else "".join(x for x in text if x not in ".!?") if do == 2 else text
        role = "user" if do == 4 else role
        out[conv] += [(turn, role, text)] * (2 if do == 3 else 1)
    return {c: sorted(x, key=order_key) for c, x in out.items()}


def cheapest(rows, faults):
    """Dijkstra over (row, state) with the audit as the second key."""
    states = {"": 0, "s": 1, "u": 2, "a": 3}
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, st, lines = heapq.heappop(heap)
        if (i, st) in done:
            continue
        done.add((i, st))
        if i == len(rows) and st in ("", "a"):
            return cost, audit, lines
        for role in ("user", "assistant"):
            if (st, role[0]) in go:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*lines, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, st, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if (st, role[:1]) in go:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, go[st, role[:1]], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (st, new[0]) in go:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, new[0], (*lines, f"{new}:{text}")))
    raise AssertionError(states)


def repaired(rows):
    out = []
    for conv, found in damage(rows).items():
        seen, faults = set(), []
        for _, role, text in found:
            t = text.rstrip(BLANK)
            faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        cost, audit, lines = cheapest(found, faults)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def conversations(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def test_repair_query(spark, sf, conversations):
    assert rows_of(q.op11_conversation_repair(spark, sf), COLUMNS) == repaired(conversations)


@pytest.mark.parametrize("block", [256, 4])
def test_repair_of_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)  # small: most conversations have several blocks
    rows = odd_conversations()
    assert rows_of(q.repair_table(frame(spark, rows)), COLUMNS) == repaired(rows)


def test_repair_of_no_rows(spark):
    assert q.repair_table(frame(spark, [])).collect() == []


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=order_key)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:] if c is not None else turns
    return out


def nodes(rows):
    convs = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        words = len(p[-1][1].encode().split()) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[x] for x in children[p])

    def low(p):
        return min((c for c in members[p] if c is not None), default=None)
    out = []
    for p in members:
        at = sorted(ends.get(p, []), key=lambda c: (c is None, c or 0))
        line = ",".join("" if c is None else str(c) for c in at)
        out.append((low(p), len(p), low(p[:-1]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(line.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_query(spark, sf, conversations):
    assert rows_of(q.op13_prefix_trie(spark, sf), NODE) == nodes(conversations)


@pytest.mark.parametrize(("segment", "shard"), [(256, 100_000), (150, 300)])
def test_trie_of_odd_rows(spark, monkeypatch, segment, shard):
    monkeypatch.setattr(trie, "SEGMENT", segment)  # small: several levels and shards
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    rows = odd_conversations()
    rows += [(c, t, "user", f"hot {t}") for c in range(600, 640) for t in range(5)]  # copies under one first turn
    rows += [(c, t, "user", f"hot {t}" if t < 4 else f"own {c}") for c in range(640, 680) for t in range(6)]
    assert rows_of(q.trie_table(frame(spark, rows)), NODE) == nodes(rows)


def test_trie_of_no_rows(spark):
    assert q.trie_table(frame(spark, [])).collect() == []


def test_double_array_holds_what_was_put_in():
    r = np.random.default_rng(3)
    seqs = [r.integers(1, 30, r.integers(0, 12)) for _ in range(400)]
    t = trie.DoubleArray(seqs, 30)
    paths = {tuple(s[:d]) for s in map(list, seqs) for d in range(1, len(s) + 1)}
    assert int((t.check >= 0).sum()) == len(paths) + 1
    ends = {}
    for s in seqs:
        node = np.array([0])
        for d, c in enumerate(s):
            node = t.step(node, np.array([c]))
            assert ends.setdefault(int(node[0]), tuple(s[:d + 1])) == tuple(s[:d + 1])
