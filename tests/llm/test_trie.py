"""The trie of conversations against brute force."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from barley.llm import prefix_trie as T
from tests.llm import fixtures as X

SF = "/root/testdata/sf0.001"


def brute(rows):
    """conv_id, depth -> (parent, n_convs, n_children, n_leaves, saved, hash) of (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members.setdefault(made[c][:d], []).append(c)
    below = {}
    for path in members:
        if path:
            below.setdefault(path[:-1], []).append(path)
    value = {}
    for path in sorted(members, key=len, reverse=True):
        leaves = sum(value[p][0] for p in below.get(path, [])) or 1
        own = (len(members[path]) - 1) * len(X.words(path[-1][1])) if path else 0
        value[path] = leaves, own + sum(value[p][1] for p in below.get(path, []))
    out = {}
    for path, own in members.items():
        ends = ",".join(str(c) for c in own if made[c] == path)
        out[own[0], len(path)] = (members[path[:-1]][0] if path else None, len(own), len(below.get(path, [])), *value[path], hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(frame, **options):
    rows = T.prefix_trie(T.rebuilt(T.turns(frame)), **options).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed, n=300):
    rng = random.Random(seed)
    turns = [(rng.choice(["user", "assistant", None]), rng.choice([None, "", "one", "two  words", "a b c\nd", "é\x1cf g"])) for _ in range(6)]
    rows = []
    for c in rng.sample(range(4 * n), n):
        own = [rng.choice(turns[:2] if k < 2 else turns) for k in range(rng.choice([1, 1, 2, 3, 3, 5, 9]))]
        rows += [(c, k if k or rng.random() < .8 else None, *t) for k, t in enumerate(own)]
    copy = [(k, "user", f"long {k}") for k in range(70)]
    for c in (5000, 5003, 5007):   # long ones that share most of their turns
        rows += [(c, *t) for t in copy[:60 + c % 10]] + [(c, 100, "user", str(c))]
    rows += [(7001, 3, "user", "x"), (7001, 3, "user", "x"), (7001, 3, "user", "a"), (None, 1, "user", "nobody")]
    rng.shuffle(rows)
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS conv", "2 AS n", "3 AS depth", "'x' AS path").repartition(7)


def test_parentheses():
    rng = np.random.default_rng(1)
    for n in (1, 2, 300, 5000):
        for lean in (0.5, 0.9):
            bits, depth, left = [], 0, n
            while left or depth:
                if left and (not depth or rng.random() < lean):
                    bits.append(1)
                    depth, left = depth + 1, left - 1
                else:
                    bits.append(0)
                    depth -= 1
            parens, stack, want = T.Parentheses(np.array(bits, np.uint8)), [], {}
            for at, bit in enumerate(bits):
                if bit:
                    stack.append(at)
                else:
                    want[stack.pop()] = at
            assert {at: parens.close_of(at) for at in want} == want


@pytest.mark.parametrize("shard", [T.SHARD, 5])
def test_trie(spark, shard, monkeypatch):
    if shard == 5:   # paths of one table in many shards, hashes of many pieces, sums over many stretches
        monkeypatch.setattr(T, "STRETCH", 8)
        monkeypatch.setattr(T, "PIECE", 16)
    rows = conversations(shard)
    want = brute(rows)
    assert max(v[3] for v in want.values()) > 50 and max(v[4] for v in want.values()) > 500
    assert got(frame_of(spark, rows), shard=shard) == want


def test_copies_and_empty(spark):
    """One group of equal conversations holds half of all; no conversations, no nodes."""
    rows = [(c, k, "user", f"turn {k}") for c in range(400) for k in range(4)] + [(c, k, "user", f"{c} {k}") for c in range(400, 800) for k in range(3)]
    assert got(frame_of(spark, rows)) == brute(rows)
    assert got(frame_of(spark, rows).where("false")) == {}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_registered(spark):
    from oracle.run import compare, connect
    result, *_ = compare(spark, connect(SF), SF, T.op11_conversation_prefix_trie, T.OP11_SQL)
    assert result.startswith("ok"), result
