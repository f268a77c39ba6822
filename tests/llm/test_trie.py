"""The prefix trie of conversations against one built of dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from stylescout.llm import trie
from stylescout.llm.queries import QUERIES

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    """conv_id -> turns, on shared heads."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            pair = (role or "", text or "")
            key = (turn is not None, turn or 0, hashlib.md5(f"{len(pair[0])}:{pair[0]}:{pair[1]}".encode()).digest())
            own.setdefault(c, []).append((key, pair))
    own = {c: [p for _, p in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: tuple(own.get(c - c % 100, [])[: h[c]] + v[h[c] :]) for c, v in own.items()}


def brute(sequences):
    """Rows of all nodes."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(sequences[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_registered_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_prefix_trie"](spark, data)
    assert all(k == "bigint" for c, k in got.dtypes if c != "ends_sha256")
    assert found(got) == brute(rebuilt(rows))


def conversations(rng):
    """Copies, prefixes, long and turnless conversations, nulls, ties, a conversation with half of all rows."""
    rows = []
    for c in range(0, 700, 3):
        n = rng.choice((1, 2, 3, 5, 9, 40))
        rows += [(c, k if rng.random() < 0.95 else None, rng.choice(("user", None, "")), rng.choice(("a", "bé", "", None))) for k in range(n)]
    long = [(7, k % 150, "user", f"t{k % 3}") for k in range(300)]
    copies = [(c, k, "user", f"t{k}") for c in range(1000, 1090) for k in range(4)]
    deep = [(c, k, "user", f"x{0 if k < 70 else k % (c % 7 + 1)}") for c in range(2000, 2012) for k in range(40 + c % 5 * 17)]
    return [*rows, *long, *copies, *deep, (None, 1, "user", "lost"), (5000, 0, None, None), (99, 0, "user", "z")]


@pytest.mark.parametrize("segment, range_rows", [(4, 20), (32, 30_000), (1, 7)])
def test_odd_conversations(spark, monkeypatch, segment, range_rows):
    monkeypatch.setattr(trie, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(trie, "BLOCK_TURNS", 16)
    rows = conversations(random.Random(13))
    clash = {c: F.lit("x") for c in ("place", "symbol", "level", "head", "h", "key", "range")}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(clash).repartition(5)
    assert found(trie.prefix_trie(trie.with_shared_heads(trie.numbered_turns(df)), range_rows, segment)) == brute(rebuilt(rows))


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.with_shared_heads(trie.numbered_turns(df))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-1, 4), min_size=1, max_size=40), st.data())
def test_extents(values, data):
    """Both ends and minima, against a walk."""
    v = np.array(values)
    table = trie.SparseTable(v)
    row, bound = data.draw(st.integers(0, len(v) - 1)), data.draw(st.integers(-1, 5))
    left = right = row
    while left > 0 and v[left] >= bound:
        left -= 1
    while right + 1 < len(v) and v[right + 1] >= bound:
        right += 1
    one = lambda x: np.array([x])
    assert (table.left(one(row), one(bound))[0], table.right(one(row), one(bound))[0]) == (left, right)
    assert table.least(one(left), one(right))[0] == v[left : right + 1].min()
