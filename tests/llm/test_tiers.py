"""Packing for several context sizes: every id once, no overlaps, padding, tiers and step groups."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
from stylescout.llm import tiers  # noqa: E402
from stylescout.llm.queries import QUERIES, tokenizer_path  # noqa: E402

PATH = tokenizer_path()


def ids_of(texts):
    library = tokenizers.Tokenizer.from_file(PATH)
    return [np.array([*x.ids, tiers.CLOSING_ID], "<u4") for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, documents, sizes=tiers.TIERS, step_tokens=tiers.STEP_TOKENS):
    """``documents``: (doc_id, ids) of each row. Returns tokens, tokens of padding, whole documents."""
    need = defaultdict(list)
    for doc_id, ids in documents:
        need[doc_id].append(ids)
    got, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert got.keys() == need.keys()
    whole = 0
    for doc_id, mine in got.items():
        copies = need[doc_id]
        want = sorted((zlib.crc32(x[a : a + 1].tobytes()) for x in copies for a in range(len(x)))) if len(copies) > 1 else None
        if want is None:
            (ids,), at = copies, 0
            for r in sorted(mine, key=lambda r: r["start"]):
                assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)
            whole += len(mine) == -(-len(ids) // sizes[-1])
        else:
            assert sum(r["length"] for r in mine) == len(want)
    padding, steps = 0, defaultdict(list)
    for found in windows.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        (tier,), (step,) = {r["tier"] for r in found}, {r["step"] for r in found}
        assert at <= sizes[-1] and (at == tier or tier == sizes[-1])
        padding += 0 if at & (at - 1) == 0 else sizes[-1] - at
        steps[step].append((tier, sum(r["length"] ** 2 for r in found)))
    for group in steps.values():
        assert len({t for t, _ in group}) == 1 and sum(t for t, _ in group) <= max(step_tokens, sizes[-1])
    return sum(r["length"] for r in rows), padding, whole, steps


def test_registered_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op12_tier_packing"](spark, data).collect()
    total, padding, whole, _ = check(rows, list(zip([d["doc_id"] for d in docs], ids_of([d["text"] for d in docs]), strict=True)))
    assert padding <= 0.001 * total and whole >= 0.8 * len(docs)


def test_rounds_and_odd_rows(spark):
    """Several partitions and rounds; nulls, empty and very long texts, repeated rows and ids, clashing columns."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["word", "token", "window", "pack"]) for _ in range(rng.choice([1, 5, rng.randrange(40), rng.randrange(90), rng.randrange(300)]))) for _ in range(900)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000, None), (5001, ""), (5002, "long " * 9000), (None, None), (None, "a b"), (7, "again"), (7, "again")]
    sizes, step = (32, 64, 128, 256), 1024
    clash = {c: F.lit("x") for c in ("row", "ids", "tier", "step", "part", "length", "sequence_id")}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(3)
    out = tiers.pack(df, PATH, sizes, 60, step)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"]
    got = out.collect()
    total, padding, _, steps = check(got, list(zip([i for i, _ in rows], ids_of([t for _, t in rows]), strict=True)), sizes, step)
    assert padding == 0 and len({r["sequence_id"] >> 52 for r in got}) > 1
    assert {t for group in steps.values() for t, _ in group} >= set(sizes)
    assert tiers.pack(df.limit(0), PATH, sizes, 60, step).count() == 0


def test_arrange():
    rng = random.Random(3)
    for trial in range(60):
        n = rng.choice([0, 1, 2, 10, 300])
        lengths = [rng.choice([1, 2, rng.randrange(1, 64), rng.randrange(1, 257), 256]) for _ in range(n)]
        cuttable = [rng.random() < 0.2 for _ in lengths]
        for final in (False, True):
            groups, rest = tiers.arrange(lengths, cuttable, final, (32, 64, 128, 256), 1024)
            parts = sorted([p for g in groups for w in g for p in w.parts] + rest)
            at = {}
            for item, first, size in parts:
                assert first == at.get(item, 0) and size > 0 and (size == lengths[item] or cuttable[item])
                at[item] = first + size
            assert at == dict(enumerate(lengths)) and (not final or not rest)
            for g in groups:
                assert all(w.room == 0 or final for w in g) and len({w.size for w in g}) == 1 and (final or sum(w.size for w in g) == 1024)
    # attention work is even: in each step as many short pieces as in the next
    groups, _ = tiers.arrange([16] * 128 + [32] * 64, [False] * 192, False, (32, 64), 512)
    works = [sum(w.work for w in g) for g in groups]
    assert len(works) == 8 and max(works) <= 1.1 * min(works)
