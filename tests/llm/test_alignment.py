"""Cross-tokenizer alignment against both libraries and a walk over all tokens."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
from stylescout.llm import alignment  # noqa: E402
from stylescout.llm.queries import ALIGNED_FILES, QUERIES, tokenizer_path  # noqa: E402
from stylescout.llm.vocab import byte_chars  # noqa: E402

PATHS = [tokenizer_path(n) for n in ALIGNED_FILES]
ODD = [
    None, "", " ", "  ", "\n", " \n x", "a\tb\n\n c \r\n\td  ", "it's we'll  I'm", "x <|endoftext|> y<s></s><unk> <0x41>", "İstanbul é ﬁ 漢字🙂👍🏽 ١٢ naïve", "a b　c  d​e", "a ▁b", "x\x00y \x1c z\x85w",
    "a" * 3000, "ab" * 700 + " c", "word " * 500, "�﻿ end",
]


@pytest.fixture(scope="module")
def libraries():
    a, b = tokenizers.Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    to = {c: i for i, c in enumerate(byte_chars())}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(text):
        """(id, bytes) of A and of B, or none."""
        if not text:
            return [], []
        x = [(i, bytes(to[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, piece(i)) for i in b.encode(text)]
        raw = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == raw == b"".join(t for _, t in y) else ([], [])

    return tokens


def walk(x, y):
    """Groups and links by stepping through both sides."""
    groups, links, i, j, at_x, at_y = [], [], 0, 0, 0, 0
    a, b = [], []
    while i < len(x):
        links.append((x[i][0], y[j][0]))
        end_x, end_y = at_x + len(x[i][1]), at_y + len(y[j][1])
        if end_x <= end_y:
            a.append(x[i][0])
            i, at_x = i + 1, end_x
        if end_y <= end_x:
            b.append(y[j][0])
            j, at_y = j + 1, end_y
        if end_x == end_y:
            groups.append((a, b))
            a, b = [], []
    return groups, links


def expected(texts, tokens):
    """The contract's values of each text."""
    both = [tokens(t) for t in texts]
    done = [walk(*xy) for xy in both]
    count = Counter(p for _, links in done for p in set(links))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (x, y), (groups, links) in zip(both, done, strict=True):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(count[p] == most[p[0]] for p in links)
        out.append((len(x), len(y), len(groups), len(links), best, sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if x else ""))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_registered_query(spark, data, libraries):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: w for d, w in zip(docs, expected([d["text"] for d in docs], libraries), strict=True)}
    got = QUERIES["op11_alignment"](spark, data)
    assert set(got.columns) == {"doc_id", *NAMES} and all(k == "bigint" for c, k in got.dtypes if c != "groups_sha256")
    assert {r["doc_id"]: tuple(r[c] for c in NAMES) for r in got.collect()} == want


def test_odd_rows(spark, libraries):
    """Nulls, odd white space, special strings, repeated rows and ids, clashing columns; all, some or no pairs among the hot ones."""
    rng = random.Random(11)
    texts = ODD + ODD[3:9] + ["".join(rng.choice("ab é\n \t漢🙂") for _ in range(rng.randrange(80))) for _ in range(60)]
    rows = [(None if i % 7 == 0 else i % 30, t) for i, t in enumerate(texts)]
    clash = {c: F.lit("x") for c in ("row", "pair", "pairs", "times", "n_a", "best", "a")}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(3)
    want = sorted(((i, *w) for (i, _), w in zip(rows, expected(texts, libraries), strict=True)), key=str)
    for hot in (0, 40, 1 << 17):
        out = alignment.link_counts(df, *PATHS, hot)
        assert sorted((tuple(r[c] for c in ("doc_id", *NAMES)) for r in out.collect()), key=str) == want
    assert alignment.link_counts(df.limit(0), *PATHS).count() == 0


def test_groups_column(spark, libraries):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, groups string")
    for r in alignment.align(df, *PATHS).collect():
        x, y = libraries(r["text"])
        assert [(g["a"], g["b"]) for g in r["groups"]] == walk(x, y)[0]
        at = 0
        length = dict(x)
        for g in r["groups"]:
            assert g["start"] == at and g["end"] == at + sum(len(length[i]) for i in g["a"])
            at = g["end"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(libraries, text):
    x, y = libraries(text)
    (found,) = alignment.aligner(*PATHS).align([text])
    assert found.a.tolist() == [i for i, _ in x] and found.b.tolist() == [i for i, _ in y]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(61, 70)), max_size=5))
def test_shared_cuts(texts):
    """Any ends, many texts at once, against the ends that both sides have."""
    a, b, bounds, base = [], [], [], 0
    for x, y, end in texts:
        first = len(a), len(b)
        a += [base + v for v in sorted(x)] + [base + end]
        b += [base + v for v in sorted(y)] + [base + end]
        bounds.append((first[0], len(a), first[1], len(b)))
        base += end
    both = sorted(set(a) & set(b))
    a_cut, b_cut = alignment.shared_cuts(np.array(a), np.array(b), bounds)
    assert a_cut.tolist() == [bisect_left(a, v) + 1 for v in both] and b_cut.tolist() == [bisect_left(b, v) + 1 for v in both]


def test_bounded_memory(monkeypatch, libraries):
    monkeypatch.setattr(alignment, "MEMO_WORDS", 50)
    monkeypatch.setattr(alignment, "BLOCK", 200)
    own, texts = alignment.Aligner(*PATHS), [f"w{i} tok{i * 7} {i}" for i in range(300)]
    got = [i for x in own.align(texts) for i in x.a.tolist()]
    assert got == [i for t in texts for i, _ in libraries(t)[0]] and len(own.memo) < 150
