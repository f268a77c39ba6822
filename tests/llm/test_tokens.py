"""BPE, token counts and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
from stylescout.llm import bpe, packing, transducer  # noqa: E402
from stylescout.llm.queries import tokenizer_path  # noqa: E402
from stylescout.llm.vocab import vocabulary  # noqa: E402

PATH = tokenizer_path()
ODD = [
    None, "", " ", "hello <|startoftext|>There\x1cworld Σας it's we'll I'm ½ ²³ <|endoftext|><|x", "İstanbul ǅ ﬁ é é x y\x85z 漢字🙂👍🏽 ١٢",
    "aaaaaaaaaaaaaaaa bcbcbcbcbc", "a" * 3000, "ab" * 2000 + "c", "x\u0000y", "word " * 3000,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def random_texts():
    rng = random.Random(1)
    wide = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 600), rng.randrange(0x300, 0x3000)]))
    return ["".join(wide() for _ in range(200)) for _ in range(40)] + ["".join(rng.choice("abcdeth ") for _ in range(300)) for _ in range(40)]


def test_ids_counts_and_decoding(library):
    texts = ODD + random_texts()
    encoder, counter = bpe.Encoder(vocabulary(PATH)), transducer.Counter(vocabulary(PATH))
    counts = counter.counts(texts)
    for text, numbers, count in zip(texts, list(encoder.numbered(texts)), counts, strict=True):
        ids = encoder.ids_of(numbers).tolist()
        assert ids == library.encode(text or "", add_special_tokens=False).ids
        assert count == len(ids)
        assert encoder.decode_numbers(numbers).decode() == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    library = tokenizers.Tokenizer.from_file(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    assert next(bpe.encoder(PATH).encode([text])).tolist() == want
    assert transducer.counter(PATH).counts([text]) == [len(want)]


def test_prefix_scan_of_chunk_maps(monkeypatch):
    machine = transducer.Transducer(vocabulary(PATH))
    rng = random.Random(8)
    size = transducer.CHUNK_BYTES
    for word in (b"abcab" * 7000, bytes(rng.choice(b"abcdeth") for _ in range(40_000))):
        symbols = [*word[:-1], word[-1] + 256]
        want = [machine.run(machine.start, symbols[: i + size])[1] for i in range(0, len(symbols), size * 16)]
        assert list(machine.prefix_counts(symbols))[::16] == want
    # the machine stays small within one long word, and counts on
    monkeypatch.setattr(transducer, "MAX_STATES", 2000)
    least = transducer.Transducer(vocabulary(PATH))
    assert least.count(word) == list(machine.prefix_counts(symbols))[-1] and len(least.arcs) < 2000 + 2 * size


def test_scan_of_texts(spark, library):
    """The scan's counts at every chunk's end, texts of none to many chunks in one batch."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["word", "toke", "nizer", "zzzyx", "é"]) for _ in range(n)) for n in (0, 1, 63, 64, 65, 1000, 5000, 64 * 64)] + [None]
    rows = transducer.chunk_counts(spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, chunk int"), PATH).collect()
    for i, t in enumerate(texts):
        words = (t or "").split()
        want = [len(library.encode(" ".join(words[: k + 64]), add_special_tokens=False).ids) for k in range(0, len(words), 64)]
        assert [r["tokens_through"] for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["chunk"])] == want


def test_queries(spark, data, library):
    from stylescout.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in docs.items()}
    raw = lambda x: np.array(x, "<u4").tobytes()
    got = {r["doc_id"]: r for r in QUERIES["op5_bpe"](spark, data).collect()}
    assert len(got) == len(docs)
    for d, r in got.items():
        assert r["n_tokens"] == len(ids[d]) and r["ids_sha256"] == hashlib.sha256(raw(ids[d])).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids[d], skip_special_tokens=False).encode()).hexdigest()
    for r in QUERIES["op3_token_counts"](spark, data).collect():
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (len(ids[r["doc_id"]]), len(docs[r["doc_id"]].encode()), len(ids[r["doc_id"]]) > 2048)
    rows = QUERIES["op8_packing"](spark, data).collect()
    check_packing(rows)
    for r in rows:
        want = [*ids[r["doc_id"]], 0][r["start"] : r["start"] + r["length"]]
        assert len(want) == r["length"] and r["ids_crc32"] == zlib.crc32(raw(want)) and r["start"] == 2048 * r["piece"]
    assert sum(r["length"] for r in rows) == sum(len(x) + 1 for x in ids.values())


def check_packing(rows, capacity=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_encode_decode_columns(spark):
    docs = spark.createDataFrame([(1, "Hello, world"), (2, None)], "doc_id long, text string")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).orderBy("doc_id").collect()
    assert rows[0]["decoded"] == "hello</w> ,</w> world</w>" and rows[1]["ids"] == []


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(2)
    for capacity, high in ((100, 100), (100, 60), (2048, 2048)):
        for _ in range(30):
            lengths = np.sort(rng.integers(1, high + 1, 80))[::-1]
            bins, offsets, left = packing.best_fit_decreasing(lengths, capacity)
            assert packing.lower_bound(lengths, capacity) <= len(left)
            check_packing([{"sequence_id": b, "offset": o, "length": n} for b, o, n in zip(bins, offsets, lengths, strict=True)], capacity)
    assert packing.lower_bound(np.array([60] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 7), 100) == 4
    assert packing.lower_bound(np.zeros(0, int), 100) == 0


def test_exchange(spark):
    rng = random.Random(3)
    rows = [(i % 400, i, rng.randrange(1, 2049), "clash") for i in range(3000)] + [(None, 0, 5, None)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, length long, sequence string")
    got = packing.pack(items, partition_items=200).collect()
    assert len(got) == len(rows)
    lengths = np.sort([r[2] for r in rows])[::-1]
    whole = len(packing.best_fit_decreasing(lengths, 2048)[2])
    assert packing.lower_bound(lengths, 2048) <= check_packing(got) <= whole * 1.02 + 2
    assert packing.pack(items.limit(0)).count() == 0
    # the certificate says what it means
    one = packing.pack(items).collect()
    assert {(r["n_bins"], r["bins_bound"], r["bins_certified"]) for r in one} == {(whole, bound := packing.lower_bound(lengths, 2048), whole == bound)}
    tight = spark.createDataFrame([(None, 0, 1024)] * 100, "doc_id long, piece int, length long")
    assert all(r["bins_certified"] and r["n_bins"] == 50 for r in packing.pack(tight).collect())


def test_rows_without_ids_are_dealt_apart(spark):
    """Rows of one id, null included, go to many partitions; columns named as added ones are replaced, others kept."""
    rng = random.Random(4)
    rows = [(None, 0, rng.randrange(1, 2049), "a", 7, "p", i) for i in range(2000)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, length long, sequence_id string, offset int, part string, row int")
    got = packing.pack(items, partition_items=100).collect()
    assert sorted(r["row"] for r in got) == list(range(2000)) and {r["part"] for r in got} == {"p"}
    assert set(got[0].asDict()) == {"doc_id", "piece", "length", "part", "row", "sequence_id", "offset", "n_bins", "bins_bound", "bins_certified"}
    check_packing(got)
    assert max(r["n_bins"] for r in got) < 200
