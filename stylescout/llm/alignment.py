"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut the same bytes. Where a token of each ends at the same byte, both sides are cut; between two such cuts lies a group
of tokens that only match as a whole. The cuts of a text are found by divide and conquer: from the middle token of an interval the nearest end that
both sides have is located by bisection, each side's ends in turn, first rightwards, then leftwards; the interval is cut there and both
halves are done in the same way. An interval with no cut is a leaf, one group. All intervals of a block of texts are halved at once.

Tokens overlap (are linked) if their bytes do. A pair of ids counts the documents that hold it linked. Each document's distinct pairs are
written once and counted on all executors; the counts come back to the documents in two ways. The ``HOT_PAIRS`` most frequent pairs, a table
of fixed size, are sent to all tasks; a rarer pair is held by few documents and is joined by key.

Both tokenizers cut before every blank, tab or line end that follows a character other than white space, whatever stands around it. So a
text is encoded in stretches between such places, and a worker remembers the tokens of the stretches it has met.

Defined cases: texts that are null or empty, or whose tokens do not give back the bytes of a blank and the text on both sides, have no
tokens: zeros, an empty list of groups; each row of a repeated document counts, and has its own row in the result; ties for a token's highest count all
count as best; texts of any length are aligned whole; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_WORDS, Memo, blocks, durable, stored
from .vocab import byte_chars

#: pairs whose counts go to all tasks (12 bytes each); and characters of text aligned at a time
HOT_PAIRS = 1 << 17
BLOCK = 400_000
#: before a blank, tab or line end that follows a character other than white space, both tokenizers cut
STRETCH = re.compile(r"\s*\S+(?:(?![ \t\n])\s+(?:\S+|\Z))*|\s+")
B_BITS = 20
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


class Bytewise:
    """Ids and bytes of the tokens of a tokenizers file with a byte-level vocabulary."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        to = {c: b for b, c in enumerate(byte_chars())}
        self.bytes_of = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            self.bytes_of[i] = bytes(to[c] for c in token) if all(c in to for c in token) else token.encode()

    def encode(self, stretches: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch(stretches, add_special_tokens=False)]


class Pieces:
    """Ids and bytes of the tokens of a sentencepiece model, which puts a blank before each text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.blank = self.library.piece_to_id("▁")
        self.bytes_of = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            byte = _BYTE_PIECE.fullmatch(piece)
            if "▁" in piece.lstrip("▁") or re.search(r"[\t\n]", piece):
                raise ValueError(f"{path}: a piece goes on behind white space, so texts can't be encoded in stretches")
            self.bytes_of.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def encode(self, stretches: list[str]) -> list[list[int]]:
        # the library puts a blank before each that isn't empty: that is the stretch's own, or a token by itself before a tab or line end
        blank = [s[:1] == " " for s in stretches]
        found = self.library.encode([s[b:] for s, b in zip(stretches, blank, strict=True)], num_threads=1)
        return [[self.blank] if s == " " else x if b else x[1:] for s, x, b in zip(stretches, found, blank, strict=True)]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Bytewise | Pieces:
    return Bytewise(path) if path.endswith(".json") else Pieces(path)


class Side:
    """The tokens of the stretches that a worker has met, one tokenizer's."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        self.length_of = np.array([len(b) for b in self.tokenizer.bytes_of], np.int64)
        self.count, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, new: list[str]) -> list[bool]:
        """Encodes new stretches; whether each one's tokens give back its bytes."""
        found = self.tokenizer.encode(new)
        n = np.array([len(x) for x in found], np.int64)
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(n) - n))
        self.count = np.concatenate((self.count, n))
        self.flat = np.concatenate((self.flat, np.array([i for x in found for i in x], np.int32)))
        own = self.tokenizer.bytes_of
        return [b"".join(map(own.__getitem__, x)) == s.encode("utf-8", "surrogatepass") for s, x in zip(new, found, strict=True)]

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        n = self.count[numbers]
        end = np.cumsum(n)
        return self.flat[np.repeat(self.start[numbers] - end + n, n) + np.arange(end[-1] if len(end) else 0)]


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, texts: list[tuple[int, int, int, int]] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of texts laid one after another: for each, in order, the places behind its last tokens in a_ends and in b_ends.

    ``texts``: first and behind-last places in a_ends and in b_ends of each text that has tokens. Ends are rising byte offsets.
    """
    todo = np.array(texts, np.int64).reshape(-1, 4)
    leaves: list[np.ndarray] = []
    while len(todo):
        single = (todo[:, 1] - todo[:, 0] == 1) | (todo[:, 3] - todo[:, 2] == 1)
        leaves.append(todo[single])
        todo = todo[~single]
        a0, a1, b0, b1 = todo.T
        middle = (a0 + a1 - 1) // 2
        at = np.full((len(todo), 2), -1)  # the cut's places in a_ends and b_ends
        # rightwards: the least b end not before the a end, the least a end not before that one, until both are one byte
        who, i = np.arange(len(todo)), middle
        while len(who):
            j = np.searchsorted(b_ends, a_ends[i])
            open_ = (i < a1[who] - 1) & (j < b1[who] - 1)
            who, i, j = who[open_], i[open_], j[open_]
            met = b_ends[j] == a_ends[i]
            at[who[met]] = np.stack((i[met], j[met]), 1)
            who, i = who[~met], np.searchsorted(a_ends, b_ends[j[~met]])
        # leftwards from before the middle, for those that found none: their right half has no cut
        who = np.flatnonzero(at[:, 0] < 0)
        none_right, i = who, middle[who] - 1
        while len(who):
            j = np.searchsorted(b_ends, a_ends[i], "right") - 1
            open_ = (i >= a0[who]) & (j >= b0[who])
            who, i, j = who[open_], i[open_], j[open_]
            met = b_ends[j] == a_ends[i]
            at[who[met]] = np.stack((i[met], j[met]), 1)
            who, i = who[~met], np.searchsorted(a_ends, b_ends[j[~met]], "right") - 1
        cut = at[:, 0] >= 0
        leaves.append(todo[~cut])
        left, right = todo.copy(), todo.copy()
        left[:, 1], left[:, 3] = at[:, 0] + 1, at[:, 1] + 1
        right[:, 0], right[:, 2] = left[:, 1], left[:, 3]
        done = np.zeros(len(todo), bool)
        done[none_right] = True
        leaves.append(right[cut & done])
        todo = np.concatenate((left[cut], right[cut & ~done]))
    found = np.concatenate(leaves) if leaves else np.zeros((0, 4), np.int64)
    found = found[np.argsort(found[:, 0])]
    return found[:, 1], found[:, 3]


class Aligned:
    """A block of texts: tokens of both sides one after another, each text's first ones, and groups."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> None:
        self.a, self.b, self.a_ends, self.b_ends, self.a_first, self.b_first = a, b, a_ends, b_ends, a_first, b_first
        texts = np.stack((a_first[:-1], a_first[1:], b_first[:-1], b_first[1:]), 1)
        self.a_cut, self.b_cut = shared_cuts(a_ends, b_ends, texts[texts[:, 1] > texts[:, 0]])
        #: each text's first group
        self.g_first = np.searchsorted(self.a_cut, a_first, "right")

    def group_texts(self, comma: np.ndarray, bar: np.ndarray, semicolon: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text, from the ids' strings with what follows them."""
        n_a, n_b = np.diff(self.a_cut, prepend=0), np.diff(self.b_cut, prepend=0)
        out = np.empty(len(self.a) + len(self.b), object)
        a_at = np.arange(len(self.a)) + np.repeat(self.b_cut - n_b, n_a)
        b_at = np.arange(len(self.b)) + np.repeat(self.a_cut, n_b)
        out[a_at], out[b_at] = comma[self.a], comma[self.b]
        out[a_at[self.a_cut - 1]], out[b_at[self.b_cut - 1]] = bar[self.a[self.a_cut - 1]], semicolon[self.b[self.b_cut - 1]]
        first = (self.a_first + self.b_first).tolist()
        return ["".join(out[i:j].tolist())[:-1] for i, j in zip(first[:-1], first[1:], strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of linked tokens (A's id above B's) in order, and each text's first: a pair for each stretch of bytes between two ends of any side."""
        ends = np.sort(np.concatenate((self.a_ends, self.b_ends)), kind="stable")  # two runs
        ends = ends[np.diff(ends, prepend=-1) > 0]
        pairs = self.a[np.searchsorted(self.a_ends, ends)].astype(np.int64) << B_BITS | self.b[np.searchsorted(self.b_ends, ends)]
        last = np.concatenate(([0], self.a_ends))[self.a_first]  # bytes before each text
        return pairs, np.searchsorted(ends, last, "right")


class Aligner:
    """Aligns texts, with a bounded memory of the stretches met."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.paths = a_path, b_path
        self.forget()
        most = max(len(s.tokenizer.bytes_of) for s in self.sides)
        self.marks = [np.array([f"{i}{mark}" for i in range(most)], object) for mark in ",|;"]

    def forget(self) -> None:
        self.memo, self.sides, self.whole = Memo(), [Side(p) for p in self.paths], np.zeros(0, bool)

    def _gives_back(self, numbers: np.ndarray, raw: bytes) -> bool:
        return all(b"".join(map(s.tokenizer.bytes_of.__getitem__, s.ids_of(numbers).tolist())) == raw for s in self.sides)

    def align(self, texts: list[str | None]) -> Iterator[Aligned]:
        """A block after another of the texts."""
        for first, last in blocks(texts, BLOCK):
            if len(self.memo) > MEMO_WORDS:
                self.forget()
            get, held = self.memo.__getitem__, []
            for t in texts[first:last]:
                found = STRETCH.findall(" " + t) if t else []
                held.append(np.fromiter(map(get, found), np.int32, len(found)))
            new = self.memo.take()
            self.whole = np.concatenate((self.whole, np.logical_and(*(s.learn(new) for s in self.sides))))
            for k, numbers in enumerate(held):
                if not self.whole[numbers].all() and not self._gives_back(numbers, (" " + texts[first + k]).encode("utf-8", "surrogatepass")):
                    held[k] = numbers[:0]
            numbers = np.concatenate(held)
            bounds = np.cumsum([0, *map(len, held)])
            parts = []
            for s in self.sides:
                ids = s.ids_of(numbers)
                parts.append((ids, np.cumsum(s.length_of[ids]), np.concatenate(([0], np.cumsum(s.count[numbers])))[bounds]))
            (a, a_ends, a_first), (b, b_ends, b_first) = parts
            yield Aligned(a, b, a_ends, b_ends, a_first, b_first)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker and pair of tokenizer files."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", name: str = "groups") -> DataFrame:
    """``docs`` with a column of each text's groups in order: byte range (of a blank and the text), ids of A, ids of B. A column of that name is replaced."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for x in aligner(a_path, b_path).align(column.to_pylist()):
            a, b = x.a.tolist(), x.b.tolist()
            ends, a_cut, b_cut = x.a_ends[x.a_cut - 1].tolist(), [0, *x.a_cut.tolist()], [0, *x.b_cut.tolist()]
            ends = [0, *ends]
            for lo, hi in zip(x.g_first[:-1].tolist(), x.g_first[1:].tolist(), strict=True):
                base = ends[lo]
                out.append([{"start": ends[g] - base, "end": ends[g + 1] - base, "a": a[a_cut[g] : a_cut[g + 1]], "b": b[b_cut[g] : b_cut[g + 1]]} for g in range(lo, hi)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))

    return docs.withColumn(name, F.arrow_udf(run, "array<struct<start:bigint,end:bigint,a:array<int>,b:array<int>>>")(F.col(text)))


_DIGEST = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]


def _digest(x: Aligned, marks: list[np.ndarray]) -> list[pa.Array]:
    """A block's columns of _DIGEST; ``pairs`` are each text's distinct linked pairs, ``times`` how often it has each."""
    pairs, first = x.links()
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys = np.sort(owner << (B_BITS + 20) | pairs)
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    distinct, times = keys[new], np.diff(new, append=len(keys))
    at = np.searchsorted(distinct >> (B_BITS + 20), np.arange(len(first)))
    lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, k)) for v, k in ((distinct & (1 << B_BITS + 20) - 1, pa.int64()), (times, pa.int32()))]
    sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in x.group_texts(*marks)]
    return [*(pa.array(np.diff(v), pa.int64()) for v in (x.a_first, x.b_first, x.g_first, first)), pa.array(sha, pa.string()), *lists]


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id; numbers of tokens, groups and links; SHA-256 of the groups; distinct linked pairs (A's id << 20 | B's) and how often each occurs."""

    def run(batches):
        own = aligner(a_path, b_path)
        for batch in batches:
            row = 0
            for x in own.align(batch.column(1).to_pylist()):
                columns = _digest(x, own.marks)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(columns[0])), *columns], ["doc_id", *(n for n, _ in _DIGEST)])
                row += len(columns[0])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n_docs, best (1 if no other pair of its A id has more documents) of all pairs in the column ``pairs``."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = stored(counts.withColumn("a", F.shiftright("pair", B_BITS)))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row for each id of A's vocabulary at most
    return counts.join(F.broadcast(most), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).cast("int").alias("best"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """``most`` pairs at most: all those of at least as many documents as a bound found from how many pairs have about 2 ** (k / 8) documents."""
    level = F.floor(F.log2("n_docs") * 8)
    have, bound = 0, 1 << 20
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 8 rows for each doubling of the documents at most
        have += r["count"]
        if have > most:
            break
        bound = r["level"]
    return counts.filter(level >= bound)


def link_counts(docs: DataFrame, a_path: str, b_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``: n_best links have a count that no other pair of
    their A id exceeds; count_sum adds up the counts of all links."""
    spark = docs.sparkSession
    found = stored(digests(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    counts = durable(pair_counts(found))
    top = most_frequent(counts, hot_pairs).toPandas().sort_values("pair")
    hot = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), (top["n_docs"] * 2 + top["best"]).to_numpy(np.int64)))

    def split(column: pa.Array):
        """The column's flat pairs, where each is among the hot ones, and whether it is."""
        keys = hot.value[0]
        flat = column.flatten().to_numpy()
        at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
        return flat, at, keys[at] == flat if len(keys) else np.zeros(len(flat), bool)

    def sums(batches):
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            _, at, is_hot = split(pairs)
            values = hot.value[1][at] * is_hot if len(hot.value[1]) else np.zeros(len(at), np.int64)
            first = np.concatenate(([0], np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
            total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[first])
            kept = batch.select(["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            yield kept.append_column("hot_best", pa.array(total((values & 1) * times), pa.int64())).append_column("hot_sum", pa.array(total((values >> 1) * times), pa.int64()))

    def rare(batches):
        for batch in batches:
            pairs = batch.column("pairs")
            flat, _, is_hot = split(pairs)
            rows = np.repeat(batch.column("row").to_numpy(), pairs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            times = batch.column("times").flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(v[~is_hot]) for v in (rows, flat, times)], ["row", "pair", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = found.mapInArrow(sums, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, hot_best long, hot_sum long")
    single = found.select("row", "pairs", "times").mapInArrow(rare, "row long, pair long, times int").join(counts, "pair")
    single = single.groupBy("row").agg(F.sum(F.col("best") * F.col("times")).alias("rare_best"), F.sum(F.col("n_docs") * F.col("times")).alias("rare_sum"))
    out = whole.join(single, "row", "left")
    added = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", added("hot_best", "rare_best").alias("n_best"), added("hot_sum", "rare_sum").alias("count_sum"), "groups_sha256")
