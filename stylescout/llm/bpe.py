"""BPE encoding and decoding by a pair occurrence index.

The new words of a batch lie in one flat array of symbols. An index maps each mergeable pair, under its rank, to all
positions where it occurs; ranks are taken in ascending order from a heap, all occurrences of one rank are merged, and
the lists of the pairs that arise left and right of each merge are updated. A merge that opens a pair of lower rank
hands over to that rank before the rest of its own occurrences, so the order within a word is exactly lowest rank
first, leftmost first.

Contract of the encoder: null and empty texts have no ids; words do not depend on each other, so ties, repeated rows
and very long texts need no special case; a worker remembers at most ``MEMO_WORDS`` distinct words.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .vocab import PieceMemo, WordVocabulary, vocabulary


def encode_words(vocab: WordVocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each word has, by one pair occurrence index over all of them."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    data = np.frombuffer(b"".join(raw), np.uint8)
    syms = vocab.inner[data]
    syms[ends - 1] = vocab.final[data[ends - 1]]
    n = len(syms)
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    after[ends - 1] = -1  # no pair crosses a word's border
    before[starts] = -1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(places: np.ndarray) -> int:
        """Put the pairs that begin at places in their lists; the lowest rank entered."""
        ranks = vocab.rank(syms[places], syms[after[places]])
        hit = ranks >= 0
        if not hit.any():
            return 1 << 60
        places, ranks = places[hit], ranks[hit]
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            keys, lists = ranks[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts)
        else:
            keys, lists = ranks.tolist(), [places]
        for rank, found in zip(keys, lists, strict=True):
            if rank in index:
                index[rank].append(found)
            else:
                index[rank] = [found]
                heapq.heappush(heap, rank)
        return keys[0]

    enter(np.flatnonzero(after >= 0))
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank, None)
        if lists is None:
            continue
        left, right, both = vocab.left[rank], vocab.right[rank], vocab.both[rank]
        places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        places = places[(syms[places] == left) & (after[places] >= 0)]
        places = places[syms[after[places]] == right]
        if vocab.one_by_one[rank] and len(places) > 1:
            # occurrences in one word overlap, or a merge may open a pair of lower rank: only each word's first now
            word = np.searchsorted(ends, places, "right")
            first = np.concatenate(([True], word[1:] != word[:-1]))
            if not first.all():
                index[rank] = [places[~first]]
                heapq.heappush(heap, rank)
                places = places[first]
        if not len(places):
            continue
        gone = after[places]
        syms[places], syms[gone] = both, -1
        after[places] = follow = after[gone]
        after[gone] = -1
        inside = follow >= 0
        before[follow[inside]] = places[inside]
        prior = before[places]
        enter(np.concatenate((places[inside], prior[prior >= 0])))
    kept = syms >= 0
    return syms[kept], np.add.reduceat(kept, starts, dtype=np.int64)


class Encoder(PieceMemo):
    """ids of whole texts, with a bounded memory of encoded words."""

    def forget(self) -> None:
        self.decoded: list[bytes] = []
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list) -> None:
        words = [p for p in new if isinstance(p, str)]
        ids, n = encode_words(self.vocab, words)
        if len(words) < len(new):  # special tokens are one id each
            some, at, first = [], iter(range(len(words))), np.concatenate(([0], np.cumsum(n)))
            for p in new:
                if isinstance(p, str):
                    k = next(at)
                    some.append(ids[first[k] : first[k + 1]])
                else:
                    some.append(np.array([p[1]], np.int32))
            ids, n = np.concatenate(some), np.array([len(x) for x in some])
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(n) - n))
        self.count = np.concatenate((self.count, n))
        self.flat = np.concatenate((self.flat, ids.astype(np.int32)))

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of a text from the numbers of its pieces."""
        n = self.count[numbers]
        end = np.cumsum(n)
        shift = self.start[numbers] - end + n
        return self.flat[np.repeat(shift, n) + np.arange(end[-1] if len(end) else 0)]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        return map(self.ids_of, self.numbered(texts))

    def decode_numbers(self, numbers: np.ndarray) -> bytes:
        """UTF-8 of the tokens' strings with a blank between any two, as the library decodes without a decoder."""
        known, token_of = self.decoded, self.vocab.token_of
        for k in range(len(known), len(self.start)):
            known.append(decode_ids(token_of, self.flat[self.start[k] : self.start[k] + self.count[k]].tolist()).encode("utf-8"))
        return b" ".join(map(known.__getitem__, numbers.tolist()))


def decode_ids(token_of: dict[int, str], ids: list[int]) -> str:
    return " ".join(map(token_of.__getitem__, ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(vocabulary(path))
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array of int). Other columns are untouched; a column named ``ids`` is replaced."""
    from pyspark.sql import functions as F

    def run(col: "pa.Array") -> "pa.Array":
        return pa.array(list(encoder(tokenizer).encode(col.to_pylist())), pa.list_(pa.int32()))

    udf = F.arrow_udf(run, "array<int>")
    return docs.withColumn(ids, udf(F.col(text)))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The decoded text of a column of token ids; null ids give null."""
    from pyspark.sql import functions as F

    def run(col: "pa.Array") -> "pa.Array":
        token_of = vocabulary(tokenizer).token_of
        return pa.array([None if x is None else decode_ids(token_of, x) for x in col.to_pylist()], pa.string())

    return encoded.withColumn(text, F.arrow_udf(run, "string")(F.col(ids)))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text, of every text; one row for each row of ``docs``.

    A null or empty text has no ids and decodes to the empty text. Columns other than doc_id and text are not read.
    """

    def run(batches):
        enc = encoder(tokenizer)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            n, a, d = [], [], []
            for numbers in enc.numbered(texts):
                ids = enc.ids_of(numbers)
                n.append(len(ids))
                a.append(sha(ids.astype("<u4").tobytes()))
                d.append(sha(enc.decode_numbers(numbers)))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
