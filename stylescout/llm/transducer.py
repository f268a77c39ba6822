"""Token counts by a compiled finite-state transducer.

The tokenizer's vocabulary and merge ranks are compiled to a deterministic transducer over the bytes of a word, of which
the last is marked. It rests on two facts of rank-ordered merging: a sequence of tokens is the encoding of its bytes if
and only if each adjacent pair encodes to itself, and each prefix of a word has one encoding. So the last token of the
encoding of a prefix is the one token ending there that is compatible with the last token of the prefix before it.

A state holds, for every suffix of the input that may begin a longer token, the node of the token trie, the last token
of the encoding before that suffix, and how many tokens fewer that encoding has. There are finitely many; they are made
deterministic as input reaches them. Each transition is annotated with the tokens it emits net (a byte that extends the
last token emits 0, a merge across earlier tokens less). After a word's last byte the machine is in its start state again.

A chunk of input acts on the machine as a map: entry state to exit state and emitted tokens. Maps compose associatively,
so a parallel prefix scan over the chunks of a text gives the count up to the end of each. Texts are cut into chunks of
``CHUNK_PIECES`` words. A chunk of whole words ends in the start state whatever it is entered in, and is entered in it: its map is
one number, tabulated for all chunks of a batch at once from a bounded memory of the words' own maps. A batch's chunks are then
composed by one scan that runs over all its texts together, in a logarithmic number of rounds. A word longer than
``CHUNK_BYTES`` is cut inside; its chunks' maps are tabulated at the states they are entered in, equal chunks share one map, and
they are composed by the same kind of scan, ``SCAN_CHUNKS`` at a time.

Defined cases: null and empty texts have 0 bytes, 0 tokens and no chunk; texts of any length are counted whole; the machine keeps about
``MAX_STATES`` states, then starts anew from the state it is in, so that a word of any length takes bounded memory; repeated rows are
counted each; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .vocab import PieceMemo, WordVocabulary, vocabulary

CHUNK_BYTES = 256
#: Words of a chunk, and chunks of a long word that are composed at a time.
CHUNK_PIECES = 64
SCAN_CHUNKS = 64
#: States, and pairs of tokens, kept before the machine is compiled anew.
MAX_STATES = 400_000
#: Chunks of long words whose maps are remembered.
MAX_MAPS = 4096
_LAST = 256  # added to the byte that ends a word
START = ((0, -1, 0),)


class Transducer:
    def __init__(self, vocab: WordVocabulary) -> None:
        self._ids = [*vocab.inner.tolist(), *vocab.final.tolist()]
        self._merge = {(a, b): (r, c) for r, (a, b, c) in reversed(list(enumerate(zip(vocab.left.tolist(), vocab.right.tolist(), vocab.both.tolist(), strict=True))))}
        # symbols of every token that merges can make, and the trie over them
        self._spelt = {i: (s,) for s, i in enumerate(self._ids)}
        for a, b, c in zip(vocab.left.tolist(), vocab.right.tolist(), vocab.both.tolist(), strict=True):
            self._spelt.setdefault(c, self._spelt[a] + self._spelt[b])
        self._child: list[dict[int, int]] = [{}]
        self._token: list[int] = [-1]
        for token, symbols in self._spelt.items():
            node = 0
            for s in symbols:
                to = self._child[node].get(s)
                if to is None:
                    to = self._child[node][s] = len(self._child)
                    self._child.append({})
                    self._token.append(-1)
                node = to
            self._token[node] = token
        self._restart()

    def _restart(self) -> None:
        self._fits: dict[tuple[int, int], bool] = {}
        self._state_of: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self.arcs: list[dict[int, tuple[int, int]]] = []
        self.start = self._number(START)

    def _number(self, key: tuple) -> int:
        n = self._state_of.get(key)
        if n is None:
            n = self._state_of[key] = len(self._states)
            self._states.append(key)
            self.arcs.append({})
        return n

    def _compatible(self, before: int, token: int) -> bool:
        """Whether the bytes of the two tokens, or of the second alone at a word's start, encode to just them."""
        fits = self._fits.get((before, token))
        if fits is None:
            want = [token] if before < 0 else [before, token]
            syms = [self._ids[s] for t in want for s in self._spelt[t]]
            merge = self._merge.get
            while len(syms) > len(want):
                found = [(hit[0], i, hit[1]) for i in range(len(syms) - 1) if (hit := merge((syms[i], syms[i + 1])))]
                if not found:
                    break
                _, i, both = min(found)
                syms[i : i + 2] = [both]
            # what is left may not merge on
            fits = self._fits[before, token] = syms == want and (before < 0 or merge((before, token)) is None)
        return fits

    def arc(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the tokens emitted net."""
        out = self.arcs[state].get(symbol)
        if out is None:
            child, token, kept, last, gain = self._child, self._token, [], -1, 0
            for node, before, fewer in self._states[state]:
                to = child[node].get(symbol)
                if to is None:
                    continue
                if last < 0 and token[to] >= 0 and self._compatible(before, token[to]):
                    last, gain = token[to], 1 - fewer
                if child[to]:
                    kept.append((to, before, fewer))
            if symbol >= _LAST:
                out = self.start, gain
            else:
                out = self._number((*((to, before, fewer + gain) for to, before, fewer in kept), (0, last, 0))), gain
            self.arcs[state][symbol] = out
        return out

    def run(self, state: int, symbols: list[int]) -> tuple[int, int]:
        """The state after the symbols, and the tokens emitted."""
        arcs, total = self.arcs, 0
        for s in symbols:
            state, gain = arcs[state].get(s) or self.arc(state, s)
            total += gain
        return state, total

    def enter(self, key: tuple) -> int:
        """The number of a state, which may be compiled anew to keep the machine small."""
        if len(self._states) > MAX_STATES or len(self._fits) > MAX_STATES:
            self._restart()
        return self._number(key)

    def key(self, state: int) -> tuple:
        return self._states[state]

    def count(self, word: bytes) -> int:
        """Tokens of a word that is not empty."""
        symbols = [*word[:-1], word[-1] + _LAST]
        if len(symbols) <= CHUNK_BYTES:
            return self.run(self.enter(START), symbols)[1]
        *_, last = self.prefix_counts(symbols)
        return last

    def prefix_counts(self, symbols: list[int]) -> Iterator[int]:
        """Tokens emitted up to the end of each chunk of ``CHUNK_BYTES`` symbols."""
        key, total, known = START, 0, {}
        for first in range(0, len(symbols), CHUNK_BYTES * SCAN_CHUNKS):
            maps = []
            for i in range(first, min(len(symbols), first + CHUNK_BYTES * SCAN_CHUNKS), CHUNK_BYTES):
                chunk = tuple(symbols[i : i + CHUNK_BYTES])
                if chunk not in known:
                    if len(known) >= MAX_MAPS:
                        known.clear()
                    known[chunk] = ChunkMap(self, chunk)
                maps.append(known[chunk])
            ends = [m(key) for m in prefix_scan(maps)]
            yield from (total + n for _, n in ends)
            key, total = ends[-1][0], total + ends[-1][1]


class ChunkMap:
    """A chunk as a map of states, given by their keys, tabulated where it is entered."""

    def __init__(self, machine: Transducer, symbols: tuple[int, ...]) -> None:
        self._machine, self._symbols, self._at = machine, symbols, {}

    def __call__(self, key: tuple) -> tuple[tuple, int]:
        if key not in self._at:
            state, n = self._machine.run(self._machine.enter(key), self._symbols)
            self._at[key] = self._machine.key(state), n
        return self._at[key]


class Composed:
    """First one map, then the other."""

    def __init__(self, first, then) -> None:
        self._first, self._then, self._at = first, then, {}

    def __call__(self, key: tuple) -> tuple[tuple, int]:
        if key not in self._at:
            middle, a = self._first(key)
            end, b = self._then(middle)
            self._at[key] = end, a + b
        return self._at[key]


def prefix_scan(maps: list) -> list:
    """The composition of the maps up to each, in a logarithmic number of rounds whose compositions are independent."""
    shared: dict[tuple[int, int], Composed] = {}
    step, kept = 1, [maps]

    def compose(first, then) -> Composed:
        key = id(first), id(then)
        if key not in shared:
            shared[key] = Composed(first, then)
        return shared[key]

    while step < len(maps):
        maps = [m if i < step else compose(maps[i - step], m) for i, m in enumerate(maps)]
        kept.append(maps)  # an id must not be given again
        step *= 2
    return maps


def scan_constant(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """prefix_scan() of maps that are one number each, for many texts at once: starts has the place of the first chunk of each chunk's text.

    In each round every chunk is composed with the one ``step`` before it, so that each then covers twice as many chunks.
    """
    out, place, step = counts.copy(), np.arange(len(counts)), 1
    longest = int((place - starts).max(initial=0)) + 1
    while step < longest:
        open_ = np.flatnonzero(place - step >= starts)
        out[open_] += out[open_ - step]  # the right side is read whole before it is written
        step *= 2
    return out


class Counter(PieceMemo):
    """Token counts of whole texts, with a bounded memory of the maps of words."""

    def __init__(self, vocab: WordVocabulary) -> None:
        self.machine = Transducer(vocab)
        super().__init__(vocab)

    def forget(self) -> None:
        self.tokens = np.zeros(0, np.int64)

    def learn(self, new: list) -> None:
        count = self.machine.count
        more = [count(p.encode("utf-8", "surrogatepass")) if isinstance(p, str) else 1 for p in new]
        self.tokens = np.concatenate((self.tokens, np.array(more, np.int64)))

    def prefix_counts(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the tokens up to the end of each of its chunks."""
        maps = [np.add.reduceat(self.tokens[n], np.arange(0, len(n), CHUNK_PIECES)) if len(n) else self.tokens[:0] for n in self.numbered(texts)]
        if not maps:
            return []
        lengths = np.array([len(m) for m in maps])
        ends = np.cumsum(lengths)
        return np.split(scan_constant(np.concatenate(maps), np.repeat(ends - lengths, lengths)), ends[:-1])

    def counts(self, texts: list[str | None]) -> list[int]:
        return [int(p[-1]) if len(p) else 0 for p in self.prefix_counts(texts)]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One machine for each Python worker and tokenizer file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every text; one row for each row of ``docs``."""

    def run(batches):
        machine = counter(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(machine.counts(texts.to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def chunk_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, chunk (from 0), tokens_through: the tokens up to the end of each chunk of each text, as the scan finds them."""

    def run(batches):
        machine = counter(tokenizer)
        for batch in batches:
            found = machine.prefix_counts(batch.column(1).to_pylist())
            lengths = [len(f) for f in found]
            owner, chunk = np.repeat(np.arange(len(found)), lengths), np.concatenate([np.arange(n) for n in lengths] or [np.zeros(0)])
            through = np.concatenate(found or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(chunk, pa.int32()), pa.array(through, pa.int64())], ["doc_id", "chunk", "tokens_through"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunk int, tokens_through long")
