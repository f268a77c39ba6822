"""The public word tokenizer: its pieces of a text, and its vocabulary and merge ranks as integers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .common import MEMO_WORDS, Memo, blocks

#: Letters, digits and white space below U+0100, in lower case where there is one: for such texts the tokenizer's own
#: pattern (contractions, letter runs, single digits, other runs) is written out here; all others go through the library.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_DIGITS = "0-9²³¹¼-¾"
_BLANKS = "\t-\r \u0085 "
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+")
_WIDE = re.compile("[^\x00-\xff]")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class WordVocabulary:
    """Pieces, ids, merges of a tokenizer file of words with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._library = Tokenizer.from_file(path)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.token_of = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of.update({i: t for t, i in self.special.items()})
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._mark = min(t[:2] for t in self.special) if self.special else "\0"
        chars = byte_chars()
        #: id of a byte inside a word, and of a byte that ends one
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        self.left, self.right, self.both = np.array(merges, np.int64).T
        self.byte_of_char = {c: b for b, c in enumerate(chars)}
        pairs = self.left << 20 | self.right
        self._order = np.argsort(pairs, kind="stable")
        self._pairs = pairs[self._order]
        #: ranks whose merge may overlap itself, or yield a symbol that has a pair of lower rank
        lowest = np.full(len(vocab) + len(self.special) + 1, len(merges))
        np.minimum.at(lowest, self.left, np.arange(len(merges)))
        np.minimum.at(lowest, self.right, np.arange(len(merges)))
        self.one_by_one = (self.left == self.right) | (lowest[self.both] <= np.arange(len(merges)))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 for none."""
        pairs = left << 20 | right
        at = np.minimum(np.searchsorted(self._pairs, pairs), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pairs, self._order[at], -1)

    def pieces(self, text: str | None) -> list:
        """The words of a text, in order; a special token is the pair ("", id)."""
        if not text:
            return []
        if not _WIDE.search(text) and self._mark not in text:
            return _WORDS.findall(text.lower())
        out: list = []
        for part in self._specials.split(text):
            if part in self.special:
                out.append(("", self.special[part]))
            elif part:
                out.extend(self._slow(part))
        return out

    def _slow(self, text: str) -> list[str]:
        to = self.byte_of_char
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(map(to.__getitem__, p)).decode("utf-8", "surrogatepass") for p, _ in found]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordVocabulary:
    """One copy for each Python worker."""
    return WordVocabulary(path)


class PieceMemo:
    """Numbers the distinct pieces of texts; a subclass learns what it needs of each new one, in the order of their numbers."""

    def __init__(self, vocab: WordVocabulary) -> None:
        self.vocab, self.memo = vocab, Memo()
        self.forget()

    def forget(self) -> None:
        """Drop all that was learnt."""
        raise NotImplementedError

    def learn(self, new: list) -> None:
        raise NotImplementedError

    def numbered(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The numbers of each text's pieces."""
        for first, last in blocks(texts):
            if len(self.memo) > MEMO_WORDS:
                self.memo = Memo()
                self.forget()
            get, held = self.memo.__getitem__, []
            for t in texts[first:last]:
                pieces = self.vocab.pieces(t)
                held.append(np.fromiter(map(get, pieces), np.int32, len(pieces)))
            self.learn(self.memo.take())
            yield from held
