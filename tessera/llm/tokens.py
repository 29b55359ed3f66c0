"""Token ids of whole texts by a public tokenizer file, a word at a time, with compact memory of what has been seen."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import xxhash

from .common import split_words


class _Table:
    """64-bit key: a short run of 16-bit ids. Sorted arrays, about 20 bytes a key; a small young one is merged in now and then."""

    YOUNG = 200_000

    def __init__(self, limit: int):
        self.limit = limit
        self.parts = [self._empty(), self._empty()]  # old, young: sorted keys, first id, ids
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    @staticmethod
    def _empty() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id, ids) of each key, ids -1 where it is unknown."""
        first, count = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for known, start, number in self.parts:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                first[hit], count[hit] = start[at[hit]], number[at[hit]]
        return first, count

    def forgets_for(self, new: int) -> bool:
        """Whether so many more keys are too many; then all is forgotten, which costs time only."""
        over = sum(len(p[0]) for p in self.parts) + new > self.limit
        if over:
            self.parts, self.used = [self._empty(), self._empty()], 0
        return over

    def add(self, keys: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """New keys, each once, with their ids in turn."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), len(self.pool)), np.uint16)])
        self.pool[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(count) - count
        self.used += len(ids)
        young = [np.concatenate(x) for x in zip(self.parts[1], (keys, start, count))]
        if len(young[0]) > self.YOUNG:
            young = [np.concatenate(x) for x in zip(self.parts[0], young)]
            self.parts[1] = self._empty()
            into = 0
        else:
            into = 1
        order = np.argsort(young[0])
        self.parts[into] = tuple(x[order] for x in young)

    def ids(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The ids of found keys in turn."""
        ends = np.cumsum(count)
        return self.pool[np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


class WordTokens:
    """Ids of texts by a tokenizer whose pattern never matches across white space: a text's ids are those of its words in turn.

    Words and their pieces go by 64-bit hashes. Letters beyond Latin and special tokens go to the tokenizer as they are.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"  # fixed value: the file's own pattern

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces_of = regex.compile(self.PATTERN).findall
        self.plain = regex.compile(r"[\x21-ɏ]+").fullmatch
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        assert max(vocab.values()) < 1 << 16
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words, self.pieces = _Table(3_000_000), _Table(2_000_000)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def _pieces(self, w: bytes) -> tuple[bytes, ...] | None:
        """The pattern's matches in a lower-cased word; None if the tokenizer must see the word itself."""
        core = w.rstrip(b".,!?;:*$%&#|)")
        if core.isalpha():  # ASCII letters, then perhaps one run of marks
            return (core.lower(),) if len(core) == len(w) else (core.lower(), w[len(core) :])
        s = w.decode("utf-8")
        if "<|" in s or not self.plain(s):
            return None
        return tuple(p.encode() for p in self.pieces_of(s.lower()))

    def _learn(self, words: list[bytes], keys: np.ndarray) -> None:
        split = [self._pieces(w) for w in words]
        fresh = list(set(chain.from_iterable(p for p in split if p)))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))
        new = self.pieces.find(hashes)[1] < 0
        if new.any():
            if self.pieces.forgets_for(int(new.sum())):
                new[:] = True
            names = [fresh[i] for i in np.flatnonzero(new).tolist()]
            ids = self._ids(b" ".join(names).decode("utf-8"))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(names) or cuts[-1] != len(ids):  # a piece that ends otherwise: one by one
                each = [self._ids(p.decode("utf-8")) for p in names]
                ids, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            self.pieces.add(hashes[new], np.diff(cuts, prepend=0), ids)
        whole = {i: self._ids(words[i].decode("utf-8")) for i, p in enumerate(split) if p is None}
        number = np.array([1 if p is None else len(p) for p in split], np.int64)
        flat = np.fromiter((xxhash.xxh3_64_intdigest(p) for own in split if own for p in own), np.uint64)
        first, count = self.pieces.find(flat)
        ids = self.pieces.ids(first, count)
        if whole:  # rare: put these between the others
            cuts = np.concatenate([[0], np.cumsum(count)])
            at, parts, counts = 0, [], []
            for i, p in enumerate(split):
                own = whole[i] if p is None else ids[cuts[at] : cuts[at + len(p)]]
                at += 0 if p is None else len(p)
                parts.append(own)
                counts.append(len(own))
            self.words.add(keys, np.array(counts, np.int64), np.concatenate(parts))
        else:
            ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum(number)]
            self.words.add(keys, np.diff(ends, prepend=0), ids)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's start, and the end)."""
        split = [split_words(t) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        n = int(offsets[-1])
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, n)
        keys, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        first, count = self.words.find(keys)
        new = count < 0
        if new.any():
            if self.words.forgets_for(int(new.sum())):
                new[:] = True
            text = np.searchsorted(offsets, at[new], "right") - 1
            self._learn([split[t][i] for t, i in zip(text.tolist(), (at[new] - offsets[text]).tolist())], keys[new])
            first, count = self.words.find(keys)
        each = count[back]
        return self.words.ids(first[back], each), np.concatenate([[0], np.cumsum(each)])[offsets]


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One for each Python worker and file."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]
