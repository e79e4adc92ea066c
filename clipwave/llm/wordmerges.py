"""Tokens of many words at once: the merges of a BPE file, one for each word and step.

Words are rows of a matrix of tokens, grouped by their number of tokens. Going from the longest to the
shortest, each row undergoes its earliest possible merge (the leftmost, if it is possible twice) and so
joins the rows that have one token less; rows where no merge is possible are done. This is
the reference algorithm itself, as merge ranks are token ids; a step is a few array operations for all words of a length.

Edge cases: an empty list gives an empty one; words of over ``MOST_BYTES`` bytes, which would
make wide matrices of few rows, are left to the encoder of single words.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain, filterfalse

import numpy as np

from .bpe import END, REMEMBERED, Bpe, load

MOST_BYTES = 48
#: No merge: behind all ranks.
NONE = np.iinfo(np.int32).max


class WordMerges:
    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.size = bpe, len(bpe.parts)
        letters = [bpe.ids.get(c + end, -1) for end in ("", END) for c in bpe.letters]
        #: Tokens of the bytes of a word, and of its last byte (256 more); pairs of them by a table.
        self.letters = np.array(letters, dtype=np.int32)
        self.whole = min(letters) >= 0
        self.first = np.array([[bpe.merged.get((a, b), NONE) for b in letters] for a in letters[:256]], dtype=np.int32)
        pairs = sorted((a * self.size + b, i) for (a, b), i in bpe.merged.items())
        self.pairs, self.merged = (np.array(c, dtype=np.int64) for c in zip(*pairs, strict=True))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.merged[at], NONE).astype(np.int32)

    def encode(self, words: list[str]) -> list[bytes]:
        """Token ids of each word, as int32 bytes."""
        raw = [w.encode() for w in words]
        sizes = np.array(list(map(len, raw)), dtype=np.int64)
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        flat[ends - 1] += 256
        out: list[bytes] = [b""] * len(words)
        who, tokens, ranks = np.empty(0, np.int64), np.empty((0, 0), np.int32), np.empty((0, 0), np.int32)
        for n in range(int(sizes.max(initial=0)), 0, -1):
            own = np.flatnonzero(sizes == n)
            new = flat[(ends - n)[own][:, None] + np.arange(n)]
            who = np.concatenate([who, own])
            tokens = np.concatenate([tokens.reshape(-1, n), self.letters[new]])
            if n == 1:
                self.give(out, who, tokens)
                break
            ranks = np.concatenate([ranks.reshape(-1, n - 1), self.first[new[:, :-1], new[:, 1:]]])
            place = ranks.argmin(axis=1)
            low = ranks[np.arange(len(who)), place]
            done = low == NONE
            self.give(out, who[done], tokens[done])
            who, tokens, ranks, place, low = who[~done], tokens[~done], ranks[~done], place[~done], low[~done]
            row = np.arange(len(who))
            tokens[row, place] = low
            tokens = self.without(tokens, row, place + 1)
            ranks = self.without(ranks, row, place)
            left, right = np.flatnonzero(place > 0), np.flatnonzero(place < n - 2)
            p = place[left]
            ranks[left, p - 1] = self.ranks(tokens[left, p - 1], low[left])
            p = place[right]
            ranks[right, p] = self.ranks(low[right], tokens[right, p + 1])
        return out

    @staticmethod
    def without(table: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Each row without its entry at ``place``."""
        keep = np.ones(table.shape, dtype=bool)
        keep[row, place] = False
        return table[keep].reshape(len(table), table.shape[1] - 1)

    @staticmethod
    def give(out: list[bytes], who: np.ndarray, tokens: np.ndarray) -> None:
        step = 4 * tokens.shape[1]
        data = np.ascontiguousarray(tokens, dtype=np.int32).tobytes()
        for k, w in enumerate(who.tolist()):
            out[w] = data[k * step : (k + 1) * step]

    def learn(self, words: Iterable[str]) -> None:
        """Put the words that the encoder doesn't remember yet into its table."""
        known = self.bpe.words
        if len(known) >= REMEMBERED:
            known.older = dict(known)
            known.clear()
        new = []
        for w in set(filterfalse(known.__contains__, words)):
            ids = known.older.get(w)
            if ids is not None:
                known[w] = ids
            elif len(w) * 4 <= MOST_BYTES or len(w) <= MOST_BYTES and len(w.encode()) <= MOST_BYTES:
                new.append(w)
        known.update(zip(new, self.encode(new), strict=True))

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids (int32) of each text, as ``Bpe.encode`` gives them; the words of all are learned first."""
        special = self.bpe.at_special is not None
        plain = [None if not t or (special and "<|" in t) else self.bpe.split(t) for t in texts]
        if self.whole:
            self.learn(chain.from_iterable(filter(None, plain)))
        ids = self.bpe.words.__getitem__
        return [self.bpe.encode(t) if words is None else np.frombuffer(b"".join(map(ids, words)), dtype=np.int32) for t, words in zip(texts, plain, strict=True)]


def merges(path: str) -> WordMerges:
    """Tables of a file, with its encoder, once for each Python worker."""
    bpe = load(path)
    if not hasattr(bpe, "word_merges"):
        bpe.word_merges = WordMerges(bpe)
    return bpe.word_merges
