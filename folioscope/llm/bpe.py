"""Byte-pair merges over many words at once, in numpy rounds.

The symbols of all words lie in one flat array.  The rank of each adjacent pair is found
by binary search over sorted pair keys.  In a round, every word merges all occurrences of
its lowest-ranked pair; only pairs beside a merge are looked up again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

NO_RANK = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class BpeModel:
    """Vocabulary and merges of a tokenizer file, laid out for array lookups."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        chars = byte_characters()
        self.byte_ids = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.last_ids = np.array([vocab[c + self.suffix] for c in chars], dtype=np.int32)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        keys, ranks, merged = keys[order], order.astype(np.int32), merged[order]
        # a pair listed twice counts with its later rank, as a map filled in order does
        last = np.append(keys[1:] != keys[:-1], True)
        self.keys, self.ranks, self.merged = keys[last], ranks[last], merged[last]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK), self.merged[at]

    def encode_words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the offset of each word (one more than words).

        ``data`` has the bytes of the words one after the other, ``lengths`` their numbers.
        """
        done = list(self._merged(data, lengths))
        symbols = np.concatenate([self.byte_ids[:0], *(s for s, _ in done)])
        word = np.concatenate([np.zeros(0, np.int32), *(w for _, w in done)])
        order = np.argsort(word, kind="stable")
        symbols, word = symbols[order], word[order]
        offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(np.bincount(word, minlength=len(lengths)), out=offsets[1:])
        return symbols, offsets

    def count_pieces(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of pieces of each word; their ids are dropped as words are finished."""
        counts = np.zeros(len(lengths), dtype=np.int64)
        for _, word in self._merged(data, lengths):
            counts += np.bincount(word, minlength=len(lengths))
        return counts

    def _merged(self, data: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Symbols, with their words, of those words that no merge applies to any more, round by round."""
        count = len(lengths)
        symbols = self.byte_ids[data]
        if self.suffix:
            tails = np.cumsum(lengths)[lengths > 0] - 1
            symbols[tails] = self.last_ids[data[tails]]
        word = np.repeat(np.arange(count, dtype=np.int32), lengths)
        rank = np.full(len(symbols), NO_RANK, dtype=np.int32)
        into = np.zeros(len(symbols), dtype=np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], into[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(heads, len(symbols)))
            best = np.minimum.reduceat(rank, heads)
            live = best != NO_RANK
            if not live.all():
                keep = np.repeat(live, sizes)
                yield symbols[~keep], word[~keep]
                symbols, word, rank, into = symbols[keep], word[keep], rank[keep], into[keep]
                best, sizes = best[live], sizes[live]
                if not len(symbols):
                    break
            chosen = rank == np.repeat(best, sizes)
            if (chosen[1:] & chosen[:-1]).any():
                chosen = _alternate(chosen)
            at = np.flatnonzero(chosen)
            symbols[at] = into[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            stale = chosen
            stale[at[at > 0] - 1] = True
            # of two merges side by side, the symbol between them is gone
            first = at[1:][at[1:] - at[:-1] == 2] - 2
            stale[first] = True
            symbols, word, rank, into, stale = symbols[keep], word[keep], rank[keep], into[keep], stale[keep]
            look = np.flatnonzero(stale)
            last = look + 1 >= len(symbols)
            inside = ~last & (word[look] == word[np.where(last, 0, look + 1)])
            rank[look[~inside]] = NO_RANK
            look = look[inside]
            rank[look], into[look] = self._ranks(symbols[look], symbols[look + 1])


def _alternate(chosen: np.ndarray) -> np.ndarray:
    """Of each run of adjacent choices, the first, third and so on: pairs can't overlap."""
    index = np.arange(len(chosen))
    begins = chosen & ~np.append(False, chosen[:-1])
    run = np.maximum.accumulate(np.where(begins, index, -1))
    return chosen & ((index - run) % 2 == 0)


@lru_cache(maxsize=4)
def load(path: str) -> BpeModel:
    return BpeModel(path)
