"""Vectorised scanning of many texts at once, shared by the token operators.

A block of texts is laid out as one array of code points (or UTF-8 bytes).  Token
boundaries are found with array comparisons and every token gets a 64-bit hash, so that no
Python code runs per character or per token.  Tokens of equal hash are compared byte by
byte before they count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Characters of text that one block holds at most; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000

#: Bytes of a span from which it is hashed by itself.
LONG = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The low bytes of a word, by their number.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point, as the tokenizers' own regular expressions see it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    table = np.zeros(0x110000, dtype=np.uint8)
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    text = "".join(map(chr, points.tolist()))
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            table[points[a:b]] = value
    return table


def padded(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word that begins at each byte; beyond the end there are zeros."""
    room = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", room, strides=(1,))


def span_hashes(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes ``data[begin : begin + length]`` of each span.

    Eight bytes at a time go through a bijective mixer, so that spans of up to eight bytes
    and one length never collide; spans beyond ``LONG`` bytes get a keyed BLAKE2 digest.
    Different seeds give independent hashes.
    """
    words, left = padded(data), lengths.astype(np.int64)
    with np.errstate(over="ignore"):
        hashes = mix(left.astype(np.uint64) * _ODD + np.uint64(seed))
        here, at = np.arange(len(left)), 0
        while len(here):
            size = np.minimum(left[here] - at, 8)
            hashes[here] = mix((hashes[here] ^ (words[begin[here] + at] & _MASKS[np.maximum(size, 0)])) * _ODD + np.uint64(seed))
            at += 8
            here = here[(left[here] > at) & (left[here] <= LONG)]
    key = int(seed).to_bytes(8, "little")
    for i in np.flatnonzero(left > LONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : begin[i] + left[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return hashes


def equal_spans(a: np.ndarray, a_begin: np.ndarray, b: np.ndarray, b_begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes of span i of ``a`` are those of span i of ``b``; both have ``lengths[i]`` bytes."""
    x, y = padded(a), padded(b)
    same = np.ones(len(lengths), dtype=bool)
    here, at = np.flatnonzero(lengths > 0), 0
    while len(here):
        size = np.minimum(lengths[here] - at, 8)
        same[here] &= ((x[a_begin[here] + at] ^ y[b_begin[here] + at]) & _MASKS[size]) == 0
        at += 8
        here = here[(lengths[here] > at) & (lengths[here] <= LONG) & same[here]]
    for i in np.flatnonzero((lengths > LONG) & same).tolist():
        n = lengths[i]
        same[i] = np.array_equal(a[a_begin[i] : a_begin[i] + n], b[b_begin[i] : b_begin[i] + n])
    return same


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def blocks(sizes: np.ndarray, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to ``limit`` at most (or hold one item)."""
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and the offset of each text (one more than texts)."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), out=offsets[1:])
    return data, offsets


def _run_starts(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    start = np.empty(len(classes), dtype=bool)
    start[:1] = True
    np.not_equal(classes[1:], classes[:-1], out=start[1:])
    start |= first
    return start


def _split_contractions(cp: np.ndarray, classes: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
    """Makes 's 't 'm 'd 're 've 'll tokens where an apostrophe alone begins a token."""
    n = len(cp)
    at = np.flatnonzero((cp == 0x27) & start)
    at = at[at + 1 < n]
    at = at[(classes[at + 1] == LETTER) & ~first[at + 1]]
    if not len(at):
        return
    one = cp[at + 1]
    two = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n - 1)], cp[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for chosen, length in ((at[short], 2), (at[long], 3)):
        start[chosen + 1] = False
        if length == 3:
            start[chosen + 2] = False
        after = chosen + length
        start[after[after < n]] = True


def _first_flags(n: int, offsets: np.ndarray) -> np.ndarray:
    first = np.zeros(n, dtype=bool)
    begins = offsets[:-1]
    first[begins[begins < n]] = True
    return first


def spaced_tokens(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of byte-level pre-tokens: words with the blank before them.

    The rule is that of the public byte-level pattern (see the tokenizers' README):
    contractions, then an optional blank with letters, numbers or other characters,
    then white space, whose last character is left to the next token.
    """
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    classes, first = character_classes()[cp], _first_flags(len(cp), offsets)
    start = _run_starts(classes, first)
    heads = np.flatnonzero(start & (classes != SPACE) & ~first)
    heads = heads[heads > 0]
    heads = heads[classes[heads - 1] == SPACE]
    start[heads - 1] = True
    start[heads] = cp[heads - 1] != 0x20
    _split_contractions(cp, classes, start, first)
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], len(cp))


def word_tokens(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: contractions, letters, one number, or other characters."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    classes, first = character_classes()[cp], _first_flags(len(cp), offsets)
    start = _run_starts(classes, first)
    start |= classes == NUMBER
    _split_contractions(cp, classes, start, first)
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(cp))
    keep = classes[starts] != SPACE
    return starts[keep], ends[keep]


def distinct(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each span of bytes, the hash of each code, and the span where it occurs first.

    Spans have one code if and only if their bytes are equal, whatever their hashes.
    """
    import pandas as pd

    codes, values = pd.factorize(span_hashes(data, begin, lengths))
    where = np.empty(len(values), dtype=np.int64)
    where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    first = where[codes]
    other = lengths != lengths[first]
    other[~other] = ~equal_spans(data, begin[~other], data, begin[first[~other]], lengths[~other])
    if other.any():
        hashes, own, more = values[codes], {}, []
        for i in np.flatnonzero(other).tolist():
            span = data[begin[i] : begin[i] + lengths[i]].tobytes()
            if span not in own:
                own[span] = len(values) + len(more)
                more.append(i)
            codes[i] = own[span]
        values, where = np.append(values, hashes[more]), np.append(where, more)
    return codes, values, where


def byte_spans(cp: np.ndarray, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all of ``cp`` (which ``text`` holds), and where spans of it begin and their lengths."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(text) == len(cp):
        return data, starts, ends - starts
    at = np.zeros(len(cp) + 1, dtype=np.int64)
    np.cumsum(1 + (cp >= 0x80).astype(np.uint8) + (cp >= 0x800) + (cp >= 0x10000), out=at[1:])
    return data, at[starts], at[ends] - at[starts]


def ragged(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``begin[i] .. begin[i] + lengths[i] - 1`` for each i, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begin - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Memo:
    """Numbers remembered by spans of bytes, found by hash; full beyond ``limit`` spans or ``room`` bytes.

    A span whose hash a different one holds already isn't found, however often it is added.
    """

    def __init__(self, limit: int, room: int = 64 * 2**20) -> None:
        self.limit, self.room = limit, room
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.values = np.zeros(0, dtype=np.int64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.data = np.zeros(1 << 16, dtype=np.uint8)
        self.used = 0

    def find(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans of ``data`` are known, and the values of those (others: any number)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = (self.hashes[at] == hashes) & (self.lengths[at] == lengths)
        here = at[known]
        known[known] = equal_spans(data, begin[known], self.data, self.begin[here], lengths[known])
        return known, self.values[at]

    def add(self, hashes: np.ndarray, packed: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> None:
        """Adds spans that aren't known, whose bytes lie in ``packed`` one after the other."""
        while self.used + len(packed) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.used : self.used + len(packed)] = packed
        begin = self.used + np.cumsum(lengths) - lengths
        self.used += len(packed)
        merged = np.concatenate([self.hashes, hashes])
        order = np.argsort(merged, kind="stable")
        self.hashes, self.values = merged[order], np.concatenate([self.values, values])[order]
        self.begin, self.lengths = np.concatenate([self.begin, begin])[order], np.concatenate([self.lengths, lengths])[order]

    def full(self) -> bool:
        return len(self.hashes) > self.limit or self.used > self.room
