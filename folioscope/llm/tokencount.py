"""Token counts of texts without materialising token ids.

Method: a block of texts is split into pre-tokens, which are counted into a table
(document, distinct pre-token, frequency).  The pieces of each distinct pre-token are
counted once, by merges that keep numbers only; that table is joined to the frequencies by
pre-token, and pieces times frequency are summed for each document.  A task remembers the
counts of pre-tokens that it has met, each compared byte by byte.  The join runs within
tasks: over the cluster it would shuffle the pre-tokens of every document, and the commonest
ones would meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import bpe, textscan
from folioscope.llm.batches import small_batches

#: Distinct pre-tokens that a task remembers before it starts to forget (and recount).
REMEMBERED = 1_000_000


def split_specials(text: str, specials: dict[str, int]) -> list[str | int]:
    """The text between special strings, and the ids of those, in order."""
    parts: list[str | int] = [text]
    for special, number in specials.items():
        if special in text:
            parts = [y for x in parts for y in (_around(x, special, number) if isinstance(x, str) else [x])]
    return parts


def _around(text: str, special: str, number: int) -> list[str | int]:
    out: list[str | int] = []
    for k, piece in enumerate(text.split(special)):
        out += [number, piece] if k else [piece]
    return out


class PieceCounter:
    """Counts the pieces of many texts; remembers the counts of distinct pre-tokens."""

    def __init__(self, model: bpe.BpeModel) -> None:
        self.model = model
        self.known = textscan.Memo(REMEMBERED)

    def _piece_counts(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Pieces of distinct pre-tokens, of which new ones are merged together."""
        if self.known.full():
            self.known = textscan.Memo(REMEMBERED)
        known, values = self.known.find(hashes, data, begin, lengths)
        if not known.all():
            new = ~known
            packed = data[textscan.ragged(begin[new], lengths[new])]
            values[new] = self.model.count_pieces(packed, lengths[new])
            self.known.add(hashes[new], packed, lengths[new], values[new])
        return values

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        totals = np.zeros(len(texts), dtype=np.int64)
        segments, owner = list(texts), np.arange(len(texts))
        if self.model.specials:
            marked = [i for i, t in enumerate(texts) if any(s in t for s in self.model.specials)]
            for i in marked:
                parts = split_specials(texts[i], self.model.specials)
                totals[i] += sum(isinstance(p, int) for p in parts)
                pieces = [p for p in parts if isinstance(p, str)]
                segments[i] = pieces[0]
                segments += pieces[1:]
                owner = np.append(owner, np.full(len(pieces) - 1, i))
        cp, offsets = textscan.code_points(segments)
        starts, ends = textscan.spaced_tokens(cp, offsets)
        if not len(starts):
            return totals
        data, begin, lengths = textscan.byte_spans(cp, "".join(segments).encode(), starts, ends)
        token, hashes, where = textscan.distinct(data, begin, lengths)
        pieces = self._piece_counts(hashes, data, begin[where], lengths[where])
        document = owner[np.searchsorted(offsets, starts, side="right") - 1]
        # the table (document, token, frequency), joined to the pieces by token
        pairs, frequency = np.unique(document * len(where) + token, return_counts=True)
        document, token = np.divmod(pairs, len(where))
        np.add.at(totals, document, pieces[token] * frequency)
        return totals


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``id_col``, ``n_bytes`` long, ``n_tokens`` long), one for each input row.

    ``tokenizer`` is the path of a byte-level BPE file, the same on every executor.
    Special strings inside a text count as one token.  A null text counts as empty: 0
    bytes, 0 tokens.  A null id stays null; repeated rows give repeated results; an empty
    table gives an empty one; other columns, whatever their names, are not read.
    """
    schema = df.select(F.col(id_col)).schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(bpe.load(tokenizer))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            counts = [counter.count(texts[a:b]) for a, b in textscan.blocks(sizes)]
            n_bytes = np.fromiter((len(t.encode("utf-8")) for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(np.concatenate(counts) if counts else n_bytes)], names=schema.names)

    return small_batches(df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))).mapInArrow(run, schema)
