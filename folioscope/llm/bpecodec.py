"""BPE encoding and decoding of whole texts.

Method: texts are normalised and split into words; the distinct words of a block are
encoded together in numpy merge rounds (see ``bpe``), and the ids of each document are
gathered from those of its words.  Decoding joins the pieces of the ids.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.normalizers import NFC, Lowercase

from folioscope.llm import bpe, textscan
from folioscope.llm.batches import small_batches
from folioscope.llm.tokencount import split_specials

#: From here on, Unicode has case pairs that Python's own tables may lack.
NEWER = "\u1c80"
#: Distinct words and ids of them that a task remembers before it starts to forget.
REMEMBERED = 400_000


def normalise(text: str) -> str:
    """Canonical composition, then each character in lower case."""
    if text.isascii():
        return text.lower()
    if max(text) < NEWER:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()
    return Lowercase().normalize_str(NFC().normalize_str(text))


class Encoder:
    """Encodes many texts; remembers the ids and pieces of distinct words."""

    def __init__(self, model: bpe.BpeModel) -> None:
        self.model = model
        self.pieces = np.empty(max(model.pieces) + 1, dtype=object)
        for i, piece in model.pieces.items():
            self.pieces[i] = piece.encode()
        self.forget()

    def forget(self) -> None:
        self.number = textscan.Memo(REMEMBERED)
        self.decoded: list[bytes] = []
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.offsets = np.zeros(1 << 14, dtype=np.int64)

    def _learn(self, data: np.ndarray, lengths: np.ndarray) -> None:
        """Appends the ids and pieces of new words."""
        ids, offsets = self.model.encode_words(data, lengths)
        have, used, more = len(self.decoded), int(self.offsets[len(self.decoded)]), len(lengths)
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while have + more + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.ids[used : used + len(ids)] = ids
        self.offsets[have + 1 : have + more + 1] = used + offsets[1:]
        pieces, bounds = self.pieces[ids].tolist(), offsets.tolist()
        self.decoded += [b" ".join(pieces[a:b]) for a, b in zip(bounds, bounds[1:])]

    def _words(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the segments, and where each segment's words begin."""
        cp, offsets = textscan.code_points(segments)
        starts, ends = textscan.word_tokens(cp, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        data, begin, lengths = textscan.byte_spans(cp, "".join(segments).encode(), starts, ends)
        codes, hashes, where = textscan.distinct(data, begin, lengths)
        begin, lengths = begin[where], lengths[where]
        if self.number.full():
            self.forget()
        known, numbers = self.number.find(hashes, data, begin, lengths)
        if not known.all():
            new = ~known
            numbers[new] = len(self.decoded) + np.arange(int(new.sum()))
            packed = data[textscan.ragged(begin[new], lengths[new])]
            self._learn(packed, lengths[new])
            self.number.add(hashes[new], packed, lengths[new], numbers[new])
        return numbers[codes], np.searchsorted(starts, offsets)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of each text as little-endian 32-bit integers, and their decoded text."""
        parts = [split_specials(t, self.model.specials) for t in texts]
        segments = [normalise(p) for x in parts for p in x if isinstance(p, str)]
        numbers, begins = self._words(segments)
        lengths = self.offsets[numbers + 1] - self.offsets[numbers]
        ids = self.ids[textscan.ragged(self.offsets[numbers], lengths)].astype("<u4")
        id_at = np.append(0, np.cumsum(lengths))
        words = np.array([*self.decoded, None], dtype=object)[numbers].tolist()
        out_ids, out_text, k = [], [], 0
        for x in parts:
            row_ids, row_text = [], []
            for p in x:
                if isinstance(p, int):
                    row_ids.append(np.array([p], dtype="<u4").tobytes())
                    row_text.append(self.pieces[p])
                else:
                    a, b = int(begins[k]), int(begins[k + 1])
                    row_ids.append(ids[id_at[a] : id_at[b]].tobytes())
                    row_text += words[a:b]
                    k += 1
            out_ids.append(row_ids[0] if len(row_ids) == 1 else b"".join(row_ids))
            out_text.append(b" ".join(row_text))
        return out_ids, out_text


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``id_col``, ``n_tokens`` long, ``ids`` binary, ``decoded`` string), one per input row.

    ``tokenizer`` is the path of a lower-casing word BPE file, the same on every executor.
    ``ids`` holds little-endian unsigned 32-bit integers (``numpy.frombuffer(ids, "<u4")``);
    ``decoded`` is what the file's decoder makes of them: the pieces, joined by blanks.
    A null text counts as empty: no ids and an empty decoded text.  A null id stays null;
    repeated rows give repeated results; an empty table gives an empty one; other columns,
    whatever their names, are not read.
    """
    schema = df.select(F.col(id_col)).schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(bpe.load(tokenizer))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            for a, b in textscan.blocks(sizes):
                ids, decoded = encoder.encode(texts[a:b])
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), counts, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())], names=schema.names)

    return small_batches(df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with column ``to``: the text of the ids of ``ids_col``; null ids give null.

    A column of that name is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = bpe.load(tokenizer).pieces
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = [None if x is None else " ".join(pieces[i] for i in np.frombuffer(x, "<u4").tolist()) for x in rows]
            kept = [i for i, name in enumerate(batch.schema.names) if name != to]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(texts, pa.string())], names=[*(batch.schema.names[i] for i in kept), to])

    schema = df.drop(to).schema.add(to, "string")
    return small_batches(df).mapInArrow(run, schema)
