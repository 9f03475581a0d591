"""Language identification by nearest centroid.

Method: a text becomes a normalised TF-IDF vector of hashed character n-grams (one to
three letters, words padded with a blank).  Each language has several centroids, found by
spherical k-means over a bounded sample of its labelled texts.  The language of the
nearest centroid by cosine is predicted; a text that is further from that centroid than
texts of about its length are, as learned from the sample, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioscope.llm import textscan
from folioscope.llm.batches import runs, small_batches
from folioscope.operators.components import checkpointed

#: Length of a hashed vector.
DIMENSIONS = 4096
#: Labelled texts of a language that its centroids are fitted on at most.
SAMPLE = 400
#: Centroids of each language.
CENTROIDS = 4
#: A text is rejected if its cosine is below this part of the lowest percentile of held-out texts.
TOLERANCE = 0.75
#: Limits are learned for texts of so many letters and more, up to the next number; junk comes no nearer beyond.
BANDS = 2 ** np.arange(1, 9)
#: Cosines that the limit of a band needs, or it is that of the band before.
ENOUGH = 20
#: Parts of the sample; each is held against centroids of the others to learn limits.
FOLDS = 5
UNKNOWN = "und"


def gram_counts(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, shape (texts, dimensions), and the letters of each text."""
    cp, offsets = textscan.code_points([t.lower() + " " for t in texts])
    letter = textscan.character_classes()[cp] == textscan.LETTER
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    letters = np.bincount(owner[letter], minlength=len(texts))
    symbol = np.where(letter, cp, 0x20).astype(np.uint64)
    before = np.append(np.uint64(0x20), symbol[:-1])
    before2 = np.append(np.uint64(0x20), before[:-1])
    start = offsets[:-1][offsets[:-1] < len(cp)]
    before[start] = before2[start] = 0x20
    inner = np.minimum(start + 1, len(cp) - 1)
    before2[inner] = 0x20
    # a pair of symbols that aren't letters is no n-gram
    pair = letter | (before != 0x20)
    triple = pair & (before != 0x20)
    out = np.zeros(len(texts) * dimensions, dtype=np.float32)
    with np.errstate(over="ignore"):
        for n, keep in ((1, letter), (2, pair), (3, triple)):
            value = symbol[keep]
            if n > 1:
                value = value | (before[keep] << np.uint64(21))
            if n > 2:
                value = value | (before2[keep] << np.uint64(42))
            cell = textscan.mix(value * np.uint64(4) + np.uint64(n)) % np.uint64(dimensions)
            out += np.bincount(owner[keep] * dimensions + cell.astype(np.int64), minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), dimensions), letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    """Fitted centroids. ``labels[i]`` is the language of row i of ``centroids``, and row i of ``radius`` has its lowest cosine for each of ``BANDS``."""

    labels: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    radius: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """Language, score from 0 to 1, and whether the text is rejected."""
        if not texts:
            return []
        counts, letters = gram_counts(texts)
        if not len(self.labels):
            return [(UNKNOWN, 0.0, bool(n == 0)) for n in letters]
        cosine = self.vectors(counts) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        none = letters == 0
        band = np.searchsorted(BANDS, letters, side="right") - 1
        far = none | ((band >= 0) & (score < self.radius[best, np.maximum(band, 0)]))
        return [(UNKNOWN, 0.0, True) if n else (self.labels[b], float(s), bool(f)) for b, s, f, n in zip(best, score, far, none, strict=True)]


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun at spread-out members."""
    centres = _unit(x.mean(axis=0, keepdims=True))
    centres = x[np.argmax(x @ centres.T, axis=0)]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[nearest == i].sum(axis=0) if (nearest == i).any() else centres[i] for i in range(len(centres))])
        centres = _unit(sums)
    return centres


def _blank() -> LanguageModel:
    return LanguageModel([], np.zeros((0, DIMENSIONS)), np.ones(DIMENSIONS), np.zeros((0, len(BANDS))))


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts (column 0) with a letter, and of those with each hashed n-gram; every text counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # cell 0 counts texts, the others n-grams
        held = np.zeros(DIMENSIONS + 1, dtype=np.int64)
        for batch in batches:
            own = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in textscan.blocks(np.fromiter((len(t) + 2000 for t in own), np.int64, len(own)), 1_000_000):
                found, letters = gram_counts(own[a:b])
                held[0] += int((letters > 0).sum())
                held[1:] += (found[letters > 0] > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held)], names=["cell", "n"])

    summed = small_batches(texts).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    for r in summed:
        out[r["cell"]] = r["n"]
    return int(out[0]), out[1:]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> LanguageModel:
    """A model of every label: its centroids, from ``sample`` of its texts at most, chosen by a hash of the id.

    Inverse document frequencies are those of all labelled texts.  The centroids of a label
    are found in one task, from counts of fixed length of its bounded sample; the driver gets
    centroids only, some 0.4 MB a label.  Limits of distance come from ``FOLDS`` parts of the
    sample, each held against centroids of the others, whole and cut to the shorter lengths
    of ``BANDS``; one text in a hundred may be mislabelled junk.  Rows without text or label
    are passed over.  With no labelled row at all, the model knows no language and rejects
    only texts without a letter.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where("text is not null and label is not null")
    documents, having = document_frequencies(rows.select("text"))
    if not documents:
        return _blank()
    idf = (np.log((1 + documents) / (1 + having)) + 1).astype(np.float32)
    order = F.xxhash64("id", F.lit("language sample"))
    window = Window.partitionBy("label").orderBy(order, "id", F.md5("text"))
    # hashes are ranked without the texts; each label's last one then cuts the texts where they are read
    ranked = rows.select("label", order.alias("o")).withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("o"))).where(F.col("k") <= sample)
    cuts = ranked.groupBy("label").agg(F.max("o").alias("last")).collect()
    last = F.create_map(*(F.lit(x) for r in cuts for x in (r["label"], r["last"])))[F.col("label")]
    drawn = rows.where(order <= last)
    drawn = checkpointed(drawn.select("label", "text", F.row_number().over(window).alias("k")).where(F.col("k") <= sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in textscan.blocks(np.fromiter((len(t) + 2000 for t in texts), np.int64, len(texts)), 1_000_000):
                found, letters = gram_counts(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(letters), pa.array([x.tobytes() for x in found], pa.binary())], names=["label", "k", "letters", "counts"])

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches):
            place = own.column("k").to_numpy()
            counted = np.stack([np.frombuffer(c, np.float32) for c in own.column("counts").to_pylist()])
            vectors = _unit(np.log1p(counted) * idf)
            whole = _kmeans(vectors, centroids)
            parts = [whole] + [_kmeans(vectors[place % FOLDS != f], centroids) if (place % FOLDS != f).any() else whole for f in range(FOLDS)]
            names = ["label", "fold", "centroids"]
            yield pa.RecordBatch.from_arrays([pa.array([own.column(0)[0].as_py()] * len(parts)), pa.array(range(-1, FOLDS), pa.int32()), pa.array([c.astype(np.float32).tobytes() for c in parts], pa.binary())], names=names)

    counted = small_batches(drawn).mapInArrow(count, "label string, k int, letters long, counts binary").where("letters > 0")
    found = small_batches(counted.repartition("label").sortWithinPartitions("label", "k")).mapInArrow(centred, "label string, fold int, centroids binary").collect()
    held = {(r["label"], r["fold"]): np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMENSIONS) for r in found}
    labels = sorted({label for label, _ in held})
    if not labels:
        return _blank()
    of_fold = [np.concatenate([held[label, fold] for label in labels]) for fold in range(-1, FOLDS)]
    names = [label for label in labels for _ in held[label, -1]]
    model = LanguageModel(names, of_fold[0], idf, np.zeros((len(names), len(BANDS))))
    return replace(model, radius=_limits(drawn, model, of_fold[1:]))


def _cuts(text: str) -> list[tuple[int, str]]:
    """A text cut to each number of letters in ``BANDS`` but the last that it has, and the whole, each with its band."""
    cp, _ = textscan.code_points([text])
    at = np.flatnonzero(textscan.character_classes()[cp] == textscan.LETTER)
    bands = int(np.searchsorted(BANDS, len(at), side="right"))
    return [*((i, text[: at[BANDS[i] - 1] + 1]) for i in range(min(bands, len(BANDS) - 1))), *([(bands - 1, text)] if bands else [])]


def _limits(drawn: DataFrame, model: LanguageModel, others: list[np.ndarray]) -> np.ndarray:
    """The lowest cosine of each centroid and band, from held-out texts of its language and of all, whichever are lower."""
    shared = drawn.sparkSession.sparkContext.broadcast((model, others))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, others = shared.value
        for batch in batches:
            pieces = [(label, k % FOLDS, band, cut) for label, text, k in zip(*(c.to_pylist() for c in batch.columns), strict=True) for band, cut in _cuts(text)]
            for a, b in textscan.blocks(np.fromiter((len(p[3]) + 2000 for p in pieces), np.int64, len(pieces)), 1_000_000):
                label, fold, band, cut = zip(*pieces[a:b])
                vectors = model.vectors(gram_counts(list(cut))[0])
                cosine = [float((others[f] @ v).max()) for f, v in zip(fold, vectors, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(band, pa.int32()), pa.array(cosine, pa.float32())], names=["label", "band", "cosine"])

    rows = small_batches(drawn).mapInArrow(score, "label string, band int, cosine float").groupBy("label", "band").agg(F.collect_list("cosine").alias("cosines")).collect()
    found = {(r["label"], r["band"]): np.array(r["cosines"]) for r in rows}
    radius = np.zeros((len(model.labels), len(BANDS)))
    for band in range(len(BANDS)):
        held = [v for (_, b), v in found.items() if b == band]
        if sum(map(len, held)) < ENOUGH:
            radius[:, band] = radius[:, band - 1] if band else 0
            continue
        lowest = np.percentile(np.concatenate(held), 1)
        for i, label in enumerate(model.labels):
            own = found.get((label, band))
            radius[i, band] = TOLERANCE * min(lowest, lowest if own is None else np.percentile(own, 1))
    return radius


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", into: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``df`` with a predicted language, a score from 0 to 1 and whether the text is rejected.

    Whole texts are read.  A null text, or one without a letter, gives language ``und``,
    score 0 and is rejected.  Rows, repeated or not, keep their other columns; a column with
    the name of a new one is replaced.  An empty table gives an empty one.
    """
    kept = df.drop(*into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType()), T.StructField(into[2], T.BooleanType())])
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = []
            for a, b in textscan.blocks(np.fromiter((len(t) + 2000 for t in texts), np.int64, len(texts)), 1_000_000):
                found += shared.value.predict(texts[a:b])
            language, score, far = zip(*found) if found else ((), (), ())
            new = [pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return small_batches(kept).mapInArrow(run, schema)

