"""Near-duplicate documents by min-max hashing of word shingles.

Method (min-max hashing, Ji et al. 2013): each hash function gives two signature values,
the smallest and the largest hash of a document's shingles, so that half as many hash
evaluations fill the signature.  Bands of signature values find candidates; every link is
confirmed on the full shingle sets.

Steps, all of which grow with the documents rather than with pairs of them:

1. signatures of each document, in one vectorised pass over the texts;
2. documents with equal sets form a class; what follows links classes, and ids come back last;
3. a bucket's centre is the member that lies in the fullest buckets.  Each class joins the
   family of the centre that it meets most often, is confirmed against that centre, and
   the confirmed links give first components: a large group of copies costs one comparison
   for each member;
4. only pairs that share a bucket and are still in different components could be missed.
   Families that meet in a bucket are compared on full sets, in units of bounded size.  A
   unit returns at most one link for each member, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import families, textscan
from folioscope.llm.batches import runs, small_batches
from folioscope.operators.components import checkpointed, connected_components

#: Chance that a pair at the threshold shares no band, and that a pair ``BELOW`` it shares one, at most.
MISSED, CHANCE, BELOW = 1e-6, 0.125, 0.35
#: Shingles of the members of one block, of which two are compared at once; a block also
#: holds ``families.MEMBERS`` members at most, about.
BLOCK_SHINGLES = 200_000
#: Members that are compared with a copy of their family's centre.
STAR = 500


def banding(percent: int) -> tuple[int, int]:
    """Bands of the signature, and values in a band, for links at ``percent`` or more.

    Two sets of similarity s share one of b bands of r values with the chance 1 - (1 - s**r)**b.
    These are the fewest values for which some number of bands keeps both bounds above.  At 85,
    53 bands of 9: a pair at 0.85 is missed once in a million, and one at 0.5 meets in 10 % of
    cases (0.4: 1 %).  At 80, 76 bands of 8: 0.8 once in a million; 0.45 meets in 12 %.
    """
    s = percent / 100
    for rows in range(1, 64):
        bands = max(1, math.ceil(math.log(MISSED) / math.log1p(-(s**rows)))) if s < 1 else 1
        if 1 - (1 - max(0.0, s - BELOW) ** rows) ** bands <= CHANCE:
            break
    return bands, rows


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each UTF-8 text as two independent 64-bit hashes each, and offsets.

    Words are separated by ASCII white space; A-Z count as a-z.  A text with fewer than
    ``words`` words has its whole sequence as one shingle; one without words has none.
    Shingles are told apart by both hashes; those of a text are in order of the first one.
    """
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    inside = ~_SEPARATOR[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    grams = np.maximum(counts - words + 1, (counts > 0).astype(np.int64))
    at = textscan.ragged(first[:-1], grams)
    document = np.repeat(np.arange(len(texts), dtype=np.uint64), grams)
    left = np.repeat(counts, grams) - (at - np.repeat(first[:-1], grams))
    whole = len(left) == 0 or int(left.min()) >= words
    lanes = []
    with np.errstate(over="ignore"):
        for seed in (1, 2):
            hashes = textscan.span_hashes(data, starts, lengths, seed)
            mixed = np.full(len(at), np.uint64(0x51ED270B7A1F4C21 + seed))
            for k in range(words):
                value = hashes[at + k] if whole else np.where(left > k, hashes[np.where(left > k, at + k, 0)], np.uint64(k))
                mixed = textscan.mix(mixed * np.uint64(0x9E3779B97F4A7C15) + value)
            lanes.append(mixed)
    # one sort of (text, hash) packed into 64 bits
    bits = np.uint64(max(1, (len(texts) - 1).bit_length()))
    packed = (document << (np.uint64(64) - bits)) | (lanes[0] >> bits)
    order = np.argsort(packed)
    a, b, packed = lanes[0][order], lanes[1][order], packed[order]
    equal = packed[1:] == packed[:-1]
    same = equal & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    if (equal & ~same).any():
        order = np.lexsort((lanes[1], lanes[0], document))
        a, b = lanes[0][order], lanes[1][order]
        same = (document[order][1:] == document[order][:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    keep = np.append(True, ~same)[: len(order)]
    out = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.bincount(document[order][keep].astype(np.int64), minlength=len(texts)), out=out[1:])
    return a[keep], b[keep], out


def signatures(shingles: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each non-empty set: shape (sets, bands)."""
    full = np.flatnonzero(np.diff(offsets))
    heads = offsets[full]
    values = np.zeros((bands * rows + 1, len(full)), dtype=np.uint64)
    spread = textscan.mix(shingles)
    factors = textscan.mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(0, bands * rows, 2):
            if len(full):
                hashed = spread * factors[k]
                values[k] = np.minimum.reduceat(hashed, heads)
                values[k + 1] = np.maximum.reduceat(hashed, heads)
        keys = np.zeros((len(full), bands), dtype=np.uint64)
        for band in range(bands):
            key = np.full(len(full), np.uint64(band + 1))
            for k in range(rows):
                key = textscan.mix(key * np.uint64(0x9E3779B97F4A7C15) + values[band * rows + k])
            keys[:, band] = key
    return keys


def _sketch(df: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(id, print, n_shingles, digest, digest2, keys) for each row; ``print`` is that of its text, keys those of the bands."""
    schema = "id long, print long, n_shingles long, digest long, digest2 long, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in textscan.blocks(np.fromiter(map(len, texts), np.int64, len(texts))):
                *lanes, at = shingle_sets(texts[a:b], words)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                keys = signatures(lanes[0], at, bands, rows)
                digests = np.zeros((2, b - a), dtype=np.uint64)
                for k, lane in enumerate(lanes):
                    if len(full):
                        digests[k, full] = np.add.reduceat(textscan.mix(lane ^ np.uint64(0xA5A5A5A5)), at[full])
                key_at = np.zeros(b - a + 1, dtype=np.int32)
                np.cumsum((sizes > 0) * bands, out=key_at[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array(sizes),
                        pa.array(digests[0].view(np.int64)),
                        pa.array(digests[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(key_at), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["id", "print", "n_shingles", "digest", "digest2", "keys"],
                )

    return small_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), _print(text_col).alias("print"))).mapInArrow(run, schema)


def _print(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _texts(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, text) of classes (node, id, print), of which each is a row's."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), _print(text_col).alias("print"), F.col(text_col).cast("string").alias("text")).where(_HAS_WORD)
    return families.merged(docs, wanted, ["id", "print"]).groupBy("node").agg(F.min("text").alias("text"))


#: A text with a word in it.
_HAS_WORD = r"text rlike '[^\\x20\\x09-\\x0D]'"


def codes(lanes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A number from 0 for each shingle, equal where both of its hashes are."""
    first, values = pd.factorize(lanes[0])
    other = np.zeros(len(values), dtype=np.uint64)
    other[first[::-1]] = lanes[1][::-1]
    if (other[first] == lanes[1]).all():
        return first
    return np.unique(np.stack(lanes, axis=1), axis=0, return_inverse=True)[1].reshape(-1)


def _stars(shipped: DataFrame, words: int, percent: int) -> DataFrame:
    """Of rows (unit, side, node, text) sorted by unit and side, (node, centre) of those similar enough to the unit's side 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, unit = (0, b""), None
        for batch in batches:
            units, sides, nodes = (c.to_pylist() for c in batch.columns[:3])
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            for a, b in textscan.blocks(np.fromiter(map(len, texts), np.int64, len(texts))):
                # the centre of the first rows came before this block
                held, of, members = [centre], [], []
                for i in range(a, b):
                    if sides[i] == 0:
                        centre, unit = (nodes[i], texts[i]), units[i]
                        held.append(centre)
                    elif units[i] == unit:
                        of.append(len(held) - 1)
                        members.append(i)
                *lanes, at = shingle_sets([*(t for _, t in held), *(texts[i] for i in members)], words)
                code, sizes = codes(tuple(lanes)), np.diff(at)
                split = at[len(held)]
                top = int(code.max(initial=0)) + 1
                place = np.repeat(np.arange(len(held)), sizes[: len(held)]) * top + code[:split]
                wanted = np.repeat(np.array(of, dtype=np.int64), sizes[len(held) :]) * top + code[split:]
                both = np.bincount(np.repeat(np.arange(len(members)), sizes[len(held) :])[np.isin(wanted, place)], minlength=len(members))
                centres = np.array(of, dtype=np.int64)
                linked = 100 * both >= percent * (sizes[len(held) :] + sizes[centres] - both)
                pairs = [(nodes[i], held[k][0]) for i, k, yes in zip(members, of, linked.tolist(), strict=True) if yes]
                yield _links(pairs)

    return small_batches(shipped.select("unit", "side", "node", "text")).mapInArrow(run, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def shared_counts(owner: np.ndarray, code: np.ndarray, left: int, right: int, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each of the first ``left`` sets with each of the next ``right``.

    ``owner`` and ``code`` tell which set holds which number.
    """
    counts = np.bincount(code)
    column = np.cumsum(counts > 1) - 1
    keep = counts[code] > 1
    owner, code = owner[keep], column[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((left, right), dtype=np.float32)
    for begin in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, [begin, begin + step])
        dense = np.zeros((left + right, step), dtype=np.float32)
        dense[owner[a:b], code[a:b] - begin] = 1
        out += dense[:left] @ dense[left:].T
    return out


def _unit_links(side: np.ndarray, component: np.ndarray, texts: list[bytes], words: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of two blocks, fewer than there are components; side 0 comes first."""
    left = int((side == 0).sum())
    *lanes, at = shingle_sets(texts, words)
    size = np.diff(at).astype(np.float64)
    both = shared_counts(np.repeat(np.arange(len(texts)), np.diff(at)), codes(tuple(lanes)), left, len(texts) - left)
    linked = 100 * both >= percent * (size[:left, None] + size[None, left:] - both)
    linked &= component[:left, None] != component[None, left:]
    i, j = np.nonzero(linked)
    return families.joining(component[i], component[left + j])


def _compare_blocks(shipped: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components from rows (unit, side, component, text), sorted by unit and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches):
            texts = unit.column(3).cast(pa.binary()).to_pylist()
            a, b = _unit_links(unit.column(1).to_numpy(), unit.column(2).to_numpy(), texts, words, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return small_batches(shipped.select("unit", "side", "component", "text")).mapInArrow(run, "a long, b long")


def _of_one_id(full: DataFrame, classes: DataFrame, digest: list[str]) -> DataFrame:
    """(a, b): links between the classes of ids that have several texts."""
    sets = F.struct(*digest)
    several = full.groupBy("id").agg(F.min(sets).alias("least"), F.max(sets).alias("most")).where("least <> most").select("id")
    rows = families.merged(full.select("id", *digest), several, "id", "left_semi").distinct()
    rows = families.merged(rows, classes.select("node", *digest), digest).select("id", "node")
    first = rows.groupBy("id").agg(F.min("node").alias("first"))
    return families.merged(rows, first, "id").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """Rows (``id_col``, ``n_shingles``, ``component_id``, ``kept``), one for each input row.

    Documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets;
    ``component_id`` is the smallest id reachable over links, itself included, and ``kept``
    tells whether that is the row's own id.  A null or empty text, or one of white space
    only, has no shingles and is linked with nothing.  Rows that share an id are one document
    with several texts: whatever any of them is linked with, all rows of the id have one
    component.  A row without an id takes no part: its component is null and it isn't kept.
    An empty table gives an empty one; other columns, whatever their names, are not read.
    Texts are read whole, whatever their length.  Without ``bands`` and ``rows``, ``banding``
    chooses them.
    """
    if bands is None or rows is None:
        bands, rows = banding(percent)
    sketch = checkpointed(_sketch(df, id_col, text_col, words, bands, rows))
    digest = ["n_shingles", "digest", "digest2"]
    full = sketch.where("n_shingles > 0 and id is not null")
    # a class is told by its set, not by an id: an id may have several texts
    classes = full.groupBy(*digest).agg(F.min(F.struct("id", "print")).alias("own"), F.first("keys").alias("keys"))
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("node"), *digest, "own", "keys"))
    slots = families.meeting_slots(classes.select("node", F.explode("keys").alias("key")))
    family = families.families(slots)
    wanted = families.merged(classes.select("node", "own.*"), family.select("node"), "node", "left_semi")
    texts = checkpointed(_texts(df, id_col, text_col, wanted))

    stars = families.merged(families.stars(family, STAR), texts, "node")
    links = checkpointed(_stars(stars.repartition("unit").sortWithinPartitions("unit", "side"), words, percent))

    gathered = links.select(F.col("a").alias("node"), F.lit(True).alias("linked"))
    member = families.merged(families.merged(family, gathered, "node", "left"), classes.select("node", F.col("n_shingles").alias("n")), "node")
    member = member.withColumn("in_main", F.coalesce("linked", F.col("node") == F.col("family")))
    component = F.when(F.col("in_main"), F.col("family")).otherwise(F.col("node"))
    member = checkpointed(member.select("node", "n", "family", "in_main", F.col("family").alias("main"), component.alias("component")))

    skip = "(in_main and component = main) or (not in_main and family = partner and in_main2)"
    alike = f"100 * n >= {percent} * least and 100 * most >= {percent} * n"
    shipped = families.merged(families.units(member, slots, BLOCK_SHINGLES, skip, alike), texts, "node")
    shipped = shipped.select("unit", "side", "component", "text").repartition("unit").sortWithinPartitions("unit", "side")
    more = checkpointed(_compare_blocks(shipped, words, percent))

    component = connected_components(links.union(more).union(_of_one_id(full, classes, digest)))
    linked = families.merged(classes.select("node", F.col("own.id").alias("first_id")), component, "node")
    least = families.merged(linked, linked.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("node", "component_id")
    labelled = families.merged(classes.select("node", *digest, F.col("own.id").alias("first_id")), least, "node", "left")
    labelled = labelled.select(*(F.col(c).alias(f"_{c}") for c in digest), F.coalesce("component_id", "first_id").alias("component_id"))
    found = full.select("id", *digest).join(labelled.hint("merge"), [F.col(c) == F.col(f"_{c}") for c in digest]).select("id", "n_shingles", "component_id")
    bare = sketch.where("n_shingles = 0 or id is null").select("id", "n_shingles")
    # an empty text may stand beside others of its id
    beside = families.merged(found.select("id", "component_id"), bare.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("component_id").alias("component_id"))
    bare = families.merged(bare, beside, "id", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    out = found.union(bare)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
