"""Near-duplicate embeddings by cross-polytope hashing.

Method (Andoni et al. 2015): a vector is rotated by sign flips and fast Hadamard transforms,
three times over; its hash is the axis, with sign, that it then lies nearest to.  Several
such hashes make a table's bucket.  Besides its own bucket, a vector probes those in which
the closest second-best axes replace the best ones.  Pairs found are verified by cosine in
double precision.

Equal vectors form a class.  A family's members within half the angle of its centre are
linked with each other by the triangle inequality, so a large group of copies is counted
rather than compared; all other pairs of families that meet are compared in bounded units.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm import families, textscan
from folioscope.llm.batches import matrix, runs, small_batches
from folioscope.operators.components import checkpointed, connected_components

#: Tables, hashes of a table's bucket, and buckets of a table that a vector lies in. A pair
#: at cosine 0.95 in 64 dimensions shares none in fewer than one of 5,000 cases; two chance
#: vectors share one in some 70,000. Tables of many more vectors want more hashes and tables.
TABLES, HASHES, PROBES = 12, 4, 4
#: Vectors of a block of a comparison.
BLOCK = 1024


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, -1, 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


def bucket_keys(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 0) -> np.ndarray:
    """Bucket keys of each vector, shape (vectors, tables * probes); equal lengths only."""
    n, length = vectors.shape
    d = 1 << max(1, (length - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :length] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.zeros((n, tables * probes), dtype=np.uint64)
    options = list(itertools.product((0, 1), repeat=hashes))
    probes = min(probes, len(options))
    for table in range(tables):
        best, gap = [], []
        for h in range(hashes):
            y = x
            for turn in range(3):
                signs = textscan.mix(np.arange(d, dtype=np.uint64) + np.uint64((((seed * 1009 + table) * 101 + h) * 7 + turn) * 65536 + 1))
                y = _hadamard(y * np.where(signs & np.uint64(1), 1.0, -1.0))
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            values = np.take_along_axis(size, top, 1)
            swap = (values[:, 0] < values[:, 1]) | ((values[:, 0] == values[:, 1]) & (top[:, 0] > top[:, 1]))
            top[swap] = top[swap][:, ::-1]
            best.append(top * 2 + (np.take_along_axis(y, top, 1) < 0))
            gap.append(np.abs(values[:, 0] - values[:, 1]))
        cost = np.stack([sum((gap[h] * o[h] for h in range(hashes)), np.zeros(n)) for o in options], axis=1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        codes = np.zeros((n, len(options)), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i, o in enumerate(options):
                key = np.full(n, np.uint64(length * 4096 + table))
                for h in range(hashes):
                    key = textscan.mix(key * np.uint64(0x9E3779B97F4A7C15) + best[h][:, o[h]].astype(np.uint64))
                codes[:, i] = key
        out[:, table * probes : (table + 1) * probes] = np.take_along_axis(codes, order, 1)
    return out


def _keyed(classes: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """(node, keys) of classes (node, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            for length in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == length)
                keys = bucket_keys(matrix(batch.column(1).take(pa.array(rows))), tables, hashes, probes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), lists], names=["node", "keys"])

    return small_batches(classes.select("node", "v")).mapInArrow(run, "node long, keys array<long>")


def _units(batches: Iterator[pa.RecordBatch], vector: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The columns of each unit before the vectors, and its vectors scaled to 1; those of one length at a time."""
    for unit in runs(batches):
        sizes = pc.list_value_length(unit.column(vector)).to_numpy()
        for length in np.unique(sizes).tolist():
            own = unit.take(pa.array(np.flatnonzero(sizes == length)))
            vectors = matrix(own.column(vector))
            yield [c.to_numpy() for c in own.columns[:vector]], vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _angles(shipped: DataFrame) -> DataFrame:
    """(node, cosine) of members (side 1) and their unit's centre (side 0), from rows (unit, side, node, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, side, node), vectors in _units(batches, 3):
            if (side == 0).any():
                cosine = vectors[side == 1] @ vectors[side == 0][0]
                yield pa.RecordBatch.from_arrays([pa.array(node[side == 1]), pa.array(cosine)], names=["node", "cosine"])

    return small_batches(shipped.select("unit", "side", "node", "v")).mapInArrow(run, "node long, cosine double")


def _compare(shipped: DataFrame, threshold: float) -> DataFrame:
    """Per unit, rows (node, links, other): numbers of links, and links that span components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, side, own, node, copies), vectors in _units(batches, 5):
            left, right = side == 0, side == 1
            a, b = node[left], node[right]
            linked = (vectors[left] @ vectors[right].T >= threshold) & (a[:, None] != b[None, :])
            forth = linked @ copies[right]
            back = copies[left] @ linked * ~own[right]
            p, q = families.joining(*(x[k] for x, k in zip((a, b), np.nonzero(linked), strict=True)))
            yield from (
                pa.RecordBatch.from_arrays([pa.array(x), pa.array(n), pa.array(y)], names=["node", "links", "other"])
                for x, n, y in ((a[forth > 0], forth[forth > 0], a[forth > 0]), (b[back > 0], back[back > 0], b[back > 0]), (p, np.zeros(len(p), dtype=np.int64), q))
                if len(x)
            )

    return small_batches(shipped.select("unit", "side", "own", "node", "copies", "v")).mapInArrow(run, "node long, links long, other long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """Rows (``id_col``, ``n_links``, ``component_id``, ``kept``), one for each input row.

    Vectors are linked if found by hashing and their cosine is ``threshold`` or more.
    ``n_links`` counts other vectors linked directly, ``component_id`` is the smallest id
    reachable over links, itself included, and ``kept`` tells whether that is the row's own.
    Vectors that are null, empty or zero, or hold a null or non-finite component, are linked
    with nothing; neither are vectors of different lengths.  Rows of one id are vectors
    like any others.  A row without an id has no links and isn't kept.  An empty table gives an empty one;
    other columns, whatever their names, are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = F.coalesce(F.col("id").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("valid", valid)
    # -0.0 and 0.0 are the same component
    vector = F.transform("v", lambda x: x + F.lit(0.0))
    good = rows.where("valid").select("id", vector.alias("v"))
    classes = good.groupBy("v").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    # a class is named by its smallest id; a second class of that id gets a number of its own
    turn = F.row_number().over(Window.partitionBy("first_id").orderBy("v"))
    named = classes.withColumn("turn", turn)
    nodes = checkpointed(named.select(F.when(F.col("turn") == 1, F.col("first_id")).otherwise(F.xxhash64("first_id", "turn")).alias("node"), "first_id", "copies", "v"))
    keyed = _keyed(nodes, tables, hashes, probes)
    slots = families.meeting_slots(keyed.select("node", F.explode(F.array_distinct("keys")).alias("key")))
    family = families.families(slots)
    vectors = nodes.select("node", "v")
    stars = families.merged(families.stars(family, BLOCK), vectors, "node").repartition("unit").sortWithinPartitions("unit", "side")
    angle = checkpointed(_angles(stars))
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    near = angle.where(F.col("cosine") >= half).select("node", F.lit(True).alias("near"))
    member = families.merged(family, near, "node", "left").withColumn("in_main", F.coalesce("near", F.col("node") == F.col("family")))
    member = checkpointed(member.select("node", F.lit(1).alias("n"), "family", "in_main", F.lit(0).alias("main"), F.col("node").alias("component")))
    shipped = families.units(member, slots, BLOCK, "family = partner and in_main2").select("unit", "side", "own", "node")
    shipped = families.merged(shipped, nodes.select("node", "copies", "v"), "node").repartition("unit").sortWithinPartitions("unit", "side")
    compared = checkpointed(_compare(shipped, threshold))

    sized = families.merged(member.where("in_main"), nodes.select("node", "copies"), "node")
    ball = sized.groupBy("family").agg(F.sum("copies").alias("ball"))
    inside = families.merged(sized, ball, "family").select("node", (F.col("ball") - F.col("copies")).alias("links"))
    links = compared.select("node", "links").union(inside).groupBy("node").agg(F.sum("links").alias("links"))
    edges = compared.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")).union(member.where("in_main and node <> family").select("node", "family"))
    found = families.merged(families.merged(nodes, links, "node", "left"), connected_components(edges), "node", "left")
    found = checkpointed(found).withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = families.merged(found, least, "component").select(F.col("v").alias("w"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.withColumn("w", F.when(F.col("valid"), vector)).join(found.hint("merge"), "w", "left")
    component_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(component_id == F.col("id"), F.lit(False)).alias("kept"))
