"""Approximate nearest neighbours with balanced posting lists.

Method (Chen et al. 2021): vectors are put into the posting lists of their nearest centroids;
one near a boundary goes to several lists.  Centroids are found by walking an in-memory graph
of them.  A query searches the lists whose centroids are not much farther than its nearest
one; found vectors are compared exactly.

Steps:

1. Equal vectors form a class, of which the smallest ids stand for all: a hot vector is
   stored and compared once, and queries with one vector are searched once.
2. Centroids are means of balanced cells: halves at the median between two means, again and
   again.  A first fit on a bounded sample cuts the space into cells; each cell is cut further
   by a task of its own on a bounded sample of its own.
3. Lists are balanced twice: by the fit, and by units of bounded size.  Neighbouring short
   lists make a shelf, in which a vector is stored once whatever lists it is in; a long list is
   a shelf of several parts.  A query goes once to a shelf of which it searches lists, and each
   shelf gives it no more than its best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm import families
from folioscope.llm.batches import matrix, runs, small_batches
from folioscope.operators.components import checkpointed

#: Vectors for which there is a centroid, as long as all centroids have no more numbers than
#: ``NUMBERS`` (they are held in memory by every task: 4 MB).
LIST, NUMBERS = 64, 1 << 20
#: Numbers of the sample of the first fit, and vectors a centroid of the second.
SAMPLE, PER_CENTROID = 1 << 19, 32
#: Lists that a vector is stored in at most, and how much farther their centroids may be than the nearest.
COPIES, BOUNDARY = 8, 0.15
#: How much farther than the nearest one the centroids of searched lists may be.
RATIO = 0.15
#: Neighbours of a centroid in the graph, and places where a walk begins.
NEIGHBOURS, ENTRIES = 24, 16
#: Queries of a unit, and numbers of its vectors.
QUERIES, UNIT = 1024, 1 << 20
#: Numbers that a short vector counts for at least.
LEAST = 32
#: Distances that a walk keeps at once.
HELD = 1 << 22


def cells(vectors: np.ndarray, count: int, seed: int = 0) -> np.ndarray:
    """Means of ``count`` cells of equal size, neighbours in order next to each other."""
    rng, out = np.random.default_rng(seed), []
    todo = [(vectors, min(count, len(vectors)))]
    while todo:
        x, n = todo.pop()
        if n <= 1:
            out.append(x.mean(axis=0))
            continue
        left = n // 2
        cut = round(len(x) * left / n)
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(6):
            order = np.argpartition(x @ (b - a), cut - 1)
            a, b = x[order[:cut]].mean(axis=0), x[order[cut:]].mean(axis=0)
        todo += [(x[order[cut:]], n - left), (x[order[:cut]], left)]
    return np.array(out)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T)


class Graph:
    """Centroids with links to their nearest ones, walked from a few entries."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        n = len(centroids)
        near = min(NEIGHBOURS, n - 1)
        links = []
        for a in range(0, n, 512):
            block = _squares(centroids[a : a + 512], centroids)
            block[np.arange(len(block)), np.arange(a, a + len(block))] = np.inf
            links.append(np.argpartition(block, near - 1, axis=1)[:, :near] if near else np.zeros((len(block), 0), dtype=np.int64))
        # the next ones in the order of cells keep the graph in one piece
        ring = np.stack([np.roll(np.arange(n), 1), np.roll(np.arange(n), -1)], axis=1)
        self.links = np.concatenate([*links, ring[:0]]) if n == 1 else np.concatenate([np.concatenate(links), ring], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int64))

    def within(self, vectors: np.ndarray, ratio: float) -> np.ndarray:
        """Distances to the centroids up to 1 + ``ratio`` times as far as the nearest one found; infinite for others.

        A walk goes to the nearest unvisited neighbour as long as that is the nearest centroid
        so far, and then to all within the bound.
        """
        n, c = len(vectors), len(self.centroids)
        seen = np.zeros((n, c), dtype=bool)
        spread = np.zeros((n, c), dtype=bool)
        distance = np.full((n, c), np.inf, dtype=np.float32)
        self._visit(vectors, distance, seen, np.repeat(np.arange(n), len(self.entries)), np.tile(self.entries, n))
        while True:
            nearest = distance.argmin(axis=1)
            least = distance[np.arange(n), nearest]
            walking = np.flatnonzero(~spread[np.arange(n), nearest])
            rows, nodes = walking, nearest[walking]
            settled = np.ones(n, dtype=bool)
            settled[walking] = False
            r, k = np.nonzero(~spread & (distance <= (1 + ratio) * least[:, None]) & settled[:, None])
            rows, nodes = np.concatenate([rows, r]), np.concatenate([nodes, k])
            if not len(rows):
                break
            spread[rows, nodes] = True
            ends = self.links[nodes]
            self._visit(vectors, distance, seen, np.repeat(rows, ends.shape[1]), ends.reshape(-1))
        distance[distance > (1 + ratio) * least[:, None]] = np.inf
        return distance

    def _visit(self, vectors: np.ndarray, distance: np.ndarray, seen: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> None:
        fresh = ~seen[rows, nodes]
        at = np.unique(rows[fresh] * seen.shape[1] + nodes[fresh])
        rows, nodes = at // seen.shape[1], at % seen.shape[1]
        seen[rows, nodes] = True
        step = max(1, HELD // self.centroids.shape[1])
        for a in range(0, len(rows), step):
            r, k = rows[a : a + step], nodes[a : a + step]
            gap = vectors[r] - self.centroids[k]
            distance[r, k] = np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def blocks(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The vectors in blocks whose distances to all centroids fit in memory."""
        step = max(1, HELD // len(self.centroids))
        for a in range(0, len(vectors), step):
            yield a, vectors[a : a + step].astype(np.float32)


class Model(NamedTuple):
    """For each length of vectors with several lists, their graph and how many lists make a shelf."""

    graphs: dict[int, Graph]
    shelves: dict[int, int]

    def stored(self, vectors: np.ndarray) -> list[list[int]]:
        """Lists of each vector, the nearest first."""
        graph = self.graphs.get(vectors.shape[1])
        if graph is None:
            return [[0]] * len(vectors)
        out = []
        for _, block in graph.blocks(vectors):
            distance = graph.within(block, BOUNDARY)
            order = np.argsort(distance, axis=1, kind="stable")[:, :COPIES]
            found = np.isfinite(np.take_along_axis(distance, order, axis=1))
            out += [row[ok].tolist() for row, ok in zip(order, found, strict=True)]
        return out

    def searched(self, vectors: np.ndarray, ratio: float, wanted: int, sizes: dict[int, np.ndarray]) -> list[list[int]]:
        """Lists that each query searches: within ``ratio``, and more until they surely hold ``wanted`` vectors, if there are as many."""
        graph = self.graphs.get(vectors.shape[1])
        if graph is None:
            return [[0]] * len(vectors)
        size, out = sizes[vectors.shape[1]], []
        for _, block in graph.blocks(vectors):
            found = np.isfinite(graph.within(block, ratio))
            for k in np.flatnonzero(found @ size < wanted).tolist():
                order = np.argsort(_squares(block[k : k + 1], graph.centroids)[0], kind="stable")
                enough = np.searchsorted(np.cumsum(size[order]), wanted) + 1
                found[k, order[:enough]] = True
            out += [np.flatnonzero(row).tolist() for row in found]
        return out


def _fit(classes: DataFrame) -> Model:
    """Centroids for each length of vectors; only lengths with several lists have any."""
    lengths = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") >= 2 * LIST)
    total = lengths.agg(F.sum("n")).first()[0] or 0
    # a length's share of all numbers is that of its vectors; a longer tail of lengths gets a list each
    wanted = F.least(F.floor(F.col("n") / LIST), F.floor(F.lit(NUMBERS) * (F.col("n") / total) / F.col("d")))
    counts = {r["d"]: (r["n"], int(r["lists"])) for r in lengths.withColumn("lists", wanted).where("lists > 1").collect()} if total else {}
    if not counts:
        return Model({}, {})
    drawn = F.xxhash64("v", F.lit("sample")) / F.lit(2.0**63)
    rows = classes.where(F.size("v").isin(list(counts))).select(F.size("v").alias("d"), "v", F.abs(drawn).alias("u"))
    first = {d: math.isqrt(lists - 1) + 1 for d, (n, lists) in counts.items()}
    of = lambda value: F.coalesce(*(F.when(F.col("d") == d, F.lit(float(value(d)))) for d in counts))

    def rough(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table.column("v"))
        return _centroid_table(key[0].as_py(), 0, cells(x[np.lexsort(x.T)], first[key[0].as_py()]))

    schema = "d int, cell int, centroid array<double>"
    sample = rows.where(F.col("u") < of(lambda d: SAMPLE / d / counts[d][0]))
    rough_rows = sample.groupBy("d").applyInArrow(rough, schema).collect()
    tops = {d: Graph(np.array([r["centroid"] for r in rough_rows if r["d"] == d], dtype=np.float32)) for d in {r["d"] for r in rough_rows}}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, own, x in _by_length(batches):
            cell = np.concatenate([np.argmin(graph_distance, axis=1) for _, block in tops[d].blocks(x) for graph_distance in [tops[d].within(block, 0.0)]])
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(x), pa.int32()), pa.array(cell, pa.int32()), own.column("v").cast(pa.list_(pa.float64()))], names=["d", "cell", "v"])

    def fine(key: tuple, table: pa.Table) -> pa.Table:
        d, cell = (k.as_py() for k in key)
        x = matrix(table.column("v"))
        return _centroid_table(d, cell, cells(x[np.lexsort(x.T)], max(1, round(len(x) / PER_CENTROID))))

    more = rows.where((F.col("u") < of(lambda d: PER_CENTROID * counts[d][1] / counts[d][0])) & F.col("d").isin(list(tops)))
    found = small_batches(more.select("v")).mapInArrow(placed, "d int, cell int, v array<double>").groupBy("d", "cell").applyInArrow(fine, schema).collect()
    found.sort(key=lambda r: (r["d"], r["cell"]))
    graphs = {d: Graph(np.array([r["centroid"] for r in found if r["d"] == d], dtype=np.float32)) for d in {r["d"] for r in found}}
    return Model(graphs, {d: max(1, int(UNIT / max(d, LEAST) / (COPIES * counts[d][0] / len(g.centroids)))) for d, g in graphs.items()})


def _centroid_table(d: int, cell: int, centroids: np.ndarray) -> pa.Table:
    n = len(centroids)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(centroids.reshape(-1)))
    return pa.table({"d": pa.array([d] * n, pa.int32()), "cell": pa.array([cell] * n, pa.int32()), "centroid": lists})


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Of batches with vectors ``v``: the rows of one length, and their vectors."""
    for batch in batches:
        sizes = np.diff(batch.column("v").offsets.to_numpy())
        for d in np.unique(sizes).tolist():
            own = batch.take(pa.array(np.flatnonzero(sizes == d)))
            yield d, own, matrix(own.column("v"))


def _listed(rows: DataFrame, lists_of, shelves: dict[int, int]) -> DataFrame:
    """(d, shelf, node, lists, nearest) of rows (node, v): a row for each shelf that holds lists of a vector.

    ``nearest`` is the first of a vector's lists, on one of its rows; -1 on others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, own, x in _by_length(batches):
            out: list[tuple[int, int, list[int], int]] = []
            per = shelves.get(d, 1)
            for node, lists in zip(own.column("node").to_pylist(), lists_of(x), strict=True):
                by_shelf: dict[int, list[int]] = {}
                for k in lists:
                    by_shelf.setdefault(k // per, []).append(k)
                out += [(shelf, node, held, held[0] if held[0] == lists[0] else -1) for shelf, held in by_shelf.items()]
            shelf, nodes, held, nearest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(out), pa.int32()), pa.array(shelf, pa.int32()), pa.array(nodes, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(nearest, pa.int32())], names=["d", "shelf", "node", "lists", "nearest"])

    return small_batches(rows.select("node", "v")).mapInArrow(run, "d int, shelf int, node long, lists array<int>, nearest int")


def _incidence(lists: pa.ChunkedArray, low: int, count: int) -> np.ndarray:
    """Which rows have which of the lists from ``low``: shape (rows, lists)."""
    lists = lists.combine_chunks()
    out = np.zeros((len(lists), count), dtype=np.float32)
    out[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy() - low] = 1
    return out


def nearest(queries: np.ndarray, vectors: np.ndarray, keep: int, asked: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of the ``keep`` nearest vectors of each query, and of ties with the last.

    ``asked`` and ``held`` tell which lists the queries search and the vectors are in; only
    vectors of searched lists count.
    """
    rows, columns, distances = [], [], []
    scale = max(float((queries * queries).sum(axis=1).max()), float((vectors * vectors).sum(axis=1).max()))
    order = np.lexsort(asked.T)
    for a in range(0, len(queries), 128):
        block = order[a : a + 128]
        # queries of like lists stand together, and vectors of no list of theirs are passed over
        those = np.flatnonzero(held[:, asked[block].any(axis=0)].any(axis=1))
        searched = asked[block] @ held[those].T > 0
        square = np.where(searched, _squares(queries[block], vectors[those]), np.inf)
        bound = np.partition(square, keep - 1, axis=1)[:, keep - 1 : keep] if square.shape[1] > keep else np.full((len(square), 1), np.inf)
        # products lose digits that differences keep
        r, c = np.nonzero(searched & (square <= bound + scale * queries.shape[1] * 1e-14))
        gap = queries[block[r]] - vectors[those[c]]
        rows.append(block[r])
        columns.append(those[c])
        distances.append(np.sqrt((gap * gap).sum(axis=1)))
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(distances)


def _search(units: DataFrame, keep: int) -> DataFrame:
    """(query, node, score) of each unit's queries (side 0) and their nearest vectors (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches):
            side, nodes, vectors = unit.column(1).to_numpy(), unit.column(2).to_numpy(), matrix(unit.column(4))
            if (side == 0).any() and (side == 1).any():
                every = unit.column(3).combine_chunks().flatten().to_numpy()
                held = _incidence(unit.column(3), int(every.min()), int(every.max() - every.min()) + 1)
                q, c, score = nearest(vectors[side == 0], vectors[side == 1], keep, held[side == 0], held[side == 1])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[side == 0][q]), pa.array(nodes[side == 1][c]), pa.array(score)], names=["query", "node", "score"])

    return small_batches(units.select("unit", "side", "node", "lists", "v")).mapInArrow(run, "query long, node long, score double")


def approximate_neighbours(df: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", ratio: float = RATIO) -> DataFrame:
    """Rows (query_id, rank int from 1, ``id_col``, score): the nearest vectors found for each query.

    Queries are the rows that the SQL condition ``is_query`` selects; candidates are all rows
    but those with the query's own id, and of those the ones in searched lists.  ``score`` is
    the Euclidean distance in double precision; ties go to the smaller id.  Fewer than ``k``
    candidates give fewer rows.  Rows without an id, and vectors that are null, empty or zero or
    hold a null or non-finite component, take no part; vectors meet only those of their own
    length.  Rows alike in id and vector are one row; other rows of one id are candidates and
    queries each.  An empty table gives an empty one; other columns are not read but by
    ``is_query``.  A larger ``ratio`` searches more lists; tests measure the recall.
    """
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))
    alike: list[Column] = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    asked = checkpointed(rows.where("asks").select("id", *alike).distinct())
    # an id's own vectors are none of its results
    keep = k + (asked.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = rows.select("id", "v").distinct().withColumn("place", place).where(F.col("place") <= keep)
    classes = least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("node", F.monotonically_increasing_id())
    classes = checkpointed(classes.select("node", "v", "ids", *alike))
    asked = checkpointed(families.merged(asked, classes.select("node", "h1", "h2"), ["h1", "h2"]).select(F.col("id").alias("query_id"), F.col("node").alias("query")))

    model = _fit(classes)
    stored = checkpointed(_listed(classes, model.stored, model.shelves))
    # lists of lengths with centroids are as many as centroids
    sizes = {d: np.zeros(len(g.centroids), dtype=np.int64) for d, g in model.graphs.items()}
    if sizes:
        for r in stored.where((F.col("nearest") >= 0) & F.col("d").isin(list(sizes))).groupBy("d", "nearest").agg(F.count("*").alias("n")).collect():
            sizes[r["d"]][r["nearest"]] = r["n"]
    asking = classes.join(asked.select(F.col("query").alias("node")).distinct().hint("merge"), "node", "left_semi")
    probes = checkpointed(_listed(asking, lambda x: model.searched(x, ratio, keep, sizes), model.shelves))

    place = ["d", "shelf"]
    cut = probes.groupBy(*place).agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
    cut = checkpointed(families.merged(stored.groupBy(*place).agg(F.ceil(F.count("*") * F.greatest("d", F.lit(LEAST)) / UNIT).alias("parts")), cut, place))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    side0 = families.merged(probes, cut, place).select(*place, dealt("blocks").alias("block"), upto("parts").alias("part"), F.lit(0).alias("side"), "node", "lists")
    side1 = families.merged(stored, cut, place).select(*place, upto("blocks").alias("block"), dealt("parts").alias("part"), F.lit(1).alias("side"), "node", "lists")
    shipped = families.merged(side0.union(side1), classes.select("node", "v"), "node")
    units = shipped.select(F.xxhash64(*place, "block", "part").alias("unit"), "side", "node", "lists", "v")
    found = _search(units.repartition("unit").sortWithinPartitions("unit", "side"), keep)

    once = found.groupBy("query", "node").agg(F.min("score").alias("score"))
    named = families.merged(once, classes.select("node", "ids"), "node")
    best = F.row_number().over(Window.partitionBy("query").orderBy("score", F.col("ids")[0]))
    named = named.withColumn("best", best).where(F.col("best") <= keep)
    listed = named.select("query", "score", F.explode("ids").alias("id"))
    order = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    # a class asks once; each query of it then leaves out its own id
    answers = listed.withColumn("place", order).where(F.col("place") <= keep).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("answers"))
    each = families.merged(asked, answers, "query").select("query_id", "query", F.posexplode(F.slice(F.filter("answers", lambda a: a["id"] != F.col("query_id")), 1, k)))
    return each.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias(id_col), F.col("col.score").alias("score"))
