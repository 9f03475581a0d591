"""Exact top-k search by inner product with Fagin's threshold algorithm.

Method: the candidates of a group are sorted by each dimension.  A query reads each
dimension's list from the end that its weight asks for, in steps of growing depth; vectors
met are scored in full, and it stops once no unmet vector can beat its kth result: the bound
is the sum over dimensions of its weight times the value at that depth.  With the kth result
that it has, a query knows how deep it has to go.  One whose lists hold as many entries down
to there as the group has vectors would meet nearly all of them: it meets the rest at once,
in a block of such queries.

Queries and candidates meet in units of a block of queries and a group of candidates.  A
unit has some 2**24 pairs in a small table and 2**31 at most, so that vectors are shipped
once for every 16,384 queries or 131,072 candidates of a large one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm.batches import matrix, runs, small_batches

#: Queries of a block and candidates of a group at most.
QUERIES, CANDIDATES = 16_384, 131_072
#: Units of a search at least, unless they would have fewer pairs than this.
UNITS, PAIRS = 256, 1 << 24
#: Depth of the first step over the lists, and by how much each step is deeper.
FIRST_DEPTH, DEEPER = 2, 2
#: Queries and candidates of a tile that is scored at once.
TILE = 1024, 8192
#: Whole numbers below this are exact in double precision.
EXACT = 2**53


class TopK:
    """The k best candidates of each query of a block so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.queries = queries
        self.scores = np.zeros((len(ids), k), dtype=np.int64)
        self.found = np.zeros((len(ids), k), dtype=np.int64)
        self.count = np.zeros(len(ids), dtype=np.int64)
        self.scored = 0

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Takes in a group of candidates; ``scored`` counts the pairs that were scored."""
        m, d = vectors.shape
        reach = int(np.abs(self.queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * d
        if reach >= 2**63:
            raise ValueError("an inner product may be beyond the range of long")
        self.kind = np.float64 if reach < EXACT else np.int64
        queries, vectors = self.queries.astype(self.kind), vectors.astype(self.kind)
        order = np.argsort(vectors, axis=0, kind="stable")
        value = np.take_along_axis(vectors, order, axis=0)
        whole = []
        for q in range(len(self.ids)):
            if self._threshold(q, queries[q], ids, vectors, order, value):
                whole.append(q)
        for a in range(0, len(whole), TILE[0]):
            block = np.array(whole[a : a + TILE[0]])
            for b in range(0, m, TILE[1]):
                self._take(block, ids[b : b + TILE[1]], queries[block] @ vectors[b : b + TILE[1]].T)
                self.scored += len(block) * min(TILE[1], m - b)

    def _bound(self, query: np.ndarray, value: np.ndarray, depth: int) -> int | float:
        """What no vector beats that is met in none of the first ``depth`` places of the query's lists."""
        return (np.maximum(query, 0) * value[len(value) - 1 - depth] + np.minimum(query, 0) * value[depth]).sum()

    def _threshold(self, q: int, query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, value: np.ndarray) -> bool:
        """Reads one query's lists until it may stop; true if it rather meets all candidates."""
        m = len(ids)
        asked = np.flatnonzero(query)
        up = query[asked] > 0
        depth, met = 0, None
        before = self.count[q], self.scores[q].copy(), self.found[q].copy()
        while depth < m:
            # an unmet vector with an equal score may still have the smaller id
            if self.count[q] == self.k:
                kth = self.scores[q, self.k - 1]
                if self._bound(query, value, depth) < kth:
                    return False
                if len(asked) == 0 or len(asked) * self._needed(query, value, depth, kth) >= m:
                    break
            deeper = min(m, max(FIRST_DEPTH, depth * DEEPER))
            if len(asked) * deeper >= m:
                break
            places = np.where(up, m - deeper, depth)[None, :] + np.arange(deeper - depth)[:, None]
            fresh = np.unique(order[places, asked[None, :]])
            if met is None:
                met = np.zeros(m, dtype=bool)
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            self._take(np.array([q]), ids[fresh], (vectors[fresh] @ query)[None, :])
            self.scored += len(fresh)
            depth = deeper
        if depth >= m:
            return False
        # what this group gave so far comes again with the rest
        self.count[q], self.scores[q], self.found[q] = before
        return True

    def _needed(self, query: np.ndarray, value: np.ndarray, depth: int, kth: int) -> int:
        """The depth at which the bound falls below ``kth``: the bound only falls, so it is halved."""
        low, high = depth, len(value)
        while low < high:
            middle = (low + high) // 2
            if self._bound(query, value, middle) < kth:
                high = middle
            else:
                low = middle + 1
        return low

    def _take(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merges scored candidates into the best so far, by score downwards and id upwards."""
        width = scores.shape[1]
        own = self.ids[rows][:, None] == ids[None, :]
        if own.any():
            scores = np.where(own, scores.min(), scores)
        if width > self.k:
            keep = scores >= np.partition(scores, width - self.k, axis=1)[:, width - self.k, None]
        else:
            keep = np.ones(scores.shape, dtype=bool)
        full = self.count[rows] == self.k
        keep &= ~full[:, None] | (scores >= self.scores[rows, self.k - 1][:, None])
        row, column = np.nonzero(keep & ~own)
        held = np.arange(self.k)[None, :] < self.count[rows][:, None]
        old_row, old_column = np.nonzero(held)
        all_rows = np.concatenate([old_row, row])
        all_scores = np.concatenate([self.scores[rows[old_row], old_column], scores[row, column].astype(np.int64)])
        all_ids = np.concatenate([self.found[rows[old_row], old_column], ids[column]])
        order = np.lexsort((all_ids, -all_scores, all_rows))
        all_rows, all_scores, all_ids = all_rows[order], all_scores[order], all_ids[order]
        place = np.arange(len(all_rows)) - np.searchsorted(all_rows, all_rows)
        best = place < self.k
        at = rows[all_rows[best]], place[best]
        self.scores[at], self.found[at] = all_scores[best], all_ids[best]
        self.count[rows] = np.minimum(np.bincount(all_rows, minlength=len(rows)), self.k)

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query in its block, candidate and score of all results."""
        held = np.arange(self.k)[None, :] < self.count[:, None]
        return np.nonzero(held)[0], self.found[held], self.scores[held]


def _search_units(rows: DataFrame, k: int) -> DataFrame:
    """(ask, query_id, id, score, scored): k best at most of each query of a unit, from rows (unit, side, ask, id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches):
            side = unit.column(1).to_numpy()
            asks, ids, vectors = unit.column(2).to_numpy(), unit.column(3).to_numpy(), matrix(unit.column(4))
            if (side == 0).all() or (side == 1).all():
                continue
            top = TopK(ids[side == 0], vectors[side == 0], k)
            top.search(ids[side == 1], vectors[side == 1])
            query, found, score = top.results()
            share = np.full(len(query), top.scored / max(1, len(query)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asks[side == 0][query], ids[side == 0][query], found, score, share)], names=["ask", "query_id", "id", "score", "scored"])

    return small_batches(rows.select("unit", "side", "ask", "id", "v")).mapInArrow(run, "ask long, query_id long, id long, score long, scored double")


def grid(candidates: int, queries: int, k: int = 20) -> tuple[int, int]:
    """Blocks of queries and groups of candidates, so that little is shipped in units of bounded size.

    A block ships all candidates; a group ships all queries, and brings back k results of each.
    """
    pairs = max(1, candidates) * max(1, queries)
    units = max(1, min(UNITS, pairs // PAIRS), pairs // (QUERIES * CANDIDATES))
    blocks = round(math.sqrt(units * queries * (1 + k / 12) / max(1, candidates)))
    blocks = max(1, min(blocks, units), -(-queries // QUERIES))
    return blocks, max(1, -(-units // blocks), -(-candidates // CANDIDATES))


def top_k(df: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """Rows (query_id, rank int from 1, ``id_col``, score long): each query's k best candidates.

    ``vector_col`` holds arrays of whole numbers (long); scores are exact, and an error says
    if one might be beyond the range of long.  Queries are the rows that the SQL condition
    ``is_query`` selects; candidates are all rows but those with the query's own id.  The
    score is the inner product; ties go to the smaller id.  Fewer than k candidates give
    fewer rows.  Rows with a null id, a null or empty vector or a null component take no
    part; vectors meet only those of their own length.  Several query rows of one id ask
    each for itself, in order of their vectors if told apart by nothing else; candidates of
    one id each count.  An empty table gives an empty one.
    """
    found = searched(df, is_query, k, id_col, vector_col)
    best = Window.partitionBy("ask", "query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def searched(df: DataFrame, is_query: str, k: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(ask, query_id, id, score, scored): results of all units before they are ranked.

    ``scored`` sums to the number of pairs that were scored in full.
    """
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v"), F.expr(is_query).alias("asks")).where(good)
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, groups = grid(counts["n"], counts["q"], k)
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # rows of one id and vector ask for one result each, told apart by their number
    asked = rows.where("asks").groupBy("id", "v").agg(F.count("*").alias("times"))
    asked = asked.withColumn("ask", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("times")), lambda t: F.xxhash64("v", t))))
    asked = asked.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), to(groups).alias("group"), F.lit(0).alias("side"), "ask", "id", "v")
    offered = rows.select(to(blocks).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("ask"), "id", "v")
    units = asked.union(offered).withColumn("unit", F.xxhash64("block", "group", F.size("v")))
    return _search_units(units.repartition(max(1, blocks * groups), "unit").sortWithinPartitions("unit", "side"), k)
