"""Merkle manifest of a dataset: a root over all documents and a proof for each.

Leaves are hashes of rows.  Each source's leaves, in order of ids, form a tree of arity three,
and the sources' roots, in order of sources, form one more tree over them.

Method: an associative sparse-forest monoid.  A forest holds unresolved nodes by tree, level
and index.  Merging two forests joins their nodes; a run of siblings whose number is known
(from the tree's leaves) becomes its parent as soon as it is whole.  Since nodes are told by
place, forests can be merged in any grouping.  Documents are dealt by ranges of (source, id):
a range's forest keeps a few nodes a level, those at its two ends, whatever its size.  Forests of neighbouring ranges are merged, then those of neighbouring groups, as
treeReduce does, until one holds the root alone.

For proofs, a range resolves its own nodes again and looks up those beyond its ends, by a join
with what the ranges left unresolved and what the merges made; nothing passes the driver but
two counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm.batches import runs, small_batches
from folioscope.operators.components import checkpointed

#: Children of a node.
ARITY = 3
#: Forests that are merged at once.
FAN = 16
#: The tree over the sources' roots; sources have numbers from 0.
TOP = -1


def join(digests: list[bytes]) -> bytes:
    """The lowercase hex digest of hex digests, concatenated."""
    return sha256(b"".join(digests)).hexdigest().encode()


def leaf(columns: list[Column]) -> Column:
    """The hash of a row: each value as its byte count, ``:`` and its text; ``-`` where null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


class Forest:
    """Unresolved nodes, each ``(tree, level, index): digest``; ``width`` tells the leaves of a tree.

    ``made`` collects the nodes that merges made.
    """

    def __init__(self, sources: int) -> None:
        self.nodes: dict[tuple[int, int, int], bytes] = {}
        self.width = {TOP: sources}
        self.made: list[tuple[int, int, int, bytes]] = []

    def add(self, tree: int, level: int, index: int, digest: bytes) -> None:
        """Takes in a node, and makes what is whole with it."""
        while True:
            width = at_level(self.width[tree], level)
            if width == 1:
                if tree == TOP:
                    self.nodes[tree, level, index] = digest
                    return
                tree, level, index = TOP, 0, tree
                self.made.append((tree, level, index, digest))
                continue
            self.nodes[tree, level, index] = digest
            first = index - index % ARITY
            run = [(tree, level, i) for i in range(first, min(first + ARITY, width))]
            if not all(k in self.nodes for k in run):
                return
            digest = join([self.nodes.pop(k) for k in run])
            level, index = level + 1, index // ARITY
            self.made.append((tree, level, index, digest))

    def merge(self, other: Forest) -> Forest:
        """Takes in the other's nodes: associative and commutative."""
        self.width |= other.width
        self.made += other.made
        for (tree, level, index), digest in other.nodes.items():
            self.add(tree, level, index, digest)
        return self


def at_level(width: int, level: int) -> int:
    """Nodes at a level of a tree of ``width`` leaves."""
    for _ in range(level):
        width = -(-width // ARITY)
    return width


class Span:
    """Neighbouring leaves of a tree, and all nodes above that they resolve by themselves."""

    def __init__(self, first: int, leaves: list[bytes], width: int) -> None:
        self.first, self.count, self.width = first, len(leaves), width
        #: Of each level up to the root: the tree's width there, the first node's index, and the nodes.
        self.levels: list[tuple[int, int, list[bytes]]] = []
        nodes = leaves
        while True:
            self.levels.append((width, first, nodes))
            if width == 1:
                return
            whole = -(-first // ARITY)
            end = first + len(nodes)
            over = -(-width // ARITY) if end == width else end // ARITY
            above = [join(nodes[max(0, ARITY * r - first) : ARITY * (r + 1) - first]) for r in range(whole, over)]
            # without a whole run there is nothing further up, at whatever index
            first, nodes, width = whole, above, -(-width // ARITY)

    def unresolved(self) -> Iterator[tuple[int, int, bytes]]:
        """(level, index, digest) of the nodes without a parent here."""
        for level, (width, first, nodes) in enumerate(self.levels):
            if width == 1:
                above = (0, [])
            else:
                above = self.levels[level + 1][1:]
            low, high = ARITY * above[0], ARITY * (above[0] + len(above[1]))
            yield from ((level, first + i, d) for i, d in enumerate(nodes) if not low <= first + i < high)

    def missing(self) -> Iterator[tuple[int, int]]:
        """(level, index) of what proofs of the leaves and the root need and isn't here."""
        if not self.count:
            return
        low, high = self.first, self.first + self.count - 1
        for level, (width, first, nodes) in enumerate(self.levels):
            begin, end = low - low % ARITY, min(high - high % ARITY + ARITY, width)
            yield from ((level, i) for i in range(begin, end) if not first <= i < first + len(nodes))
            low, high = low // ARITY, high // ARITY

    def path(self, index: int, beyond: dict[tuple[int, int], bytes]) -> list[tuple[list[bytes], list[bytes]]]:
        """Siblings before and after, level by level; ``beyond`` has what isn't here."""
        out = []
        for level, (width, first, nodes) in enumerate(self.levels[:-1]):
            begin = index - index % ARITY
            run = [nodes[i - first] if first <= i < first + len(nodes) else beyond[level, i] if i != index else b"" for i in range(begin, min(begin + ARITY, width))]
            out.append((run[: index - begin], run[index - begin + 1 :]))
            index //= ARITY
        return out

    def root(self, beyond: dict[tuple[int, int], bytes]) -> bytes:
        level = len(self.levels) - 1
        nodes = self.levels[level][2]
        return nodes[0] if nodes else beyond[level, 0]


def fold(digest: bytes, path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        digest = join([*before, digest, *after])
    return digest


def _spans(placed: DataFrame) -> DataFrame:
    """(range, source, tree, first, total, rows): what each range holds of each source.

    ``tree`` numbers the sources in order; ``first`` is the place of the range's first leaf.
    Windows run over the ranges of a source, and over all ranges: there are as many as partitions.
    """
    held = checkpointed(placed.groupBy("range", "source").agg(F.count("*").alias("rows")))
    of = Window.partitionBy("source")
    before = of.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("range", "source", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), F.sum("rows").over(of).alias("total"), F.min("range").over(of).alias("opened"))
    held = checkpointed(held)
    own = held.where("opened = range")
    opened = own.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n"))
    numbered = own.withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_first())) - 1).join(opened, "range").select(F.col("source").alias("s"), (F.col("k") + F.col("n")).cast("long").alias("tree"))
    return held.join(numbered.hint("merge"), F.col("source").eqNullSafe(F.col("s"))).select("range", "source", "tree", "first", "total", "rows")


_NODES = "group long, tree long, level int, index long, width long, digest string, state string"


def _rows(group: int, nodes: list[tuple[int, int, int, int, bytes | None, str]]) -> pa.RecordBatch:
    tree, level, index, width, digest, state = zip(*nodes, strict=True) if nodes else ((),) * 6
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = [tree, level, index, width, [d and d.decode() for d in digest], state]
    return pa.RecordBatch.from_arrays([pa.array([group] * len(nodes), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["group", "tree", "level", "index", "width", "digest", "state"])


def _trees(unit: pa.Table, sources: int) -> tuple[list[tuple[int, Span, int]], Span, int, int]:
    """Of a range's rows (.., tree, first, total, .., leaf) in order: its trees' spans with their first row, and the span of the top tree with its extent."""
    trees, first, total, leaves = (unit.column(c).to_pylist() for c in ("tree", "first", "total", "leaf"))
    cuts = [0, *(i for i in range(1, len(trees)) if trees[i] != trees[i - 1]), len(trees)]
    spans = [(trees[a], Span(first[a], [x.encode() for x in leaves[a:b]], total[a]), a) for a, b in zip(cuts, cuts[1:])]
    whole = [(t, s) for t, s, _ in spans if s.count == s.width]
    top = Span(whole[0][0] if whole else spans[0][0], [s.root({}) for _, s in whole], sources)
    return spans, top, spans[0][0], spans[-1][0]


def _top_missing(top: Span, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(level, index) that proofs of the sources ``low`` to ``high`` need of the top tree."""
    for level, (width, first, nodes) in enumerate(top.levels):
        begin, end = low - low % ARITY, min(high - high % ARITY + ARITY, width)
        yield from ((level, i) for i in range(begin, end) if not first <= i < first + len(nodes))
        low, high = low // ARITY, high // ARITY


def _fragments(leaves: DataFrame, sources: int) -> DataFrame:
    """Rows of nodes: what each range leaves ``open``, and what its proofs ``need`` from others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches):
            spans, top, low, high = _trees(unit, sources)
            nodes: list[tuple[int, int, int, int, bytes | None, str]] = []
            for tree, span, _ in spans:
                if span.count < span.width:
                    nodes += ((tree, level, index, span.width, digest, "open") for level, index, digest in span.unresolved())
                    nodes += ((tree, level, index, span.width, None, "need") for level, index in span.missing())
            nodes += ((TOP, level, index, sources, digest, "open") for level, index, digest in top.unresolved())
            nodes += ((TOP, level, index, sources, None, "need") for level, index in _top_missing(top, low, high))
            yield _rows(unit.column(0)[0].as_py(), nodes)

    return small_batches(leaves).mapInArrow(run, _NODES)


def _merged(nodes: DataFrame, sources: int) -> DataFrame:
    """Rows of nodes of merged forests: what stays ``open`` and what was ``made``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches):
            forest = Forest(sources)
            columns = (unit.column(c).to_pylist() for c in ("tree", "level", "index", "width", "digest"))
            for tree, level, index, width, digest in zip(*columns, strict=True):
                forest.width[tree] = width
                forest.add(tree, level, index, digest.encode())
            made = [(*node[:3], forest.width[node[0]], node[3], "made") for node in forest.made]
            yield _rows(unit.column(0)[0].as_py(), [*((*key, forest.width[key[0]], digest, "open") for key, digest in forest.nodes.items()), *made])

    ordered = nodes.repartition("group").sortWithinPartitions("group")
    return small_batches(ordered.select("group", "tree", "level", "index", "width", "digest", "state")).mapInArrow(run, _NODES)


def _tree_reduce(fragments: DataFrame, ranges: int, sources: int) -> DataFrame:
    """Every node that the ranges left unresolved or that merging them made: (tree, level, index, digest).

    Each round merges the forests of ``FAN`` neighbouring groups; the last one holds the root.
    """
    nodes = fragments.where("state = 'open'")
    known, groups = nodes, ranges
    while groups > 1:
        merged = checkpointed(_merged(nodes.withColumn("group", F.floor(F.col("group") / FAN)), sources))
        known = known.union(merged.where("state = 'made'"))
        nodes, groups = merged.where("state = 'open'"), -(-groups // FAN)
    return known.select("tree", "level", "index", "digest").distinct()


def _proofs(rows: DataFrame, sources: int, schema: str) -> DataFrame:
    """Manifest rows from (range, side, ..): nodes from beyond a range (side 0) and its leaves (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches):
            side = unit.column("side").to_pylist()
            cut = sum(s == 0 for s in side)
            beyond: dict[int, dict[tuple[int, int], bytes]] = {}
            for tree, level, index, digest in zip(*(unit.column(c).slice(0, cut).to_pylist() for c in ("tree", "level", "first", "leaf")), strict=True):
                beyond.setdefault(tree, {})[level, index] = digest.encode()
            own = unit.slice(cut)
            spans, top, _, _ = _trees(own, sources)
            high = beyond.get(TOP, {})
            root = top.root(high)
            ids, tampered = own.column("id"), own.column("tampered").to_pylist()
            for tree, span, at in spans:
                near = beyond.get(tree, {})
                subroot, upper = span.root(near), top.path(tree, high)
                proof, folded = [], []
                for i in range(span.count):
                    path = [*span.path(span.first + i, near), *upper]
                    proof.append(sha256(b"".join(d for before, after in path for d in (*before, *after))).hexdigest())
                    folded.append(fold((tampered[at + i] or span.levels[0][2][i].decode()).encode(), path).decode())
                n = span.count
                root_text = root.decode()
                columns = [ids.slice(at, n).combine_chunks(), own.column("leaf").slice(at, n).combine_chunks(), pa.array([subroot.decode()] * n), pa.array([root_text] * n), pa.array(proof), pa.array(folded), pa.array([f == root_text for f in folded])]
                for a in range(0, n, 10_000):
                    yield pa.RecordBatch.from_arrays([c.slice(a, 10_000) for c in columns], names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return small_batches(rows).mapInArrow(run, schema)


def manifest(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None) -> DataFrame:
    """Rows (``id_col``, leaf, subroot, root, proof_sha256, folded_root, verified), one for each input row.

    A leaf hashes ``columns``.  ``folded_root`` is what a row's leaf and its original siblings
    fold to, where the leaf is that of the row with the columns of ``tampered`` in place of its
    own; ``verified`` tells whether that is the root.  Leaves of a source are in order of ids,
    null first, and by leaf where ids are equal; sources are in order of UTF-8 bytes, null first.
    Rows that are equal throughout are leaves next to each other, whose proofs differ by their
    place.  A table of one row has its leaf as root and a proof of nothing.  An empty table
    gives an empty one; other columns are not read.
    """
    tampered = tampered or {}
    own, other = leaf([F.col(c) for c in columns]), leaf([tampered.get(c, F.col(c)) for c in columns])
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), own.alias("leaf"), other.alias("tampered"))
    # the only pass over the texts; what follows has a row of some 150 bytes for each
    hashed = checkpointed(texts.withColumn("tampered", F.when(F.col("tampered") != F.col("leaf"), F.col("tampered"))))
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf").asc(), F.col("place").asc()]
    ranged = hashed.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("range", F.spark_partition_id().cast("long"))
    placed = checkpointed(ranged)
    spans = checkpointed(_spans(placed))
    totals = spans.agg(F.coalesce(F.max("tree") + 1, F.lit(0)).alias("sources"), F.coalesce(F.max("range") + 1, F.lit(0)).alias("ranges")).first()
    spans = spans.select(F.col("range").alias("r"), F.col("source").alias("s"), "tree", "first", "total")
    leaves = placed.join(spans.hint("merge"), (F.col("range") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")))
    leaves = leaves.select("range", "tree", "first", "total", "id", "place", "leaf", "tampered")
    inner = ["range", "tree", F.col("id").asc_nulls_first(), "leaf", "place"]
    ordered = leaves.repartition("range").sortWithinPartitions(*inner).select("range", "tree", "first", "total", "leaf")
    fragments = checkpointed(_fragments(ordered, totals["sources"]))
    known = _tree_reduce(fragments, totals["ranges"], totals["sources"])
    need = fragments.where("state = 'need'").select(F.col("group").alias("range"), "tree", "level", "index")
    beyond = need.join(known.hint("merge"), ["tree", "level", "index"])
    no_text = F.lit(None).cast("string")
    sides = beyond.select("range", F.lit(0).alias("side"), "tree", "level", F.col("index").alias("first"), F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("place"), F.col("digest").alias("leaf"), no_text.alias("tampered"))
    sides = sides.union(leaves.select("range", F.lit(1), "tree", F.lit(0), "first", "total", "id", "place", "leaf", "tampered"))
    sides = sides.repartition("range").sortWithinPartitions("range", "side", *inner[1:])
    found = _proofs(sides, totals["sources"], "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumnRenamed("id", id_col)
