"""Families of items that share buckets, and units of bounded size to compare them in.

Used by near-duplicate operators: no list of a bucket's pairs is ever made.  A bucket's
centre is the member that lies in the fullest buckets; an item joins the family of the
centre that it meets most often.  Families that meet in a bucket are compared in units.

Intermediate tables are narrow (ids and numbers) and are written to the checkpoint folder,
so that plans stay short and a lost executor costs one step.  Joins are sort-merge joins,
which split hot keys at run time and bring no table to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.components import checkpointed

#: Members that a block of a comparison holds about, whatever they weigh.
MEMBERS = 512
#: Parts that the members of a family are dealt to when they look up its blocks.
SALTS = 16


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join."""
    return left.join(right.hint("merge"), on, how)


def meeting_slots(keyed: DataFrame) -> DataFrame:
    """Of rows (node, key), those whose key has several nodes, with the number ``in_key``."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("in_key")).where("in_key > 1")
    return checkpointed(merged(keyed, sizes, "key"))


def families(slots: DataFrame) -> DataFrame:
    """(node, family) of all nodes in ``slots``; the family is named by its centre."""
    weights = slots.groupBy("node").agg(F.sum("in_key").alias("weight"))
    weighed = checkpointed(merged(slots.select("key", "node"), weights, "node"))
    centres = weighed.groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("family"))
    meets = merged(weighed.select("key", "node"), centres, "key").groupBy("node", "family").agg(F.count("*").alias("times"))
    return checkpointed(meets.groupBy("node").agg(F.max_by("family", F.struct("times", -F.col("family"))).alias("family")))


def stars(family: DataFrame, per: int) -> DataFrame:
    """(node, unit, side): members (side 1) with a copy of their family's centre (side 0) for every ``per`` of them."""
    sizes = checkpointed(family.groupBy("family").agg(F.ceil(F.count("*") / per).alias("copies")))
    centres = sizes.select(F.col("family").alias("node"), "family", _upto("copies").alias("copy"), F.lit(0).alias("side"))
    members = merged(family.where("node <> family"), sizes, "family").select("node", "family", F.pmod(F.xxhash64("node"), "copies").alias("copy"), F.lit(1).alias("side"))
    return centres.union(members).select("node", F.xxhash64("family", "copy").alias("unit"), "side")


def _upto(column: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(column) - 1))


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)))


def units(member: DataFrame, slots: DataFrame, block: int, skip: str, alike: str = "true") -> DataFrame:
    """(unit, side, node, component, own): what is compared, block (side 0) by chunk (side 1).

    ``member`` has (node, n, family, in_main, main, component); n is what a node weighs, and
    a block or chunk holds about ``block`` of weight and ``MEMBERS`` nodes at most.  Of two
    families that meet, the smaller one joins the larger one's partners.  The larger one's
    parts (``in_main`` or not) are cut into blocks, its partners into chunks.  ``skip`` tells
    of (in_main, main, family) of a part and (partner, in_main2, component) of a node what
    needs no comparison; ``alike``, of the part's (least, most) and the node's n, what could
    be similar at all.  ``own`` is true for a partner of the same family and part, whose
    pairs a unit meets in both orders.
    """
    cut = F.ceil(F.greatest(F.sum("n") / block, F.count("*") / MEMBERS))
    part = checkpointed(member.groupBy("family", "in_main").agg(cut.alias("blocks"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("main").alias("main")))
    total = part.groupBy("family").agg(F.sum("total").alias("total"))
    met = merged(slots.select("node", "key"), member.select("node", "family"), "node").select("key", "family").distinct()
    # a bucket of one family pairs that family with itself, and needs no join
    met = checkpointed(merged(met, total, "family"))
    several = met.groupBy("key").agg(F.count("*").alias("met")).where("met > 1").select("key")
    meeting = merged(met, several, "key")
    other = meeting.select("key", F.col("family").alias("partner"), F.col("total").alias("total2"))
    larger = "family <> partner and (total > total2 or (total = total2 and family < partner))"
    across = merged(meeting, other, "key").where(larger).select("family", "partner").distinct()
    pairs = across.union(total.select("family", F.col("family").alias("partner")))
    partners = member.select(F.col("family").alias("partner"), F.col("in_main").alias("in_main2"), "node", "n", "component")
    side1 = merged(merged(pairs, part, "family"), partners, "partner").where(f"not ({skip}) and ({alike})")
    side1 = checkpointed(side1.select("family", "in_main", "blocks", "node", "n", "component", F.expr("family = partner and in_main = in_main2").alias("own")))
    chunks = checkpointed(side1.groupBy("family", "in_main", "blocks").agg(cut.alias("chunks")))
    spread = chunks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    place = ["family", "in_main", "salt"]
    side1 = merged(_salted(side1.drop("blocks")), spread, place).select("family", "in_main", _upto("blocks").alias("block"), F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), F.lit(1).alias("side"), "node", "component", "own")
    side0 = merged(_salted(member.select("family", "in_main", "node", "component")), spread, place)
    side0 = side0.select("family", "in_main", F.pmod(F.xxhash64("node"), "blocks").alias("block"), _upto("chunks").alias("chunk"), F.lit(0).alias("side"), "node", "component", F.lit(False).alias("own"))
    return side0.union(side1).select(F.xxhash64("family", "in_main", "block", "chunk").alias("unit"), "side", "node", "component", "own")


def joining(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join what all pairs (a[i], b[i]) join, fewer than there are items.

    Each item that isn't the smallest one it is joined with is paired with that one.
    """
    items, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(items))
    while True:
        low = np.minimum(label[p], label[q])
        if (low == label[p]).all() and (low == label[q]).all():
            break
        # the smaller label goes to both ends and to what their labels stand for
        for end in (p, q):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(items)))
    return items[moved], items[label[moved]]
