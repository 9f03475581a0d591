"""Connected components over an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Edges of a task, about; rows of a node beyond which they are dealt over tasks, and how many parts they are dealt to.
TASK_EDGES, HOT_ROWS, HOT_PARTS = 500_000, 50_000, 1000


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Where none is set, a session within one process gets a temporary one, as in tests; on a
    cluster that is an error, since executors would lose what they write there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that its lineage ends there."""
    shared_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(rows: DataFrame, hot_rows: int) -> DataFrame:
    """(u, hot_m, below) of keys of more than ``hot_rows`` rows: their least ``v``, and how many are less than they are."""
    counted = rows.groupBy("u").agg(F.min("v").alias("hot_m"), F.count("*").alias("n"), F.count_if(F.col("v") < F.col("u")).alias("below"))
    return checkpointed(counted.where(F.col("n") > hot_rows).select("u", "hot_m", "below"))


def with_least(rows: DataFrame, parts: int, hot: DataFrame | None) -> DataFrame:
    """Rows (u, v) with ``m``, the least ``v`` of their ``u``, over ``parts`` tasks.

    A component's centre has as many rows as the component.  The least of such keys is broadcast
    (of a table's rows, there is one for ``HOT_ROWS`` at most), and their rows are dealt by ``v`` too.
    """
    if hot is None:
        return rows.repartition(parts, "u").withColumn("m", F.min("v").over(Window.partitionBy("u")))
    told = rows.join(F.broadcast(hot.select("u", "hot_m")), "u", "left").withColumn("part", F.when(F.col("hot_m").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.lit(HOT_PARTS))))
    least = F.coalesce("hot_m", F.min("v").over(Window.partitionBy("u", "part")))
    return told.repartition(parts, "u", "part").select("u", "v", least.alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (``node``, ``component``): the smallest node reachable from each node of an edge.

    Alternates the large-star and small-star contractions (Kiveris et al., 2014): each node
    hooks its larger neighbours, then its smaller ones, to the smallest label it knows.
    Edges are undirected; loops and repeated edges are allowed; edges with a null end are
    ignored; an empty table gives an empty one.  Rounds are few (logarithmic in practice),
    each a narrow aggregation of the edges, and each is checkpointed.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = e.select(F.col("u").alias("node")).union(e.select(F.col("v"))).distinct()
    e = checkpointed(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, parts = None, max(edges.sparkSession.sparkContext.defaultParallelism, -(-e.count() // TASK_EDGES))
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v"), F.col("u")))
        hot = hot_keys(both, HOT_ROWS)
        large = with_least(both, parts, hot).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")
        smaller = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # a node has as many rows here as lesser neighbours before
        many = None if hot.where(F.col("below") > HOT_ROWS).isEmpty() else hot_keys(smaller, HOT_ROWS)
        ends = F.array(*(F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v")))
        e = checkpointed(with_least(smaller, parts, many).select(F.inline(ends)).where("u <> v").repartition(parts, "u", "v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    return loops.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
