"""The driver's tables in the roles of a scholarly catalog, with their SQL twins.

orders = papers, lineitem = which papers belong to which topics, part = topics, supplier and
nation = sources, customer and nation = authors and institutions, events = source events and
metrics, documents and labels = texts with partial knowledge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over several tasks a core, however few files and row groups they are read from."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published papers with tri-state fields, one per order."""
    k = F.col("o_orderkey")
    dated = F.when(k % 11 == 0, "missing").when(k % 13 == 0, "unknown").otherwise("known")
    cited = F.when(k % 9 == 0, "unknown").when(k % 10 == 0, "missing").otherwise("known")
    typed = F.when(k % 17 == 0, "unknown").otherwise("known")
    code = F.when(k % 7 == 0, "unknown").otherwise("known")
    trend = F.when(k % 3 == 0, "missing").otherwise("known")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("research_article", "preprint", "review", "benchmark", "dataset"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("paper_id"),
        F.concat(F.lit("order:"), k.cast("string")).alias("canonical_key"),
        dated.alias("published_at_state"),
        F.when(dated == "known", F.col("o_orderdate").cast("timestamp")).alias("published_at_value"),
        typed.alias("paper_type_state"),
        F.when(typed == "known", kind).alias("paper_type_value"),
        code.alias("has_code_state"),
        F.when(code == "known", F.col("o_custkey") % 2 == 0).alias("has_code_value"),
        F.lit("known").alias("has_data_state"),
        (F.col("o_custkey") % 3 == 0).alias("has_data_value"),
        cited.alias("citation_count_state"),
        F.when(cited == "known", F.floor(F.col("o_totalprice") / 1000)).alias("citation_count_value"),
        trend.alias("trend_score_state"),
        F.when(trend == "known", F.round(F.col("o_totalprice") / 500000, 4)).alias("trend_score_value"),
        F.when(F.col("o_orderstatus") == "P", F.element_at(F.array(*(F.lit(x) for x in ("withdrawn", "retracted", "rejected", "superseded"))), (k % 4 + 1).cast("int"))).otherwise("active").alias("lifecycle_status"),
        F.when(k % 19 == 0, "unknown").otherwise("known").alias("has_benchmark_state"),
        F.when(k % 19 != 0, F.col("o_custkey") % 4 == 0).alias("has_benchmark_value"),
        F.col("o_custkey").alias("author_id"),
    )


PAPERS = """
papers as (
    select o_orderkey as paper_id, 'order:' || o_orderkey as canonical_key,
        case when o_orderkey % 11 = 0 then 'missing' when o_orderkey % 13 = 0 then 'unknown' else 'known' end as published_at_state,
        case when o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 then o_orderdate end as published_at_value,
        case when o_orderkey % 17 = 0 then 'unknown' else 'known' end as paper_type_state,
        case when o_orderkey % 17 <> 0 then case o_orderpriority[1] when '1' then 'research_article' when '2' then 'preprint'
            when '3' then 'review' when '4' then 'benchmark' when '5' then 'dataset' end end as paper_type_value,
        case when o_orderkey % 7 = 0 then 'unknown' else 'known' end as has_code_state,
        case when o_orderkey % 7 <> 0 then o_custkey % 2 = 0 end as has_code_value,
        'known' as has_data_state, o_custkey % 3 = 0 as has_data_value,
        case when o_orderkey % 9 = 0 then 'unknown' when o_orderkey % 10 = 0 then 'missing' else 'known' end as citation_count_state,
        case when o_orderkey % 9 <> 0 and o_orderkey % 10 <> 0 then cast(floor(o_totalprice / 1000) as bigint) end as citation_count_value,
        case when o_orderkey % 3 = 0 then 'missing' else 'known' end as trend_score_state,
        case when o_orderkey % 3 <> 0 then round(o_totalprice / 500000, 4) end as trend_score_value,
        case when o_orderstatus <> 'P' then 'active' when o_orderkey % 4 = 0 then 'withdrawn' when o_orderkey % 4 = 1 then 'retracted' when o_orderkey % 4 = 2 then 'rejected' else 'superseded' end as lifecycle_status,
        case when o_orderkey % 19 = 0 then 'unknown' else 'known' end as has_benchmark_state, case when o_orderkey % 19 <> 0 then o_custkey % 4 = 0 end as has_benchmark_value,
        o_custkey as author_id
    from orders)
"""


def topics(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """(paper_id, slug, name): topics of papers, by way of the parts of an order; parts that are too many to broadcast are joined in ``tasks``."""
    from folioscope.functions.text import slug

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf_dir, "part").select("p_partkey", slug(F.col("p_brand")).alias("slug"), F.col("p_brand").alias("name"))
    if tasks:
        parts = parts.repartition(tasks, "p_partkey")
    return lines.join(parts, "p_partkey").select("paper_id", "slug", "name")


TOPICS = """
topics as (
    select l_orderkey as paper_id, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') as slug, p_brand as name
    from lineitem join part on l_partkey = p_partkey)
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, source, record): where each paper's records come from."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("s_suppkey"), F.col("l_linenumber").alias("line"))
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower("n_name").alias("source"))
    return lines.join(suppliers, "s_suppkey").select("paper_id", "source", F.concat_ws("-", F.col("s_suppkey").cast("string"), F.col("line").cast("string")).alias("record"))


SOURCES = """
sources as (
    select l_orderkey as paper_id, lower(n_name) as source, l_suppkey || '-' || l_linenumber as record
    from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)
"""


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source events: ordering tuple, kind (errors are tombstones), payload."""
    return as_source_events(table(spark, sf_dir, "events"))


def as_source_events(events: DataFrame) -> DataFrame:
    """Rows of the events table, batch or stream, in the role of source events."""
    return events.select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("event_key"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("event_kind"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("source_time"),
        F.col("event_type").alias("tie_break_key"),
        F.col("event_id").alias("position"),
        F.col("value"),
        F.col("props"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


SOURCE_EVENTS = """
source_events as (
    select event_id, cast(user_id as varchar) as event_key, case when event_type = 'error' then 'delete' else 'upsert' end as event_kind,
        date_trunc('hour', ts) as source_time, event_type as tie_break_key, event_id as position, value, props, ts
    from events)
"""


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what labels tell of them; without a row, quality is missing."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id", "lang", "source", "n_chars",
        F.when(F.col("quality").isNull(), "missing").otherwise("known").alias("quality_state"),
        (F.col("quality") == 1).alias("quality_value"),
    )


KNOWLEDGE = """
knowledge as (
    select d.doc_id, lang, source, n_chars, case when quality is null then 'missing' else 'known' end as quality_state, quality = 1 as quality_value
    from documents d left join labels l on d.doc_id = l.doc_id)
"""
