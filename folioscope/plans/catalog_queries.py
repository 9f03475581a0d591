"""Catalog reads: filters, pages, facets, totals, taxonomies, provenance and joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text, tristate
from folioscope.operators import catalog
from folioscope.plans import publication, roles
from folioscope.plans.registry import query
from folioscope.plans.roles import KNOWLEDGE, PAPERS, SOURCES, TOPICS, table
from folioscope.sources import generations


def _page(df: DataFrame) -> DataFrame:
    """The page's rows with their place, as scalars that compare by value."""
    w = Window.orderBy(F.asc("sort_rank"), F.desc_nulls_last("sort_value"), F.asc("canonical_key"))
    value = F.date_format("sort_value", "yyyy-MM-dd HH:mm:ss") if dict(df.dtypes)["sort_value"].startswith("timestamp") else F.col("sort_value").cast("double")
    return df.select(F.row_number().over(w).alias("place"), "canonical_key", "sort_rank", value.alias("sort_value"))


RANK = "case when {0}_state = 'known' then 0 when {0}_state = 'unknown' then 1 else 2 end"


def _page_sql(name: str, where: str, limit: int, time: bool = False) -> str:
    value = f"strftime({name}_value, '%Y-%m-%d %H:%M:%S')" if time else f"cast({name}_value as double)"
    order = f"{RANK.format(name)}, {name}_value desc nulls last, canonical_key"
    return f"""
with r as (select canonical_key, {RANK.format(name)} as sort_rank, {value} as sort_value, cast(row_number() over (order by {order}) as integer) as place
    from papers where {where})
select place, canonical_key, sort_rank, sort_value from r where place <= {limit}"""


@query(
    """
with r as (select p.*, row_number() over (order by published_at_value desc, canonical_key) as n from papers p
    where published_at_state = 'known' and published_at_value >= timestamp '1995-01-01' and published_at_value <= timestamp '1997-12-31'
      and paper_type_state = 'known' and paper_type_value = 'preprint' and has_code_state = 'known' and has_code_value
      and has_data_state = 'known' and not has_data_value and lifecycle_status = 'active'
      and paper_id in (select paper_id from topics where slug = 'brand-11' or slug = 'brand-2'))
select cast(n as integer) as place, canonical_key, 0 as sort_rank, strftime(published_at_value, '%Y-%m-%d %H:%M:%S') as sort_value from r where n <= 21""",
    PAPERS,
    TOPICS,
)
def paper_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of filters at once, and the first page with its look-ahead row."""
    wanted = catalog.PaperQuery(published_from=datetime(1995, 1, 1), published_to=datetime(1997, 12, 31), paper_type="preprint", has_code=True, has_data=False, lifecycle="active").normalised()
    about = roles.topics(spark, sf_dir).where(F.col("slug").isin("brand-11", "brand-2")).select("paper_id")
    return _page(catalog.page(roles.papers(spark, sf_dir).join(about, "paper_id", "left_semi"), wanted))


@query(_page_sql("published_at", "true", 21, True), PAPERS)
def paper_sort_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(catalog.page(roles.papers(spark, sf_dir), catalog.PaperQuery().normalised()))


@query(_page_sql("citation_count", "true", 101), PAPERS)
def paper_sort_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(catalog.page(roles.papers(spark, sf_dir), catalog.PaperQuery(sort="citations_desc", limit=100).normalised()))


@query(_page_sql("trend_score", "has_code_state = 'known' and not has_code_value", 21), PAPERS)
def paper_sort_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(catalog.page(roles.papers(spark, sf_dir), catalog.PaperQuery(sort="trend_desc", has_code=False).normalised()))


@query(
    _page_sql("published_at", f"({RANK.format('published_at')} > 0 or published_at_value < timestamp '1996-06-01' or (published_at_value = timestamp '1996-06-01' and canonical_key > 'order:5'))", 21, True),
    PAPERS,
)
def paper_keyset_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a given time and key."""
    return _page(catalog.page(roles.papers(spark, sf_dir), catalog.PaperQuery().normalised(), (0, datetime(1996, 6, 1), "order:5")))


@query(_page_sql("citation_count", f"({RANK.format('citation_count')} > 1 or ({RANK.format('citation_count')} = 1 and canonical_key > 'order:5'))", 21), PAPERS)
def paper_keyset_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a key among papers whose count is unknown."""
    return _page(catalog.page(roles.papers(spark, sf_dir), catalog.PaperQuery(sort="citations_desc").normalised(), (1, None, "order:5")))


@query("select paper_type_value as key, count(*) as papers from papers where paper_type_state = 'known' group by 1", PAPERS)
def facet_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.scalar_facet(roles.papers(spark, sf_dir), "paper_type_value", "paper_type")


@query("select lifecycle_status as key, count(*) as papers from papers group by 1", PAPERS)
def facet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.scalar_facet(roles.papers(spark, sf_dir), "lifecycle_status")


@query("select slug as key, count(distinct paper_id) as papers from topics where paper_id in (select paper_id from papers where has_code_state = 'known' and has_code_value) group by 1", PAPERS, TOPICS)
def facet_array_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the papers that a filter leaves; the facet isn't self-excluding."""
    left = catalog.filtered(roles.papers(spark, sf_dir).select("paper_id", "has_code_state", "has_code_value"), catalog.PaperQuery(has_code=True))
    tasks = catalog.pair_tasks(table(spark, sf_dir, "lineitem"))
    return catalog.pair_facet(roles.topics(spark, sf_dir, tasks), left, "paper_id", "slug", tasks)


@query("select source as key, count(distinct paper_id) as papers from sources where paper_id in (select paper_id from topics where slug = 'brand-11') group by 1", SOURCES, TOPICS)
def facet_array_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = catalog.pair_tasks(table(spark, sf_dir, "lineitem"))
    about = roles.topics(spark, sf_dir, tasks).where("slug = 'brand-11'").select("paper_id")
    return catalog.pair_facet(roles.sources(spark, sf_dir), about, "paper_id", "source", tasks)


@query("select count(*) as total from papers where has_code_state = 'known' and has_code_value and lifecycle_status = 'active'", PAPERS)
def total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.filtered(roles.papers(spark, sf_dir), catalog.PaperQuery(has_code=True, lifecycle="active")).agg(F.count("*").alias("total"))


@query(
    """
select count(*) as papers,
    case when bool_and(has_code_state = 'known') then 'known' when bool_and(has_code_state = 'missing') then 'missing' else 'unknown' end as has_code_ratio_state,
    count(*) filter (has_code_state = 'known' and has_code_value) as has_code_true, count(*) as has_code_total,
    case when bool_and(has_code_state = 'known') then cast(count(*) filter (has_code_value) as double) / count(*) end as has_code_ratio,
    'known' as has_data_ratio_state, count(*) filter (has_data_value) as has_data_true, count(*) as has_data_total,
    cast(count(*) filter (has_data_value) as double) / count(*) as has_data_ratio,
    case when bool_and(has_benchmark_state = 'known') then 'known' when bool_and(has_benchmark_state = 'missing') then 'missing' else 'unknown' end as has_benchmark_ratio_state,
    count(*) filter (has_benchmark_state = 'known' and has_benchmark_value) as has_benchmark_true, count(*) as has_benchmark_total,
    case when bool_and(has_benchmark_state = 'known') then cast(count(*) filter (has_benchmark_value) as double) / count(*) end as has_benchmark_ratio,
    (select count(distinct slug) from topics) as topics_total, (select count(distinct p_type) from part) as methods_total,
    case when bool_and(published_at_state = 'known') then 'known' else 'unknown' end as recent_state,
    coalesce(case when bool_and(published_at_state = 'known') then count(*) filter (published_at_value between timestamp '1998-06-01' - interval 7 day and timestamp '1998-06-01') end, -1) as papers_last_7_days
from papers""",
    PAPERS,
    TOPICS,
)
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = table(spark, sf_dir, "part").select(F.col("p_type").alias("slug"))
    return catalog.statistics(roles.papers(spark, sf_dir), F.lit(datetime(1998, 6, 1)), roles.topics(spark, sf_dir), methods).withColumn("papers_last_7_days", F.coalesce("papers_last_7_days", F.lit(-1)))


@query(
    """
select lang, case when bool_and(quality_state = 'known') then 'known' when bool_and(quality_state = 'missing') then 'missing' else 'unknown' end as quality_ratio_state,
    count(*) filter (quality_state = 'known' and quality_value) as quality_true, count(*) as quality_total,
    case when bool_and(quality_state = 'known') then cast(count(*) filter (quality_value) as double) / count(*) end as quality_ratio
from knowledge group by lang""",
    KNOWLEDGE,
)
def tri_state_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.knowledge(spark, sf_dir).groupBy("lang").agg(*tristate.ratio("quality"))


@query(
    """
select lifecycle_status, case when bool_and(published_at_state = 'known') then 'known' else 'unknown' end as recent_state,
    coalesce(case when bool_and(published_at_state = 'known') then count(*) filter (published_at_value between timestamp '1998-06-01' - interval 7 day and timestamp '1998-06-01') end, -1) as recent
from papers where published_at_state = 'known' or lifecycle_status = 'active' group by 1""",
    PAPERS,
)
def recent_7d_poisoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paper without a known time makes its group's recent count unknown."""
    rows = roles.papers(spark, sf_dir).where("published_at_state = 'known' or lifecycle_status = 'active'")
    dated, now = F.bool_and(tristate.is_known("published_at")), F.lit(datetime(1998, 6, 1))
    recent = F.count_if(tristate.value("published_at").between(now - F.expr("interval 7 days"), now))
    return rows.groupBy("lifecycle_status").agg(F.when(dated, "known").otherwise("unknown").alias("recent_state"), F.coalesce(F.when(dated, recent), F.lit(-1)).alias("recent"))


@query("select slug, count(distinct paper_id) as paper_count, min(name) as name, count(distinct name) > 1 as conflict from topics group by slug", TOPICS)
def taxonomy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.taxonomy(roles.topics(spark, sf_dir), "paper_id", "slug", "name")


@query(
    """
with t as (select l_orderkey as paper_id, p_type as slug, p_brand as name, case when p_size <= 48 then 'sized' end as description from lineitem join part on l_partkey = p_partkey)
select slug, count(distinct paper_id) as paper_count, min(name) as name, count(distinct name) > 1 or count(distinct coalesce('=' || description, '')) > 1 as conflict from t group by slug"""
)
def taxonomy_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxa whose rows disagree about name or description."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("slug"), F.col("p_brand").alias("name"), F.when(F.col("p_size") <= 48, "sized").alias("description"))
    return catalog.taxonomy(lines.join(parts, "p_partkey"), "paper_id", "slug", "name", "description")


@query(
    """
with t as (select distinct slug, paper_id from topics), n as (select *, (row_number() over (partition by slug order by paper_id) - 1) // 1000 as chunk from t)
select slug, cast(chunk as bigint) as chunk, count(*) as papers, string_agg(paper_id, ',' order by paper_id) as paper_ids from n group by 1, 2""",
    TOPICS,
)
def taxonomy_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers of each topic, in lists of at most a thousand."""
    lists = catalog.taxon_papers(roles.topics(spark, sf_dir), "paper_id", "slug", 1000)
    return lists.withColumn("paper_ids", F.array_join(F.col("paper_ids").cast("array<string>"), ","))


@query(
    """
with t as (select slug, count(distinct paper_id) as paper_count from topics group by slug),
    r as (select slug, paper_count, cast(row_number() over (order by paper_count desc, slug) as integer) as place from t
        where paper_count < (select max(paper_count) from t))
select place, slug, paper_count from r where place <= 10""",
    TOPICS,
)
def taxonomy_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of topics after the largest ones."""
    counted = catalog.taxonomy(roles.topics(spark, sf_dir), "paper_id", "slug", "name").select("slug", "paper_count")
    rest = counted.where(F.col("paper_count") < counted.select(F.max("paper_count")).scalar()).orderBy(F.desc("paper_count"), "slug").limit(10)
    return rest.select(F.row_number().over(Window.orderBy(F.desc("paper_count"), "slug")).alias("place"), "slug", "paper_count")


@query(
    """
select p_brand as slug, count(distinct p_type) as types, count(distinct (p_brand, p_size)) as variants from part
group by p_brand having count(distinct (p_type, p_size)) > 1"""
)
def taxonomy_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxa whose rows disagree in a compound of columns."""
    grouped = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("slug"))
    agg = grouped.agg(F.count_distinct("p_type").alias("types"), F.count_distinct(F.struct("p_brand", "p_size")).alias("variants"), F.count_distinct(F.struct("p_type", "p_size")).alias("both"))
    return agg.where("both > 1").drop("both")


@query("select paper_id, string_agg(distinct source, ',' order by source) as sources, count(distinct source) as n from sources group by paper_id", SOURCES)
def source_names_per_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_sort(F.collect_set("source"))
    return roles.sources(spark, sf_dir).groupBy("paper_id").agg(F.array_join(names, ",").alias("sources"), F.size(names).cast("long").alias("n"))


@query("select paper_id, string_agg(source || ':' || record, ',' order by source, record) as provenance from sources group by paper_id", SOURCES)
def provenance_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("source", "record")))
    return roles.sources(spark, sf_dir).groupBy("paper_id").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["source"], F.lit(":"), x["record"])), ",").alias("provenance"))


@query("select c_custkey, coalesce(o_orderkey, -1) as o_orderkey, o_orderstatus from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P'")
def left_join_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(pending, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), "o_orderstatus")


@query("select doc_id, lang, quality is not null as labelled from documents d left join labels l using (doc_id)")
def match_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left").select("doc_id", "lang", F.col("quality").isNotNull().alias("labelled"))


@query("select o_orderkey, o_orderstatus from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(returned, "o_orderkey", "left_semi")


@query("select s_suppkey, s_name from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey in (1, 3))")
def semi_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(1, 3)).select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf_dir, "supplier").join(wanted, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_anti")


@query(
    """
select distinct p.p_partkey, s.s_suppkey from part p join supplier s
on p.p_partkey = s.s_suppkey or p.p_size = s.s_suppkey or p.p_partkey % 1000 = s.s_suppkey"""
)
def theta_or_to_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on any of three roles: the roles are exploded and joined by equality."""
    roles_of = F.array_distinct(F.array(F.col("p_partkey"), F.col("p_size").cast("long"), F.col("p_partkey") % 1000))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.explode(roles_of).alias("s_suppkey"))
    return parts.join(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select("p_partkey", "s_suppkey").distinct()


@query("select slug, count(*) as bridges, count(distinct paper_id) as papers from topics group by slug", TOPICS)
def bridge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.topics(spark, sf_dir).groupBy("slug").agg(F.count("*").alias("bridges"), F.count_distinct("paper_id").alias("papers"))


@query(
    """
select o_orderkey as paper_id, c_name as author, n_name as institution from orders join customer on o_custkey = c_custkey
left join nation on c_nationkey = n_nationkey and n_regionkey <> 2"""
)
def author_institution_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    institutions = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("institution"))
    authors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author"), "c_nationkey").join(institutions, "c_nationkey", "left")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_custkey").join(authors, "o_custkey").select("paper_id", "author", "institution")


@query(
    """
select s_suppkey, (select count(*) from lineitem where l_suppkey = s_suppkey) as associated, (select count(*) from lineitem where l_suppkey = s_suppkey and l_returnflag = 'N') as unchanged
from supplier where (select count(*) from lineitem where l_suppkey = s_suppkey) > 10"""
)
def correlated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated counts, as one aggregation before the join."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("associated"), F.count_if(F.col("l_returnflag") == "N").alias("unchanged"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(counts.where("associated > 10"), "s_suppkey")


@query(
    """
with r as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders)
select c_custkey, c_mktsegment, o_orderkey, o_orderstatus from customer join r on c_custkey = o_custkey where n = 1"""
)
def assessment_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest assessment of each venue, joined to the venue."""
    newest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(newest, "c_custkey").select("c_custkey", "c_mktsegment", "o.*")


def _violation(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


@query(
    """
select violation, count(*) as rows from (
    select unnest([case when l_quantity < 1 then 'quantity' end, case when l_discount not between 0 and 0.05 then 'discount' end,
        case when l_tax > 0.07 then 'tax' end]) as violation from lineitem) where violation is not null group by 1"""
)
def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row constraints as predicates: how many rows violate each."""
    checks = F.array_compact(F.array(_violation(F.col("l_quantity") < 1, "quantity"), _violation(~F.col("l_discount").between(0, 0.05), "discount"), _violation(F.col("l_tax") > 0.07, "tax")))
    return table(spark, sf_dir, "lineitem").select(F.explode(checks).alias("violation")).groupBy("violation").agg(F.count("*").alias("rows"))


@query(
    """
with h as (select sha256(l_orderkey || '|' || l_linenumber || '|' || l_partkey) as h from lineitem),
    b as (select h[1:4] as leaf, sha256(string_agg(h, ',' order by h)) as d, count(*) as n from h group by 1),
    c as (select leaf[1:2] as branch, sha256(string_agg(d, ',' order by leaf)) as d, sum(n) as n from b group by 1)
select sha256(string_agg(d, ',' order by branch)) as revision, cast(sum(n) as bigint) as rows from c"""
)
def snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content address of a table, as generations of a catalog have: a tree of hashes by prefix."""
    hashed = table(spark, sf_dir, "lineitem").select(F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey"), 256).alias("h"))
    return generations.tree_digest(hashed).select(F.col("d").alias("revision"), F.col("n").alias("rows"))


@query(
    """
with told as (select p_partkey, p_partkey % 7 = 3 as untitled, p_partkey % 11 = 5 as unproven, p_partkey % 13 = 1 as stateless, 'part:' || p_partkey // 2 as slug from part),
    shared as (select slug from told where p_partkey % 17 = 0 or (p_partkey - 1) % 17 = 0 group by 1 having count(*) > 1)
select rule, cast(count(*) as bigint) as papers from (
    select 'no title' as rule from told where untitled union all select 'no provenance' from told where unproven union all select 'state is invalid' from told where stateless
    union all select 'slug is shared' from shared) group by 1"""
)
def publication_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a catalog isn't published: papers without a title, without provenance, with an invalid state, or with another's slug."""
    k = F.col("p_partkey")
    papers = table(spark, sf_dir, "part").select(
        k.cast("string").alias("canonical_key"),
        F.when(k % 7 == 3, " ").otherwise(F.col("p_name")).alias("title"),
        *(x for n in publication.FIELDS for x in (F.when((k % 13 == 1) & F.lit(n == "has_code"), "pending").otherwise("known").alias(f"{n}_state"), F.lit("v").alias(f"{n}_value"))),
        F.when(k % 11 != 5, F.array(F.struct(F.lit("s").alias("source"), k.cast("string").alias("record_id"), F.lit("h").alias("raw_hash")))).otherwise(F.array().cast("array<struct<source:string,record_id:string,raw_hash:string>>")).alias("source_provenance"),
        F.lit("active").alias("lifecycle_status"),
        F.when((k % 17 == 0) | ((k - 1) % 17 == 0), F.concat(F.lit("part:"), F.floor(k / 2).cast("string"))).otherwise(k.cast("string")).alias("slug"),
    )
    told = generations.verdict(papers, "canonical_key", publication.broken(), {"slug is shared": F.col("slug")})
    return spark.createDataFrame([(rule, n) for rule, (n, _) in told.items()], "rule string, papers long")


@query(
    """
select paper_id, field, state, value from (
    select paper_id, 'published_at' as field, published_at_state as state, strftime(published_at_value, '%Y-%m-%dT%H:%M:%S.%fZ') as value from papers
    union all select paper_id, 'paper_type', paper_type_state, paper_type_value from papers
    union all select paper_id, 'has_code', has_code_state, cast(has_code_value as varchar) from papers
    union all select paper_id, 'citation_count', citation_count_state, cast(citation_count_value as varchar) from papers)""",
    PAPERS,
)
def field_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide papers as long field assertions."""
    shown = {"published_at": text.rfc3339(F.col("published_at_value")), "paper_type": F.col("paper_type_value"), "has_code": F.col("has_code_value").cast("string"), "citation_count": F.col("citation_count_value").cast("string")}
    rows = F.array(*(F.struct(F.lit(n).alias("field"), tristate.state(n).alias("state"), v.alias("value")) for n, v in shown.items()))
    return roles.papers(spark, sf_dir).select("paper_id", F.inline(rows))
