"""Trend formulas, decisions, rankings, search and presentation figures."""

from __future__ import annotations

import contextlib
import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import stemming
from folioscope.functions.text import percent
from folioscope.operators import analytics, catalog, search, textindex
from folioscope.operators.components import shared_checkpoint_dir
from folioscope.operators.ranking import placed
from folioscope.plans import roles
from folioscope.plans.registry import query
from folioscope.plans.roles import PAPERS, TOPICS, table
from folioscope.sources import bulk, metric_import


def _shown(value: Column) -> Column:
    """Exact decimals as doubles of six decimals, for comparison by value."""
    return F.coalesce(F.round(value.cast("double"), 6), F.lit(-999.0))


BOUNDS = """
bounds as (
    select user_id, cast(floor(arg_min(value, (ts, event_id)) * 100) as bigint) as v0, cast(floor(arg_max(value, (ts, event_id)) * 100) as bigint) as v1,
        min(ts) as t0, max(ts) as t1 from events where event_type = 'view' group by user_id)
"""


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("t", F.col("ts").cast("timestamp"))
    at = F.struct("t", "event_id")
    whole = F.floor(F.col("value") * 100)
    return views.groupBy("user_id").agg(F.min_by(whole, at).alias("v0"), F.max_by(whole, at).alias("v1"), F.min("t").alias("t0"), F.max("t").alias("t1"))


@query(
    """
select user_id, case when t1 = t0 then 'zero_denominator' when v0 < 0 or v1 < 0 then 'invalid_metric' else 'ok' end as status,
    case when t1 > t0 and v0 >= 0 and v1 >= 0 then round(cast(v1 - v0 as double) * 86400000000 / (epoch_us(t1) - epoch_us(t0)), 6) else -999.0 end as velocity
from bounds""",
    BOUNDS,
)
def citation_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, v = analytics.citation_velocity(F.col("v0"), F.col("v1"), F.col("t0"), F.col("t1"))
    return _bounds(spark, sf_dir).select("user_id", status.alias("status"), _shown(v).alias("velocity"))


@query(
    """
select user_id, case when t1 = t0 then 'window_mismatch' when v0 < 0 or v1 < 0 then 'invalid_metric' when v0 = 0 then 'zero_denominator' else 'ok' end as status,
    case when t1 > t0 and v0 > 0 and v1 >= 0 then round(cast(v1 - v0 as double) / v0, 6) else -999.0 end as growth
from bounds""",
    BOUNDS,
)
def code_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, v = analytics.code_growth(F.col("v0"), F.col("v1"), F.col("t0"), F.col("t1"))
    return _bounds(spark, sf_dir).select("user_id", status.alias("status"), _shown(v).alias("growth"))


GROWTH = """
growth as (
    select slug, count(distinct p.paper_id) filter (published_at_value >= timestamp '1995-01-01' and published_at_value < timestamp '1996-01-01') as baseline,
        count(distinct p.paper_id) filter (published_at_value >= timestamp '1997-01-01' and published_at_value < timestamp '1998-01-01') as cur
    from topics t join papers p on t.paper_id = p.paper_id where published_at_state = 'known' group by slug)
"""


def _growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = roles.papers(spark, sf_dir).where("published_at_state = 'known'").select("paper_id", "published_at_value")
    year = F.year("published_at_value")
    about = roles.topics(spark, sf_dir).select("paper_id", "slug").distinct().join(dated, "paper_id")
    return about.groupBy("slug").agg(F.count_if(year == 1995).alias("baseline"), F.count_if(year == 1997).alias("cur"))


@query("select slug, case when baseline = 0 then 'zero_denominator' else 'ok' end as status, case when baseline > 0 then round(cast(cur - baseline as double) / baseline, 6) else -999.0 end as growth from growth", PAPERS, TOPICS, GROWTH)
def topic_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of each topic between two windows of equal length."""
    status, v = analytics.topic_growth(F.col("baseline"), F.col("cur"))
    return _growth(spark, sf_dir).select("slug", status.alias("status"), _shown(v).alias("growth"))


ADOPTION = """
adoption as (
    select p_type as method, count(*) filter (l_shipdate < timestamp '1996-01-01') as bt, count(*) filter (l_shipdate < timestamp '1996-01-01' and l_returnflag = 'R') as ba,
        count(*) filter (l_shipdate >= timestamp '1996-01-01') as ct, count(*) filter (l_shipdate >= timestamp '1996-01-01' and l_returnflag = 'R') as ca
    from lineitem join part on l_partkey = p_partkey group by 1)
"""


@query(
    """
select method, case when bt = 0 or ct = 0 then 'zero_denominator' else 'ok' end as status,
    case when bt > 0 and ct > 0 then round(cast(ca * bt - ba * ct as double) / (ct * bt), 6) else -999.0 end as adoption from adoption""",
    ADOPTION,
)
def method_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _adoption(spark, sf_dir)
    status, v = analytics.method_adoption(F.col("ba"), F.col("bt"), F.col("ca"), F.col("ct"))
    return counts.select("method", status.alias("status"), _shown(v).alias("adoption"))


def _adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).alias("before"), (F.col("l_returnflag") == "R").alias("adopted"))
    joined = lines.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("method")), "p_partkey")
    early, adopted = F.col("before"), F.col("adopted")
    return joined.groupBy("method").agg(F.count_if(early).alias("bt"), F.count_if(early & adopted).alias("ba"), F.count_if(~early).alias("ct"), F.count_if(~early & adopted).alias("ca"))


@query(
    """
with c as (select paper_id, citation_count_value as v, paper_type_value as t, strftime(published_at_value, '%Y-%m') as m from papers
        where citation_count_state = 'known' and paper_type_state = 'known' and published_at_state = 'known' and lifecycle_status = 'active'),
    r as (select paper_id, count(*) over (partition by t, m order by v range between unbounded preceding and current row) - 1 as below, count(*) over (partition by t, m) - 1 as others from c)
select paper_id, others as cohort_size, case when others > 0 then round(cast(below * 100 as double) / others, 6) else -999.0 end as percentile from r""",
    PAPERS,
)
def citation_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the cohort's other papers (month and type) with no more citations."""
    rows = roles.papers(spark, sf_dir).where("citation_count_state = 'known' and paper_type_state = 'known' and published_at_state = 'known' and lifecycle_status = 'active'")
    rows = rows.select("paper_id", F.col("citation_count_value").alias("v"), F.col("paper_type_value").alias("t"), F.date_format("published_at_value", "yyyy-MM").alias("m"))
    return analytics.citation_percentile(rows, ["t", "m"], "v").select("paper_id", "cohort_size", _shown(F.col("percentile")).alias("percentile"))


@query(
    """
with r as (select paper_type_value as kind, paper_id, trend_score_value as score, row_number() over (partition by paper_type_value order by trend_score_value desc, paper_id) as n
    from papers where trend_score_state = 'known' and paper_type_state = 'known')
select kind, paper_id, score, n as rank from r where n <= 25""",
    PAPERS,
)
def trend_rank_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best papers of each kind by trend."""
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "paper_id")
    rows = roles.papers(spark, sf_dir).where("trend_score_state = 'known' and paper_type_state = 'known'").select(F.col("paper_type_value").alias("kind"), "paper_id", F.col("trend_score_value").alias("score"))
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 25")


@query("select slug, cast(cur - baseline as bigint) as score, row_number() over (order by cur - baseline desc, slug) as rank from growth", PAPERS, TOPICS, GROWTH)
def trend_rank_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by absolute growth."""
    scored = _growth(spark, sf_dir).select("slug", (F.col("cur") - F.col("baseline")).alias("score"))
    return placed(scored, [F.desc("score"), F.asc("slug")], "rank")


@query(
    """
with r as (select slug, row_number() over (order by baseline desc, slug) as before, row_number() over (order by cur desc, slug) as now from growth)
select slug, before, now, before - now as change from r""",
    PAPERS,
    TOPICS,
    GROWTH,
)
def rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that each topic has won since the earlier window."""
    once = placed(_growth(spark, sf_dir), [F.desc("baseline"), F.asc("slug")], "before")
    ranked = placed(once, [F.desc("cur"), F.asc("slug")], "now")
    return ranked.select("slug", "before", "now", (F.col("before") - F.col("now")).alias("change"))


@query(
    """
with c as (select distinct p.paper_id, slug, citation_count_value as v, paper_type_value as t, strftime(published_at_value, '%Y-%m') as m from papers p join topics o on p.paper_id = o.paper_id
        where citation_count_state = 'known' and paper_type_state = 'known' and published_at_state = 'known' and lifecycle_status = 'active'),
    r as (select paper_id, slug, count(*) over (partition by slug, t, m order by v range between unbounded preceding and current row) - 1 as below, count(*) over (partition by slug, t, m) - 1 as others from c)
select paper_id, slug, others as cohort_size, case when others > 0 then round(cast(below * 100 as double) / others, 6) else -999.0 end as percentile from r""",
    PAPERS,
    TOPICS,
)
def citation_percentile_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``citation_percentile`` in cohorts of topic, month and type; a paper has one for each topic."""
    rows = roles.papers(spark, sf_dir).where("citation_count_state = 'known' and paper_type_state = 'known' and published_at_state = 'known' and lifecycle_status = 'active'")
    rows = rows.select("paper_id", F.col("citation_count_value").alias("v"), F.col("paper_type_value").alias("t"), F.date_format("published_at_value", "yyyy-MM").alias("m"))
    about = roles.topics(spark, sf_dir).select("paper_id", "slug").distinct()
    return analytics.citation_percentile(rows.join(about, "paper_id"), ["slug", "t", "m"], "v").select("paper_id", "slug", "cohort_size", _shown(F.col("percentile")).alias("percentile"))


@query("select method, ca - ba as score, row_number() over (order by ca - ba desc, method) as rank from adoption", ADOPTION)
def trend_rank_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods by how many more adopt them than before."""
    return placed(_adoption(spark, sf_dir).select("method", (F.col("ca") - F.col("ba")).alias("score")), [F.desc("score"), F.asc("method")], "rank")


@query("with r as (select method, row_number() over (order by ca - ba desc, method) as rank from adoption) select method, rank from r where rank > 5 and rank <= 16", ADOPTION)
def trend_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a ranking after a place, and one row more."""
    return trend_rank_methods(spark, sf_dir).where("rank > 5").orderBy("rank").limit(11).select("method", "rank")


SIGNALS = """
signals as (
    select p_type as topic, count(*) as n, round(avg(l_discount) * 10 - 0.25, 4) as growth, round(avg(case when l_returnflag = 'N' then 1.0 else 0.0 end), 4) as density,
        round(avg(case when l_linestatus = 'F' then 1.0 else 0.0 end) + 0.25, 4) as data, round(avg(l_tax) * 15, 4) as reproducibility,
        round(least(1.0, count(*) / 400.0), 4) as coverage, round(0.7 + avg(l_discount), 4) as confidence
    from lineitem join part on l_partkey = p_partkey group by 1)
"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    joined = lines.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("topic")), "p_partkey")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return joined.groupBy("topic").agg(
        F.count("*").alias("n"),
        F.round(F.avg("l_discount") * 10 - 0.25, 4).alias("growth"),
        F.round(share(F.col("l_returnflag") == "N"), 4).alias("density"),
        F.round(share(F.col("l_linestatus") == "F") + 0.25, 4).alias("data"),
        F.round(F.avg("l_tax") * 15, 4).alias("reproducibility"),
        F.round(F.least(F.lit(1.0), F.count("*") / 400.0), 4).alias("coverage"),
        F.round(0.7 + F.avg("l_discount"), 4).alias("confidence"),
    )


OPPORTUNITIES = """
opportunities as (
    select topic, n, case when coverage < 0.8 or n % 10 = 0 then 'insufficient_evidence'
        when growth >= 0.25 and density <= 0.4 and data >= 0.7 and reproducibility >= 0.6 and confidence >= 0.75 then 'worth_pursuing'
        when growth <= -0.1 and density >= 0.8 and data <= 0.3 and reproducibility <= 0.2 and confidence >= 0.7 then 'not_recommended'
        else 'proceed_with_caution' end as status, growth, density from signals)
"""


def _opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = analytics.opportunity(analytics.OpportunityPolicy(), F.col("coverage"), F.col("n") % 10 == 0, F.col("growth"), F.col("density"), F.col("data"), F.col("reproducibility"), F.col("confidence"))
    return _signals(spark, sf_dir).select("topic", "n", status.alias("status"), "growth", "density")


@query("select topic, n, status from opportunities", SIGNALS, OPPORTUNITIES)
def opportunity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opportunities(spark, sf_dir).select("topic", "n", "status")


@query("with r as (select topic, status, row_number() over (order by n desc, topic) as ordinal from opportunities where status = 'proceed_with_caution') select topic, status, ordinal from r where ordinal > 3 and ordinal <= 24", SIGNALS, OPPORTUNITIES)
def opportunity_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after an ordinal, of one status."""
    numbered = placed(_opportunities(spark, sf_dir).where("status = 'proceed_with_caution'"), [F.desc("n"), F.asc("topic")], "ordinal")
    return numbered.where("ordinal > 3").orderBy("ordinal").limit(21).select("topic", "status", "ordinal")


@query("select status, count(*) as topics, count(*) filter (growth >= 0 and growth <= 1 and density is not null) as plottable, count(*) filter (not (growth >= 0 and growth <= 1)) as outside from opportunities group by 1", SIGNALS, OPPORTUNITIES)
def matrix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities by status, and how many have a place on the unit square."""
    inside = F.col("growth").between(0, 1)
    return _opportunities(spark, sf_dir).groupBy("status").agg(F.count("*").alias("topics"), F.count_if(inside & F.col("density").isNotNull()).alias("plottable"), F.count_if(~inside).alias("outside"))


METRICS = """
metrics as (
    select l_suppkey as venue, case when l_suppkey % 5 = 0 then 'conference' else 'journal' end as venue_type, l_linenumber as category,
        case when l_orderkey % 50 = 0 and l_suppkey % 3 = 0 then null else l_quantity / 4.5 end as jif, case when l_quantity > 49 and l_suppkey % 4 = 0 then 'Q1' else 'Q' || (2 + l_linenumber % 3) end as quartile
    from lineitem where l_quantity < 44 or l_suppkey % 4 = 0)
"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    venue = F.col("l_suppkey")
    return (
        table(spark, sf_dir, "lineitem")
        .where((F.col("l_quantity") < 44) | (venue % 4 == 0))
        .select(
            venue.alias("venue"),
            F.when(venue % 5 == 0, "conference").otherwise("journal").alias("venue_type"),
            F.when(~((F.col("l_orderkey") % 50 == 0) & (venue % 3 == 0)), F.col("l_quantity") / 4.5).alias("jif"),
            F.when((F.col("l_quantity") > 49) & (venue % 4 == 0), "Q1").otherwise(F.concat(F.lit("Q"), (2 + F.col("l_linenumber") % 3).cast("string"))).alias("quartile"),
        )
    )


@query(
    """
select venue, case when not bool_and(venue_type = 'journal') then 'not_applicable' when bool_or(coalesce(jif >= 10, false)) or bool_or(coalesce(quartile = 'Q1', false)) then 'accepted'
        when bool_or(jif is null or quartile is null) then 'unknown' else 'rejected' end as decision,
    case when bool_and(venue_type = 'journal') then concat_ws(',', case when bool_or(coalesce(jif >= 10, false)) then 'jif_gte_10' end, case when bool_or(coalesce(quartile = 'Q1', false)) then 'jcr_q1' end) else '' end as reasons
from metrics group by venue""",
    METRICS,
)
def venue_policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.venue_policy(_metrics(spark, sf_dir), ["venue"])


@query(
    """
with stored as (select o_orderkey as k, o_orderpriority as q from orders where o_orderkey % 3 <> 0),
    incoming as (select o_orderkey as k, case when o_orderkey % 41 = 0 then 'changed' else o_orderpriority end as q from orders where o_orderkey % 2 = 0)
select case when s.k is null then 'inserted' when s.q is not distinct from i.q then 'unchanged' else 'conflict' end as outcome, count(*) as rows
from incoming i left join stored s on i.k = s.k group by 1"""
)
def metric_import_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an import against what is stored: inserted, unchanged or in conflict."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k.alias("k"), F.col("o_orderpriority").alias("q"))
    stored = orders.where("k % 3 <> 0").select("k", F.col("q").alias("stored"), F.lit(True).alias("there"))
    incoming = orders.where("k % 2 = 0").withColumn("q", F.when(F.col("k") % 41 == 0, "changed").otherwise(F.col("q")))
    outcome = F.when(F.col("there").isNull(), "inserted").when(F.col("q").eqNullSafe(F.col("stored")), "unchanged").otherwise("conflict")
    return incoming.join(stored, "k", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("rows"))


@query(
    """
select 1 as number, 2 * count(*) as input, count(*) as inserted, count(*) as unchanged, true as first_time from supplier where s_suppkey % 2 = 0
union all select 2, count(*), count(*) filter (s_suppkey % 2 <> 0), count(*) filter (s_suppkey % 2 = 0), true from supplier
union all select 2, count(*), count(*) filter (s_suppkey % 2 <> 0), count(*) filter (s_suppkey % 2 = 0), false from supplier"""
)
def metric_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of files of metrics: one with repeated rows, one that is refused for a row that differs, one with more venues, and that one again."""
    folder = f"{shared_checkpoint_dir(spark)}/metrics-{uuid.uuid4().hex}"
    k = F.col("s_suppkey")
    seven = F.lpad(k.cast("string"), 7, "0")
    left = (11 - F.aggregate(F.transform(F.split(seven, ""), lambda c, i: c.cast("int") * (8 - i)), F.lit(0), lambda a, b: a + b) % 11) % 11
    issn = F.concat(F.substring(seven, 1, 4), F.lit("-"), F.substring(seven, 5, 3), F.when(left == 10, "X").otherwise(left.cast("string")))
    told = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("title"), issn.alias("issn_l"), F.lit(None).cast("string").alias("issn"), issn.alias("eissn"), F.lit(2025).alias("metric_year"), F.concat(F.lit("nation, "), "s_nationkey").alias("category"),
        F.round(F.abs("s_acctbal") / 100, 2).cast("decimal(18,3)").cast("string").alias("jif"), F.concat(F.lit("Q"), (k % 4 + 1).cast("string")).alias("quartile"), F.lit("known").alias("status"), F.lit("supplier").alias("source"), k,
    )
    even = told.where(k % 2 == 0)
    # of one venue the other file tells another impact
    other = even.agg(F.min(k)).first()[0]
    files = {"a": even.union(even.withColumn("jif", F.concat(F.lit("00"), "jif"))), "b": told.withColumn("jif", F.when(k == other, "99999").otherwise(F.col("jif"))), "c": told}
    store, out = metric_import.MetricStore(spark, f"{folder}/store"), []
    for name in ("a", "b", "c", "c"):
        path = f"{folder}/{name}"
        if name not in {r[0] for r in out}:
            files[name].drop("s_suppkey").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        with contextlib.suppress(bulk.Refused):
            known = {r.sha256 for r in store.receipts()}
            r = store.take(path, "2026-01-01", metric_import.Limits(size=1 << 40, rows=1 << 40))
            out.append((name, r.number, r.input, r.inserted, r.unchanged, r.sha256 not in known))
    return spark.createDataFrame(out, "name string, number int, input long, inserted long, unchanged long, first_time boolean").drop("name")


@query(
    """
with c as (select l_orderkey as receipt, count(*) as input, count(*) filter (l_returnflag = 'N') as inserted, count(*) filter (l_returnflag <> 'N' and l_linenumber <> 7) as unchanged from lineitem group by 1)
select receipt, input, inserted, unchanged, inserted + unchanged = input as balanced from c"""
)
def receipt_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts whose inserted and unchanged rows make up the input."""
    fresh = F.col("l_returnflag") == "N"
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("receipt")).agg(F.count("*").alias("input"), F.count_if(fresh).alias("inserted"), F.count_if(~fresh & (F.col("l_linenumber") != 7)).alias("unchanged"))
    return counts.withColumn("balanced", F.col("inserted") + F.col("unchanged") == F.col("input"))


def _words_sql(extra: str) -> str:
    """Stems of the documents' words, in order, as CTEs before ``extra``."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    starts = f"regexp_extract(v, '^({stemming.BEGINNINGS})', 0)"
    chain, last = [], "r2"
    for k, (suffix, replaced) in enumerate(stemming.steps()):
        fixed = "fixed" if k else f"case when v in ({quoted(stemming.AFTER_PLURAL)}) then v end as fixed"
        chain.append(f"t{k} as (select x, p1, p2, {fixed if k else 'null as fixed'}, {replaced} as v from (select *, left(v, length(v) - length(b)) as u from (select *, {suffix} as b from {last})))")
        last = f"t{k}"
        if not k:
            chain.append(f"t as (select x, p1, p2, {fixed}, v from t0)")
            last = "t"
    own = " ".join(f"when x = '{k}' then '{v}'" for k, v in {**stemming.EXCEPTIONS, **{w: w for w in stemming.INVARIANT}}.items())
    return f"""
with told as (select doc_id, [x for x in regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') if x <> '' and x not in ({quoted(sorted(search.STOP_WORDS))})] as xs from documents where text is not null),
words as (select distinct unnest(xs) as x from told),
r0 as (select x, regexp_replace(regexp_replace(x, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') as v from words),
r1 as (select *, case when {starts} <> '' then length({starts}) else {stemming.region('v')} end as p1 from r0),
r2 as (select x, v, p1, p1 + {stemming.region('r')} as p2 from (select *, substring(v, p1 + 1) as r from r1)),
{", ".join(chain)},
stems as (select x, case when length(x) <= 2 then x {own} else lower(coalesce(fixed, v)) end as y from {last}),
w as (select doc_id, list(y order by i) as s from (select doc_id, unnest(xs) as x, unnest(range(1, len(xs) + 1)) as i from told) join stems using (x) group by doc_id)
{extra}"""


def document_index(spark: SparkSession, sf_dir: str) -> textindex.Index:
    """The index of all documents in the shared folder: written by the first query of an application that asks for it."""
    return _written_index(spark.sparkContext.applicationId, sf_dir)


@functools.lru_cache(maxsize=64)
def _written_index(application: str, sf_dir: str) -> textindex.Index:
    spark = SparkSession.active()
    keyed = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("canonical_key"), "text")
    return textindex.Index(spark, f"{shared_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}").write(keyed, "canonical_key", "text")


def _found(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """(doc_id, relevance) of the documents that meet a query, by the index."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("canonical_key"))
    return catalog.filtered(rows, catalog.PaperQuery(q=query).normalised(), document_index(spark, sf_dir)).select("doc_id", "relevance")


@query(_words_sql("select doc_id from w where list_contains(s, 'thtion') and list_contains(s, 'erth') or list_contains(s, 'erh') and not list_contains(s, 'ofer')"))
def search_match_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that must occur, an alternative, and one that must not."""
    return _found(spark, sf_dir, "thtion erthe or erhe -ofer").select("doc_id")


@query(_words_sql("select doc_id from w where contains(' ' || array_to_string(s, ' ') || ' ', ' all right reserv ')"))
def search_match_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, '"all rights reserved"').select("doc_id")


@query(_words_sql("select doc_id, round(len([x for x in s if x in ('erh', 'thtion')]) / (1.0 + ln(1.0 + len(s))), 6) as relevance from w where list_contains(s, 'erh') and list_contains(s, 'thtion')"))
def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented rank of each match."""
    return _found(spark, sf_dir, "thtion erhe")


@query(
    """
with p as (select user_id, event_id, ts, case when event_type <> 'error' then value end as v from events),
    g as (select *, sum(case when v is null then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as gap,
        min(v) over (partition by user_id) as lo, max(v) over (partition by user_id) as hi from p)
select event_id, dense_rank() over (partition by user_id order by gap) as segment, round(case when hi > lo then (v - lo) / (hi - lo) else 0.5 end, 6) as scaled from g where v is not null"""
)
def sparkline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a subject's line, scaled, in segments between unknown points."""
    points = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return analytics.segments(points, "user_id", "at", "v").select("event_id", F.col("segment").cast("long").alias("segment"), F.round("scaled", 6).alias("scaled"))


@query("select event_type, floor(avg(case when value > 50 then 1.0 else 0.0 end) * 1000 + 0.5) / 10 as percent from events group by 1")
def evidence_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(share.alias("share")).select("event_type", percent(F.col("share")).alias("percent"))
