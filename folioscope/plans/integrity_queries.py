"""Constraints over the tables, and exact numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import exact
from folioscope.operators import constraints
from folioscope.operators.components import shared_checkpoint_dir
from folioscope.operators.ranking import placed_within
from folioscope.plans import roles
from folioscope.plans.registry import query
from folioscope.plans.roles import PAPERS, table
from folioscope.sources.page_chains import Chains


def _rules(subject: str, key: str, source: str, broken: dict[str, str]) -> str:
    """SQL: a row for each rule, with the rows of ``source`` that meet the rule's condition."""
    return " union all ".join(
        f"select '{subject}' as subject, '{rule}' as rule, count(*) filter (coalesce({bad}, false)) as violations, "
        f"cast(min({key}) filter (coalesce({bad}, false)) as varchar) as least, cast(max({key}) filter (coalesce({bad}, false)) as varchar) as greatest from {source}"
        for rule, bad in broken.items()
    )


VENUES = """
venues as (
    select s_suppkey as venue_id, case s_nationkey % 5 when 0 then 'conference' when 1 then 'magazine' else 'journal' end as venue_type,
        case when s_acctbal < 0 then ' ' else s_name end as display_title,
        substr(s_name, 14, 4) || '-' || substr(s_name, 15, 3) || case when s_nationkey = 7 then 'x' when s_nationkey = 8 then 'X' else '1' end as issn_l,
        case when s_nationkey % 4 = 0 then 'doaj' when s_nationkey % 4 = 1 then 'wiki' end as source_scheme,
        case when s_nationkey % 4 < 2 and s_nationkey <> 12 then s_name end as source_identifier
    from supplier)
"""


def _venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("s_nationkey")
    check = F.when(nation == 7, "x").when(nation == 8, "X").otherwise("1")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("venue_id"),
        F.when(nation % 5 == 0, "conference").when(nation % 5 == 1, "magazine").otherwise("journal").alias("venue_type"),
        F.when(F.col("s_acctbal") < 0, " ").otherwise(F.col("s_name")).alias("display_title"),
        F.concat(F.substring("s_name", 14, 4), F.lit("-"), F.substring("s_name", 15, 3), check).alias("issn_l"),
        F.lit(None).cast("string").alias("issn"),
        F.lit(None).cast("string").alias("eissn"),
        F.when(nation % 4 == 0, "doaj").when(nation % 4 == 1, "wiki").alias("source_scheme"),
        F.when((nation % 4 < 2) & (nation != 12), F.col("s_name")).alias("source_identifier"),
    )


RECORDS = """
records as (
    select o_custkey as identity, case when o_totalprice < 250000 then ' ' else o_orderpriority end as title, case when o_orderstatus = 'P' then o_orderpriority end as abstract,
        case when o_totalprice > 300000 then o_orderdate end as published_at, case when o_orderstatus = 'F' then o_custkey % 100 end as venue_id, lifecycle_status as status
    from orders join papers on o_orderkey = paper_id)
"""
ASSESSED = """
assessed as (
    select l_orderkey, case l_returnflag when 'A' then 'accepted' when 'R' then 'rejected' when 'N' then case when l_discount < 0.01 then 'postponed' else 'not_applicable' end end as decision,
        cast(l_linenumber % 2 as integer) as matched, case when l_linestatus = 'F' then 'journal' else venue_type end as evidence_type,
        case when l_tax < 0.06 then 'venue_type_not_journal' end as reason, venue_type, v.venue_id is not null as found
    from lineitem left join venues v on l_suppkey + case when l_quantity = 50 then 1 else 0 end = v.venue_id)
"""

_STATES = ("published_at", "paper_type", "has_code", "has_data", "citation_count", "trend_score", "has_benchmark")
_SUITE = " union all ".join(
    (
        _rules(
            "venue", "venue_id", "venues",
            {
                "venue type": "venue_type not in ('journal', 'conference', 'preprint', 'repository')", "display title": "trim(display_title) = ''",
                "form of issn_l": "not regexp_full_match(issn_l, '[0-9]{4}-[0-9]{3}[0-9X]')", "form of issn": "false", "form of eissn": "false",
                "controlled source": "(source_scheme is null) <> (source_identifier is null) or source_scheme = 'wiki'",
            },
        ),
        _rules(
            "paper", "paper_id", "faulty",
            {
                "canonical_key is trimmed": "trim(canonical_key) <> canonical_key or trim(canonical_key) = ''",
                **{f"state of {n}": f"{n}_state not in ('known', 'unknown', 'missing')" for n in _STATES},
                **{f"value of {n} by state": f"({n}_state = 'known') <> ({n}_value is not null) or {n}_state not in ('known', 'unknown', 'missing')" for n in _STATES},
                "range of paper_type_value": "paper_type_value not in ('research_article', 'review', 'preprint', 'dataset', 'benchmark')", "range of citation_count_value": "citation_count_value < 0",
                "range of trend_score_value": "trend_score_value < 0 or trend_score_value > 1",
                "range of lifecycle_status": "lifecycle_status not in ('active', 'withdrawn', 'retracted', 'rejected', 'superseded')",
            },
        ),
        _rules("work", "identity", "merged", {f"conflicting {n}": f"{n} > 1" for n in ("title", "abstract", "published_at", "venue_id", "status")}),
        _rules(
            "assessment", "l_orderkey", "assessed",
            {
                "no row of that key": "not found", "decision": "coalesce(decision not in ('accepted', 'rejected', 'unknown', 'not_applicable'), true)",
                "evidence names the type": "evidence_type is null or evidence_type is distinct from venue_type",
                "accepted journals match a rule": "decision = 'accepted' and (venue_type is distinct from 'journal' or matched = 0)",
                "others match none": "decision in ('rejected', 'unknown') and (venue_type is distinct from 'journal' or matched > 0)",
                "not applicable to journals": "decision = 'not_applicable' and (venue_type is not distinct from 'journal' or matched > 0 or reason is distinct from 'venue_type_not_journal')",
            },
        ),
        "select 'line' as subject, 'part and supplier' as rule, cast(coalesce(sum(n), 0) as bigint) as violations, cast(min(low) as varchar) as least, cast(max(high) as varchar) as greatest from repeated",
    )
)
FAULTY = """
faulty as (
    select * replace (case when author_id % 50 = 3 then canonical_key || ' ' else canonical_key end as canonical_key, case when author_id % 60 = 4 then 'pending' else has_code_state end as has_code_state,
        case when author_id % 70 = 5 then null else paper_type_value end as paper_type_value, citation_count_value - 10 as citation_count_value, trend_score_value * 1.1 as trend_score_value) from papers)
"""
MERGED = """
merged as (
    select identity, count(distinct title) filter (trim(title) <> '') as title, count(distinct abstract) filter (trim(abstract) <> '') as abstract, count(distinct published_at) as published_at,
        count(distinct venue_id) as venue_id, count(distinct status) filter (status <> 'active') as status from records where identity is not null group by 1)
"""
REPEATED = "repeated as (select count(*) as n, min(l_orderkey) as low, max(l_orderkey) as high from lineitem where l_partkey is not null and l_suppkey is not null group by l_partkey, l_suppkey having count(*) > 1)"


@query(_SUITE, PAPERS, VENUES, RECORDS, ASSESSED, FAULTY, MERGED, REPEATED)
def constraint_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All constraints of venues, papers, works of one identity and assessments: violators of each rule, the first and the last."""
    papers = roles.papers(spark, sf_dir)
    author, c = F.col("author_id"), F.col
    faulty = papers.withColumns(
        {
            "canonical_key": F.when(author % 50 == 3, F.concat("canonical_key", F.lit(" "))).otherwise(c("canonical_key")),
            "has_code_state": F.when(author % 60 == 4, "pending").otherwise(c("has_code_state")),
            "paper_type_value": F.when(author % 70 != 5, c("paper_type_value")),
            "citation_count_value": c("citation_count_value") - 10,
            "trend_score_value": c("trend_score_value") * 1.1,
        }
    )
    orders = table(spark, sf_dir, "orders").join(papers.select(c("paper_id").alias("o_orderkey"), "lifecycle_status"), "o_orderkey")
    records = orders.select(
        c("o_custkey").alias("identity"),
        F.when(c("o_totalprice") < 250000, " ").otherwise(c("o_orderpriority")).alias("title"),
        F.when(c("o_orderstatus") == "P", c("o_orderpriority")).alias("abstract"),
        F.when(c("o_totalprice") > 300000, c("o_orderdate")).alias("published_at"),
        F.when(c("o_orderstatus") == "F", c("o_custkey") % 100).alias("venue_id"),
        c("lifecycle_status").alias("status"),
    )
    venues = _venues(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem")
    refused = F.when(c("l_discount") < 0.01, "postponed").otherwise("not_applicable")
    assessed = lines.select(
        "l_orderkey",
        F.when(c("l_returnflag") == "A", "accepted").when(c("l_returnflag") == "R", "rejected").when(c("l_returnflag") == "N", refused).alias("decision"),
        F.when(c("l_linenumber") % 2 == 1, F.array(F.lit("jif_gte_10"))).otherwise(F.array().cast("array<string>")).alias("matched_rules"),
        F.when(c("l_linestatus") == "F", "journal").alias("claimed_type"),
        F.when(c("l_tax") < 0.06, constraints.NO_JOURNAL).alias("reason"),
        (c("l_suppkey") + F.when(c("l_quantity") == 50, 1).otherwise(0)).alias("venue_id"),
    )
    rules = constraints.assessment_rules() | {"evidence names the type": F.coalesce("claimed_type", "venue_type").isNotNull() & F.coalesce("claimed_type", "venue_type").eqNullSafe(c("venue_type"))}
    return constraints.all_of(
        ("venue", constraints.row_violations(venues, "venue_id", constraints.venue_rules())),
        ("paper", constraints.row_violations(faulty, "paper_id", constraints.paper_rules(faulty.columns))),
        ("work", constraints.disagreements(records, "identity", constraints.work_fields())),
        ("assessment", constraints.joined_violations(assessed, "l_orderkey", venues.select("venue_id", "venue_type"), ["venue_id"], rules)),
        ("line", constraints.shared_keys(lines, "l_orderkey", "part and supplier", [c("l_partkey"), c("l_suppkey")])),
    )


#: Numerators of up to 38 digits and denominators of up to 20, of both signs.
OPERANDS = """
operands as (
    select o_orderkey, (cast(floor(o_totalprice * 100) as hugeint) * 1000000000000000000 * cast(1000000000 as hugeint) + o_orderkey) * case when o_orderstatus = 'F' then -1 else 1 end as n,
        cast(o_custkey as hugeint) * case when o_orderpriority < '3' then 1000000000000000 else 7 end + case when o_orderkey % 5 = 0 then 0 else o_orderkey % 1000 end as d
    from orders)
"""


@query(
    """
with p as (select o_orderkey, n < 0 as negative, abs(n) as n, d from operands where d <> 0),
    q as (select o_orderkey, negative, n // d as whole, (n % d) * 1000000000000000000 // d as part, (n % d) * 1000000000000000000 % d as rest, d from p),
    r as (select *, part + case when rest * 2 >= d then 1 else 0 end as up from q),
    s as (select o_orderkey, negative, whole + up // 1000000000000000000 as whole, up % 1000000000000000000 as part from r)
select o.o_orderkey, case when whole is not null then case when negative and (whole > 0 or part > 0) then '-' else '' end || cast(whole as varchar) || '.' || lpad(cast(part as varchar), 18, '0') end as quotient
from operands o left join s on o.o_orderkey = s.o_orderkey""",
    OPERANDS,
)
def exact_quotients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotients of wide whole numbers, rounded once at 18 decimals."""
    key = F.col("o_orderkey").cast("decimal(20,0)")
    wide: Column = F.floor(F.col("o_totalprice") * 100).cast("decimal(10,0)") * F.lit("1" + "0" * 27).cast("decimal(28,0)") + key
    n = wide * F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).cast("decimal(1,0)")
    scale = F.when(F.col("o_orderpriority") < "3", F.lit(10**15)).otherwise(F.lit(7)).cast("decimal(16,0)")
    d = F.col("o_custkey").cast("decimal(19,0)") * scale + F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(F.col("o_orderkey") % 1000)
    return table(spark, sf_dir, "orders").select("o_orderkey", exact.quotient_text(n, d).alias("quotient"))


@query(
    """
with v as (select l_orderkey, l_linenumber, '00' || cast(floor(l_extendedprice * 100) as bigint) || '.' || lpad(cast(l_orderkey % 1000 as varchar), 3, '0') || '0' as a,
        cast(cast(floor(l_extendedprice * 100) as bigint) + case when l_linenumber = 2 then 1 else 0 end as varchar) || '.' || lpad(cast(l_partkey % 1000 as varchar), 3, '0') || repeat('0', l_linenumber) as b, l_orderkey % 1000 as fa, l_partkey % 1000 as fb from lineitem)
select l_orderkey, l_linenumber, case when l_linenumber = 2 then 'less' when fa < fb then 'less' when fa = fb then 'equal' else 'greater' end as compared,
    regexp_replace(regexp_replace(regexp_replace(a, '^0+([0-9])', '\\1'), '0+$', ''), '\\.$', '') as shortest from v"""
)
def exact_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals as text in their shortest form, and how two of differing scales compare."""
    whole = F.floor(F.col("l_extendedprice") * 100)
    part = lambda c: F.lpad((F.col(c) % 1000).cast("string"), 3, "0")
    a = F.concat(F.lit("00"), whole.cast("string"), F.lit("."), part("l_orderkey"), F.lit("0"))
    b = F.concat((whole + F.when(F.col("l_linenumber") == 2, 1).otherwise(0)).cast("string"), F.lit("."), part("l_partkey"), F.repeat(F.lit("0"), F.col("l_linenumber")))
    both = F.struct(exact.decimal_order(a).alias("x"), exact.decimal_order(b).alias("y"))
    compared = F.get(F.transform(F.array(both), lambda o: F.when(o["x"] < o["y"], "less").when(o["x"] == o["y"], "equal").otherwise("greater")), F.lit(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", compared.alias("compared"), exact.decimal_text(a).alias("shortest"))


@query(
    """
with numbered as (select doc_id, doc_id % 4 as c, row_number() over (partition by doc_id % 4 order by doc_id) as k from documents),
    d as (select *, cast((k - 1) // 50 + 1 as integer) as page, (k - 1) % 50 + 1 as item, doc_id % 211 = 17 as wrong from numbered),
    pages as (select c, page, count(*) as n, min(item) filter (wrong) as wrong_item, page % 5 = c + 1 and page > 1 as repeats from d group by c, page),
    stops as (select c, page, case when wrong_item is not null then wrong_item else n + 1 end as at, case when wrong_item is not null then 'id' else 'cursor repeated' end as problem, wrong_item, repeats,
        coalesce(sum(n) over (partition by c order by page rows between unbounded preceding and 1 preceding), 0) as items_before, max(page) over (partition by c) as last_page, sum(n) over (partition by c) as items from pages),
    f as (select *, row_number() over (partition by c order by page) as stop from stops where wrong_item is not null or (repeats and page < last_page))
select 'c' || w.c as chain, cast(max(w.last_page) as bigint) as pages, cast(coalesce(max(f.items_before + f.at - 1), max(w.items)) as bigint) as items, max(f.page) as page, cast(max(f.at) as bigint) as item, max(f.problem) as problem
from stops w left join f on f.c = w.c and f.stop = 1 group by w.c"""
)
def page_chain_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of an interface, in four chains, some with a repeated cursor or a malformed item: how far each chain goes."""
    return Chains(spark, _pages(spark, sf_dir), "openalex").verdicts()


def _pages(spark: SparkSession, sf_dir: str) -> str:
    """A folder of pages of 50 documents, each naming the next; every fifth names itself, and an id is wrong now and then.

    Documents are numbered without their texts, which are shuffled once, into their pages.
    """
    folder = f"{shared_checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    documents, chain = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    placed = placed_within(documents.select("doc_id", chain.alias("c")), ["c"], ["doc_id"], "k").withColumn("page", F.floor((F.col("k") - 1) / 50).cast("int") + 1)
    last = placed.groupBy("c").agg(F.max("page").alias("last"))
    ident = F.concat(F.when(F.col("doc_id") % 211 == 17, "X").otherwise("https://openalex.org/W"), (F.col("doc_id") + 1).cast("string"))
    works = documents.select("doc_id", F.col("text").alias("title")).join(placed.join(last, "c"), "doc_id").select("c", "page", "last", "k", F.struct(ident.alias("id"), "title").alias("w"))
    pages = works.groupBy("c", "page", "last").agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("works"))
    number = F.when((F.col("page") % 5 == F.col("c") + 1) & (F.col("page") > 1), F.col("page") - 1).otherwise(F.col("page"))
    cursor = F.when(F.col("page") < F.col("last"), F.concat(F.lit("c"), number.cast("string")))
    body = F.to_json(F.struct(F.struct(cursor.alias("next_cursor")).alias("meta"), F.transform("works", lambda x: x["w"]).alias("results")))
    pages.select(F.concat(F.lit("c"), F.col("c").cast("string")).alias("chain"), "page", body.alias("value")).write.partitionBy("chain", "page").text(folder)
    return folder
