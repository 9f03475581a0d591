"""Scalar functions over identifiers, texts, keys, dates and JSON, on strings made from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import documents, identifiers, text, tristate
from folioscope.plans import roles
from folioscope.plans.registry import query
from folioscope.plans.roles import PAPERS, table


def _none(v):
    """Null shown as a string, which compares by value everywhere."""
    return F.coalesce(v, F.lit("none"))


@query("select p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query(
    """
with r as (select p_partkey, case p_partkey % 5 when 0 then ' https://doi.org/10.' || (1000 + p_partkey) || '/AbC.' || p_size when 1 then 'DOI: 10.' || (1000 + p_partkey) || '/x' || p_size
        when 2 then '10.12/short' when 3 then 'http://dx.doi.org/10.' || (p_partkey + 1000) || '/Q W' else '10.' || (100000 + p_partkey) || '/' || p_brand end as raw from part),
    n as (select p_partkey, lower(trim(regexp_replace(regexp_replace(trim(raw), '^https?://(dx\\.)?doi\\.org/', '', 'i'), '^doi:', '', 'i'))) as v from r)
select p_partkey, case when regexp_full_match(v, '10\\.[0-9]{4,9}/\\S+') then v else 'none' end as doi from n"""
)
def normalize_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    number = (k + 1000).cast("string")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit(" https://doi.org/10."), number, F.lit("/AbC."), size))
        .when(k % 5 == 1, F.concat(F.lit("DOI: 10."), number, F.lit("/x"), size))
        .when(k % 5 == 2, "10.12/short")
        .when(k % 5 == 3, F.concat(F.lit("http://dx.doi.org/10."), number, F.lit("/Q W")))
        .otherwise(F.concat(F.lit("10."), (k + 100000).cast("string"), F.lit("/"), F.col("p_brand")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", _none(identifiers.doi(raw)).alias("doi"))


@query(
    """
with r as (select o_orderkey, case o_orderkey % 4 when 0 then 'https://arxiv.org/abs/' || strftime(o_orderdate + interval 12 year, '%y%m') || '.' || lpad(cast(o_orderkey % 10000 as varchar), 4, '0') || 'v2'
        when 1 then 'arXiv:' || strftime(o_orderdate + interval 22 year, '%y%m') || '.' || lpad(cast(o_orderkey % 100000 as varchar), 5, '0')
        when 2 then 'hep-th/' || strftime(o_orderdate, '%y%m') || lpad(cast(o_orderkey % 1000 as varchar), 3, '0') else 'nonsense/' || strftime(o_orderdate, '%y%m') || '001' end as raw from orders),
    n as (select o_orderkey, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(raw, '^https?://arxiv\\.org/abs/', ''), '^arXiv:', '')), '\\.pdf$', ''), 'v[1-9][0-9]*$', '') as v from r),
    p as (select o_orderkey, v, try_cast(regexp_extract(v, '^([0-9]{4})\\.([0-9]{4,5})$', 1) as int) as ym, regexp_extract(v, '^([0-9]{4})\\.([0-9]{4,5})$', 2) as num,
        regexp_extract(v, '^([a-z-]+)/([0-9]{4})([0-9]{3})$', 1) as arch, try_cast(regexp_extract(v, '^([a-z-]+)/([0-9]{4})([0-9]{3})$', 2) as int) as oym, try_cast(regexp_extract(v, '^([a-z-]+)/([0-9]{4})([0-9]{3})$', 3) as int) as seq from n)
select o_orderkey, case when (ym % 100 between 1 and 12 and ((len(num) = 4 and ym between 704 and 1412) or (len(num) = 5 and ym >= 1501)) and cast(num as int) > 0)
        or (arch = 'hep-th' and oym % 100 between 1 and 12 and (case when oym >= 9100 then 190000 else 200000 end + oym) between 199108 and 200703 and seq > 0) then v else 'none' end as arxiv from p"""
)
def normalize_arxiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    month = lambda years: F.date_format(F.add_months("o_orderdate", 12 * years), "yyMM")
    padded = lambda n: F.lpad((k % 10**n).cast("string"), n, "0")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("https://arxiv.org/abs/"), month(12), F.lit("."), padded(4), F.lit("v2")))
        .when(k % 4 == 1, F.concat(F.lit("arXiv:"), month(22), F.lit("."), padded(5)))
        .when(k % 4 == 2, F.concat(F.lit("hep-th/"), month(0), padded(3)))
        .otherwise(F.concat(F.lit("nonsense/"), month(0), F.lit("001")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", _none(identifiers.arxiv(raw)).alias("arxiv"))


@query(
    """
select p_partkey, case when p_partkey % 3 = 0 and p_partkey > 0 then cast(p_partkey as varchar) else 'none' end as pmid, case when p_partkey % 3 = 1 then 'PMC' || p_partkey else 'none' end as pmcid,
    case when p_partkey % 3 = 2 then 'W' || p_partkey else 'none' end as openalex, case when p_partkey % 2 = 0 then substring(sha256(p_name), 1, 40) else 'none' end as s2,
    case when p_partkey % 4 = 0 then 'Note' || p_partkey else 'none' end as openreview from part"""
)
def normalize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of other schemes, from addresses and labels."""
    k = F.col("p_partkey")
    number = k.cast("string")
    sha = F.substring(F.sha2("p_name", 256), 1, 40)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        _none(identifiers.pmid(F.when(k % 3 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), number, F.lit("/"))).otherwise("PMID:0"))).alias("pmid"),
        _none(identifiers.pmcid(F.when(k % 3 == 1, F.concat(F.lit(" pmcid: pmc"), number)).otherwise(F.lit("PMC")))).alias("pmcid"),
        _none(identifiers.openalex_work(F.when(k % 3 == 2, F.concat(F.lit("https://openalex.org/w"), number)).otherwise("A12"))).alias("openalex"),
        _none(identifiers.semantic_scholar(F.when(k % 2 == 0, F.concat(F.lit("S2:"), F.upper(sha))).otherwise(F.substring(sha, 1, 39)))).alias("s2"),
        _none(identifiers.openreview(F.when(k % 4 == 0, F.concat(F.lit("https://openreview.net/forum?id=Note"), number)).otherwise("a b"))).alias("openreview"),
    )


@query(
    """
with r as (select p_partkey, lpad(cast(p_partkey * 7919 % 10000000 as varchar), 7, '0') || cast(p_partkey % 10 as varchar) as raw from part),
    d as (select p_partkey, raw, 8 * cast(raw[1] as int) + 7 * cast(raw[2] as int) + 6 * cast(raw[3] as int) + 5 * cast(raw[4] as int) + 4 * cast(raw[5] as int) + 3 * cast(raw[6] as int) + 2 * cast(raw[7] as int) + cast(raw[8] as int) as total from r)
select p_partkey, case when total % 11 = 0 and p_partkey % 4 <> 3 then raw[1:4] || '-' || raw[5:8] else 'none' end as issn from d"""
)
def issn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits; a form without hyphen isn't valid, whatever its digits."""
    k = F.col("p_partkey")
    digits = F.concat(F.lpad((k * 7919 % 10000000).cast("string"), 7, "0"), (k % 10).cast("string"))
    hyphenated = F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 4))
    raw = F.when(k % 4 == 3, digits).otherwise(hyphenated)
    return table(spark, sf_dir, "part").select("p_partkey", _none(identifiers.issn(raw)).alias("issn"))


@query(
    """
with r as (select p_partkey, lpad(cast(p_partkey * 104729 % 1000000000000000 as varchar), 15, '0') as raw from part),
    c as (select p_partkey, raw, list_reduce(list_prepend(0, [cast(raw[i] as int) for i in range(1, 16)]), lambda a, x: ((a + x) * 2) % 11) as t from r)
select p_partkey, case when (12 - t) % 11 = p_partkey % 10 then raw[1:4] || '-' || raw[5:8] || '-' || raw[9:12] || '-' || raw[13:15] || cast(p_partkey % 10 as varchar) else 'none' end as orcid from c"""
)
def orcid_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    digits = F.concat(F.lpad((k * 104729 % 1000000000000000).cast("string"), 15, "0"), (k % 10).cast("string"))
    dashed = F.concat_ws("-", *(F.substring(digits, i, 4) for i in (1, 5, 9, 13)))
    return table(spark, sf_dir, "part").select("p_partkey", _none(identifiers.orcid(F.concat(F.lit("https://orcid.org/"), dashed))).alias("orcid"))


@query("select citation_count_state as state, case citation_count_state when 'known' then 0 when 'unknown' then 1 else 2 end as rank, count(*) as papers from papers group by 1, 2", PAPERS)
def state_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.papers(spark, sf_dir).groupBy(F.col("citation_count_state").alias("state")).agg(F.count("*").alias("papers")).select("state", tristate.rank(F.col("state")).alias("rank"), "papers")


@query("select o_orderkey, 't' || strlen(o_orderpriority) || ':' || o_orderpriority || 'm7:' || strftime(o_orderdate, '%Y-%m') || 'p1:' || o_orderstatus as cohort from orders")
def cohort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.cohort_key(F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM"), F.col("o_orderstatus")).alias("cohort"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as at from events")
def rfc3339_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.rfc3339(F.col("ts").cast("timestamp")).alias("at"))


@query("select doc_id, sha256(text) as content_hash from documents")
def sha256_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("select event_id, coalesce(cast(json_extract_string(props, '$.k') as bigint), -1) as k from events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json("props", "k long")["k"], F.lit(-1)).alias("k"))


@query(
    """
select page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) as path from pages"""
)
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))


@query("select p_partkey, case when p_partkey % 3 = 0 then 'https://github.com/org-' || p_size || '/repo.' || p_partkey else 'none' end as repository from part")
def github_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://www.GitHub.com/Org-"), size, F.lit("/Repo."), k, F.lit(".git?tab=readme"))).otherwise(F.concat(F.lit("https://github.com.evil.test/a/"), k))
    return table(spark, sf_dir, "part").select("p_partkey", _none(identifiers.github_repository(raw)).alias("repository"))


@query("select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations")
def collapse_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.collapse_space(F.col("text")).alias("text"))


@query("select doc_id, array_to_string(list_filter(regexp_split_to_array(text, ' '), lambda x: x <> ''), ' ') as abstract from documents")
def inverted_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts from their inverted indexes of word to positions; a text is read and written within its row."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", text.inverted_index_text(text.inverted_index(words)).alias("abstract"))


@query(
    """
select o_orderkey, case when o_orderkey % 4 = 0 then 'year' when o_orderkey % 4 = 1 then 'month' when o_orderkey % 4 = 2 and day(o_orderdate) > 28 and month(o_orderdate) = 12 then 'month' else 'day' end as precision,
    case when o_orderkey % 4 < 2 or (o_orderkey % 4 = 2 and day(o_orderdate) > 28 and month(o_orderdate) = 12) then 'none' when o_orderkey % 4 = 2 then strftime(make_date(year(o_orderdate), month(o_orderdate), least(day(o_orderdate), 28)), '%Y-%m-%d') else strftime(o_orderdate, '%Y-%m-%d') end as day
from orders"""
)
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, month and day as far as they are known and real (31 November falls back to its month)."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    late = (F.dayofmonth(at) > 28) & (F.month(at) == 12)
    day = F.when(k % 4 == 3, F.dayofmonth(at)).when((k % 4 == 2) & late, 40).when(k % 4 == 2, F.least(F.dayofmonth(at), F.lit(28)))
    found = text.partial_date(F.year(at), F.when(k % 4 > 0, F.month(at)), day)
    return table(spark, sf_dir, "orders").select("o_orderkey", found["precision"].alias("precision"), _none(F.date_format(found["at"], "yyyy-MM-dd")).alias("day"))


@query("select n_nationkey, upper(n_name[1]) || lower(n_name[2:]) || ' ' || r_name as author from nation join region on n_regionkey = r_regionkey")
def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", text.person_name(F.initcap("n_name"), F.concat(F.lit("  "), F.col("r_name"))).alias("author"))


@query(
    """
select p_partkey, concat_ws(',', case when p_size > 10 then 'title<-$.p_name' end, case when p_retailprice > 1200 then 'price<-$.p_retailprice' end, 'type<-$.p_type') as evidence from part"""
)
def evidence_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = text.evidence({"title": (F.when(F.col("p_size") > 10, F.col("p_name")), "$.p_name"), "price": (F.when(F.col("p_retailprice") > 1200, F.col("p_retailprice")), "$.p_retailprice"), "type": (F.col("p_type"), "$.p_type")})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(listed, ",").alias("evidence"))


@query(
    """
select p_partkey, case when p_partkey % 3 = 0 then 'doi' when p_partkey % 3 = 1 then 'openalex' else 'none' end as scheme, case when p_partkey % 3 = 0 then 1 when p_partkey % 3 = 1 then 5 else 6 end as priority,
    p_partkey % 15 = 0 as conflict from part"""
)
def canonical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of a work by precedence of schemes; two values in one scheme conflict."""
    k = F.col("p_partkey")
    number = k.cast("string")
    dois = F.array(identifiers.doi(F.when(k % 3 == 0, F.concat(F.lit("10.1234/a"), number))), identifiers.doi(F.when(k % 15 == 0, F.concat(F.lit("doi:10.1234/b"), number))), F.lit(None).cast("string"))
    works = F.array(identifiers.openalex_work(F.when(k % 3 < 2, F.concat(F.lit("W"), number))))
    found = identifiers.canonical_identity({"doi": dois, "openalex": works})
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("i")).select("p_partkey", _none(F.col("i.scheme")).alias("scheme"), identifiers.scheme_priority(F.col("i.scheme")).alias("priority"), F.col("i.conflict").alias("conflict"))


@query(
    """
select doc_id, case when quality is not null and toxic is not null then 'both' when quality is null and toxic is null then 'none' else 'one' end as assertion_count,
    (quality is not null)::int + (toxic is not null)::int = 1 as exclusive from documents left join labels using (doc_id)"""
)
def exclusive_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of two references are there; exactly one is exclusive."""
    there = F.col("quality").isNotNull().cast("int") + F.col("toxic").isNotNull().cast("int")
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.when(there == 2, "both").when(there == 0, "none").otherwise("one").alias("assertion_count"), (there == 1).alias("exclusive"))


@query("select event_id, '{\"a\":\"' || event_type || '\",\"k\":' || event_id || '}' as canonical, event_id % 5 <> 0 as valid from events")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in order; a repeated key makes a value invalid."""
    k, kind = F.col("event_id").cast("string"), F.col("event_type")
    raw = F.concat(F.lit('{ "k" : '), k, F.lit(', "a" : "'), kind, F.lit('" }'))
    twice = F.concat(F.lit('{"k": 1, "k": '), k, F.lit("}"))
    given = F.when(F.col("event_id") % 5 == 0, twice).otherwise(raw)
    return table(spark, sf_dir, "events").select("event_id", documents.canonical_json(raw).alias("canonical"), documents.canonical_json(given).isNotNull().alias("valid"))


@query("select event_id, case event_id % 6 when 0 then 'object' when 1 then 'array' when 2 then 'string' when 3 then 'number' when 4 then 'boolean' else 'invalid' end as kind from events")
def json_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, props = F.col("event_id") % 6, F.col("props")
    raw = F.when(k == 0, props).when(k == 1, F.concat(F.lit("["), props, F.lit("]"))).when(k == 2, '"x"').when(k == 3, "1.5").when(k == 4, "true").otherwise(F.concat(props, F.lit("x")))
    return table(spark, sf_dir, "events").select("event_id", documents.json_kind(raw).alias("kind"))


@query(
    """
with c as (select p_partkey, p_partkey % 9 as k, p_brand, p_name, p_type from part)
select p_partkey, case k when 0 then p_brand || ' & co ' || p_name || ' < ' || p_type when 1 then '1 < 2 and 3 > 2 ' || p_name when 2 then p_name || ' – ' || p_brand || 'é' when 3 then 'a < b & ' || p_type when 8 then p_name end as abstract,
    case k when 4 then 'nesting' when 5 then 'depth' when 6 then 'entity' when 7 then 'markup' end as problem
from c"""
)
def markup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts: sections, plain text, entities, character data; unbalanced, too deep, with unknown entities and with comments."""
    k, tag = F.col("p_partkey") % 9, lambda name, *inner: F.concat(F.lit(f"<jats:{name}>"), *inner, F.lit(f"</jats:{name}>"))
    brand, name, kind = F.col("p_brand"), F.col("p_name"), F.col("p_type")
    raw = (
        F.when(k == 0, tag("sec", tag("title", brand, F.lit(" &amp; "), tag("bold", F.lit("co"))), tag("p", F.lit("\n "), name, F.lit("  &lt; "), kind)))
        .when(k == 1, F.concat(F.lit(" 1 < 2  and 3 > 2 "), name))
        .when(k == 2, tag("p", name, F.lit(" &#x2013; "), brand, F.lit("&#233;")))
        .when(k == 3, tag("p", F.lit("<![CDATA[a < b & ]]>"), kind))
        .when(k == 4, F.concat(F.lit("<jats:p><jats:bold>"), name, F.lit("</jats:p></jats:bold>")))
        .when(k == 5, F.concat(F.repeat(F.lit("<jats:sec>"), 65), name, F.repeat(F.lit("</jats:sec>"), 65)))
        .when(k == 6, tag("p", name, F.lit("&nbsp;")))
        .when(k == 7, tag("p", name, F.lit("<!-- x -->")))
        .otherwise(F.concat(F.lit('<j:p xmlns:j="http://jats.nlm.nih.gov" id="a>b">'), name, F.lit("<j:break/></j:p>")))
    )
    # a small file with much work a row
    return roles.spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", documents.marked_text(raw).alias("t")).select("p_partkey", F.col("t.text").alias("abstract"), "t.problem")


@query(
    """
select p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_type])), ',') as normalised,
    array_to_string(list_sort([x for x in ['Brand#11', 'growth', 'zeta'] if x <> p_brand]), ',') as undeclared from part"""
)
def evidence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists without blanks and repeats, and what is required but not declared."""
    brand, kind = F.col("p_brand"), F.col("p_type")
    listed = F.array(F.concat(F.lit(" "), kind), brand, F.lit(" "), F.concat(brand, F.lit("  ")), kind)
    required = F.array(F.lit("zeta"), F.lit("growth"), F.lit("Brand#11"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(documents.normalised_list(listed), ",").alias("normalised"), F.array_join(documents.undeclared(required, F.array(brand)), ",").alias("undeclared"))


@query("select page_id, base64(encode(url)) as payload from pages")
def payload_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.base64(F.col("url").cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(wrapped, "[\r\n]", "").alias("payload"))


@query("select conv_id, string_agg(role, ',' order by first_turn) as labels from (select conv_id, role, min(turn) as first_turn from conversations group by 1, 2) group by 1")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels in the order of their first occurrence."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("t", "role"))), lambda x: x["role"])
    return first.groupBy("conv_id").agg(F.array_join(listed, ",").alias("labels"))
