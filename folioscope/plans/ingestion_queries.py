"""Ingestion: policies, projection of records, venues, files; and the small rules they use."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import identifiers, text, tristate
from folioscope.operators import analytics, catalog, jobs, policies, projection, state, venues
from folioscope.operators.components import shared_checkpoint_dir
from folioscope.plans import incremental, publication, roles
from folioscope.plans.registry import query
from folioscope.plans.roles import PAPERS, SOURCE_EVENTS, TOPICS, table
from folioscope.sources import bulk, records


def _key(name: str) -> Column:
    return F.col(name).cast("string")


# policies and states


@query(
    """
select o_orderkey as event_id, case when o_orderkey % 3 = 0 or o_orderkey % 5 = 0 then 'included' else 'excluded' end as status,
    case when o_orderkey % 3 = 0 or o_orderkey % 5 = 0 then 'controlled_canonical_identity_present' else 'no_supported_canonical_identity' end as reason, 'v2' as scope_policy
from orders"""
)
def scope_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which records a policy includes: those with a valid DOI or arXiv id."""
    return _decisions(spark, sf_dir).select("event_id", "status", "reason", "scope_policy")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    doi = identifiers.doi(F.when(k % 3 == 0, F.concat(F.lit("doi:10.1234/"), _key("event_id"))).otherwise("10.1/x"))
    arxiv = identifiers.arxiv(F.when(k % 5 == 0, F.lit("arXiv:2401.01234v2")).otherwise("2413.00001"))
    return policies.controlled_identity("v2", {"doi": doi, "arxiv": arxiv}).decided(records)


@query("select o_orderkey as event_id, 'v2' as scope_policy from orders where o_orderkey % 4 <> 0")
def scope_decision_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replay adds to decisions of which a part is stored; stored ones must be told the same."""
    told = _decisions(spark, sf_dir)
    return policies.new_decisions(told.where("event_id % 4 = 0"), told.union(told)).select("event_id", "scope_policy")


@query(
    """
with told as (select *, struct_pack(a := source_time, b := tie_break_key, c := position, d := event_id) as r from source_events),
    old as (select event_key, max(r) as r from told where event_id % 2 = 0 group by 1),
    new as (select event_key, max(r) as r, arg_max(value, r) as value, arg_max(event_kind, r) as kind from told where event_id % 3 = 0 group by 1)
select event_key, case when new.r is null or (old.r is not null and new.r < old.r) then 'unchanged' when kind = 'delete' then 'deleted' when value > 60 then 'excluded' else 'projected' end as outcome
from old full join new using (event_key)""",
    SOURCE_EVENTS,
)
def projection_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch under new policies does to each state: the same event is told anew."""

    def states(events: DataFrame, version: str, excluded: Column) -> DataFrame:
        latest = state.latest_by(events, ["event_key"])
        return latest.select(
            "event_key", "event_id", "event_kind", "source_time", "tie_break_key", "position", (F.col("event_key").cast("long") % 7).alias("work_id"),
            F.when(excluded, policies.EXCLUDED).otherwise(policies.INCLUDED).alias("scope_status"), F.lit(version).alias("scope_policy"), F.lit(version).alias("projection_policy"),
        )

    events = roles.source_events(spark, sf_dir)
    stored = states(events.where("event_id % 2 = 0"), "v1", F.lit(False))
    incoming = states(events.where("event_id % 3 = 0"), "v2", F.col("value") > 60)
    return policies.projected_states(stored, incoming, ["event_key"]).select("event_key", "outcome")


@query("select lifecycle_status as status, count(*) as works, count(*) filter (lifecycle_status = 'active' and paper_id % 6 <> 0) as rankable from papers group by 1", PAPERS)
def rankable_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active works that aren't excluded."""
    rows = roles.papers(spark, sf_dir).select(F.col("lifecycle_status").alias("status"), (F.col("paper_id") % 6 == 0).alias("excluded"))
    return rows.groupBy("status").agg(F.count("*").alias("works"), F.count_if(catalog.rankable(F.col("status"), F.col("excluded"))).alias("rankable"))


# projection of records

WORKS = """
works as (
    select c_custkey as work_id, [{'name': ' ' || c_name || ' ', 'collective': 'x', 'orcid': case when c_custkey % 3 = 0 then 'o' || c_custkey % 10 end, 'position': 0},
        {'name': ' ', 'collective': 'Group ' || c_nationkey, 'orcid': null, 'position': 0}, {'name': null, 'collective': '', 'orcid': null, 'position': 0}, {'name': 'Last', 'collective': null, 'orcid': ' ', 'position': 9}] as authors,
        [{'name': c_mktsegment, 'score': case when c_custkey % 2 = 0 then 0.5 end}, {'name': '  ', 'score': 0.1}] as topics from customer)
"""


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("c_custkey"), F.lit(None).cast("string")

    def author(name: Column, collective: Column, orcid: Column, position: int) -> Column:
        return F.struct(name.alias("name"), collective.alias("collective"), orcid.alias("orcid"), F.lit(position).alias("position"), F.lit(None).cast("boolean").alias("corresponding"))

    def topic(name: Column, score: Column) -> Column:
        return F.struct(name.alias("name"), score.cast("double").alias("score"))

    url = lambda host: F.concat(F.lit(f"https://{host}/Org/Repo-"), (k % 100).cast("string"))
    return table(spark, sf_dir, "customer").select(
        k.alias("work_id"),
        F.array(
            author(F.concat(F.lit(" "), "c_name", F.lit(" ")), F.lit("x"), F.when(k % 3 == 0, F.concat(F.lit("o"), (k % 10).cast("string"))), 0),
            author(F.lit(" "), F.concat(F.lit("Group "), _key("c_nationkey")), none, 0),
            author(none, F.lit(""), none, 0),
            author(F.lit("Last"), none, F.lit(" "), 9),
        ).alias("authors"),
        F.when(k % 10 != 0, F.array(topic(F.col("c_mktsegment"), F.when(k % 2 == 0, 0.5)), topic(F.lit("  "), F.lit(0.1)))).alias("topics"),
        F.array(url("github.com"), url("www.github.com"), url("example.org")).alias("code_urls"),
        F.when(k % 4 != 0, F.col("c_name")).otherwise("").alias("title"),
        F.lit(None).cast("string").alias("abstract"),
        F.when(k % 2 == 0, F.lit("2024-01-01")).alias("published_at"),
        F.when(k % 5 == 0, F.col("c_mktsegment")).alias("venue"),
        F.when(k % 3 != 0, F.floor("c_acctbal")).alias("citation_count"),
        F.lit("customer").alias("source"),
        F.lit("2024-02-01").alias("observed_at"),
    )


@query(
    """
with a as (select work_id, unnest(authors) as a, unnest(range(1, 5)) as place from works),
    n as (select work_id, case when a.position > 0 then a.position else place end as position, coalesce(nullif(trim(a.name), ''), nullif(trim(a.collective), '')) as name from a)
select work_id, position, name from n where name is not null""",
    WORKS,
)
def work_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors with their places; nameless ones are left out, a collective stands for a blank name."""
    return projection.authors(_works(spark, sf_dir)).select("work_id", F.col("position").cast("long").alias("position"), "name")


@query("with a as (select work_id, unnest(authors) as a from works) select a.orcid as orcid, arg_max(trim(a.name), work_id) as name, count(*) as works from a where trim(a.orcid) <> '' group by 1", WORKS)
def author_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One author for each ORCID, under the name that came last."""
    return projection.author_entities(projection.authors(_works(spark, sf_dir)), "work_id")


@query("with t as (select work_id, unnest(topics) as t from works where work_id % 10 <> 0) select work_id, t.name as name, coalesce(cast(t.score as double), 1.0) as confidence from t where trim(t.name) <> ''", WORKS)
def work_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of works; confidence is 1 where a source gives none."""
    return projection.topics(_works(spark, sf_dir))


@query("select c_custkey as work_id, 'https://github.com/org/repo-' || c_custkey % 100 as repository from customer")
def work_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.repositories(_works(spark, sf_dir))


@query("select c_custkey as work_id, cast(floor(c_acctbal) as bigint) as value from customer where c_custkey % 3 <> 0 and c_acctbal >= 0 and c_custkey % 2 <> 0")
def citation_metric_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation counts that aren't stored for their time; negative ones are none."""
    works = _works(spark, sf_dir)
    return projection.citation_metrics(works, works.where("work_id % 2 = 0")).select("work_id", "value")


@query(
    """
select c_custkey as work_id, unnest(['title', 'abstract', 'published_at', 'venue', 'citation_count', 'authors', 'topics', 'code_urls']) as field,
    unnest([case when c_custkey % 4 <> 0 then 'known' else 'missing' end, 'missing', case when c_custkey % 2 = 0 then 'known' else 'missing' end, case when c_custkey % 5 = 0 then 'known' else 'missing' end,
        case when c_custkey % 3 <> 0 then 'known' else 'missing' end, 'known', case when c_custkey % 10 <> 0 then 'known' else 'unknown' end, 'known']) as state
from customer"""
)
def work_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each record knows of eight fields."""
    return projection.assertions(_works(spark, sf_dir)).select("work_id", "field", "state")


# venues


@query(
    """
with v as (select s_suppkey as venue_id, 'S' || s_suppkey % 30 as source_id, 'I' || s_suppkey % 17 as a, 'P' || s_suppkey % 23 as b from supplier where s_suppkey % 5 = 0),
    c as (select s_suppkey as record, ['journal', ' Conference', 'blog'][1 + s_suppkey % 3] as kind, case when s_suppkey % 11 <> 0 then s_name end as name, 'S' || s_suppkey % 90 as source_id, ['i' || s_suppkey % 40, ' P' || s_suppkey % 50] as issns from supplier),
    m as (select record, count(distinct venue_id) as matches, min(venue_id) as venue_id from c join v on c.source_id = v.source_id or v.a in (upper(trim(issns[1])), upper(trim(issns[2]))) or v.b in (upper(trim(issns[1])), upper(trim(issns[2]))) group by 1)
select record, coalesce(matches, 0) as matches, coalesce(case when kind <> 'blog' and name is not null and matches = 1 then venue_id end, -1) as venue_id,
    case when kind = 'blog' or name is null then 'skip' when matches is null then 'insert' when matches = 1 then 'reuse' else 'conflict' end as resolution
from c left join m using (record)"""
)
def venue_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues of records by source identifier or any ISSN: none inserts, several are a conflict."""
    k = F.col("s_suppkey")
    join = lambda mark, n: F.concat(F.lit(mark), (k % n).cast("string"))
    suppliers = table(spark, sf_dir, "supplier")
    known = suppliers.where(k % 5 == 0).select(k.alias("venue_id"), join("S", 30).alias("source_id"), join("I", 17).alias("issn_l"), join("P", 23).alias("issn"), F.lit(None).cast("string").alias("eissn"))
    kind = F.element_at(F.array(F.lit("journal"), F.lit(" Conference"), F.lit("blog")), (k % 3 + 1).cast("int"))
    asked = suppliers.select(k.alias("record"), kind.alias("kind"), F.when(k % 11 != 0, F.col("s_name")).alias("name"), join("S", 90).alias("source_id"), F.array(join("i", 40), join(" P", 50)).alias("issns"))
    return venues.resolved(asked, known).withColumn("venue_id", F.coalesce("venue_id", F.lit(-1)))


@query(
    """
with a as (select distinct s_nationkey % 7 as v, trim(' N' || s_nationkey % 9 || ' ') as alias, case when s_suppkey % 4 = 0 then 'other' else 'jcr' end as source from supplier),
    k as (select *, strlen(v::varchar) || ':' || v || ':' || strlen(alias) || ':' || alias || ':' || strlen(source) || ':' || source as key from a)
select key, case when source <> 'jcr' then 'source' end as problem from k"""
)
def venue_alias_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of an import, each once, under collision-free keys."""
    n = F.col("s_nationkey")
    rows = table(spark, sf_dir, "supplier").select((n % 7).alias("venue_id"), F.concat(F.lit(" N"), (n % 9).cast("string"), F.lit(" ")).alias("alias"), F.when(F.col("s_suppkey") % 4 == 0, "other").otherwise("jcr").alias("source"))
    return venues.alias_plan(rows, "jcr").select("key", "problem")


@query("select p_partkey, case when p_partkey % 3 = 0 then 'journal' when p_partkey % 3 = 1 then 'conference' else 'none' end as of_work, case when p_partkey % 2 = 0 then 'repository' else 'none' end as normal from part")
def venue_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("journal-article"), F.lit("proceedings-article"), F.lit("book")), (k % 3 + 1).cast("int"))
    raw = F.when(k % 2 == 0, " Repository ").otherwise("ebook platform")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(venues.type_of_work(kind), F.lit("none")).alias("of_work"), F.coalesce(venues.venue_type(raw), F.lit("none")).alias("normal"))


# a catalog kept up in batches


@query(
    """
with told as (select *, (cast(event_key as bigint) + event_id % 3) % 50 as work_id, event_id % 5 <> 0 as included, struct_pack(a := source_time, b := tie_break_key, c := position, d := event_id) as r from source_events),
    latest as (select event_key, unnest(arg_max(struct_pack(work_id := work_id, included := included, kind := event_kind, event_id := event_id, type := tie_break_key, r := r), r)) from told group by 1),
    won as (select work_id, unnest(arg_max(struct_pack(winner := event_key, event_id := event_id, type := type), r)) from latest where included and kind <> 'delete' group by 1)
select work_id, winner, event_id, type || ' ' || event_id as title, 'Author ' || event_id % 9 || ',' || winner as authors, type as topics,
    case when event_id % 2 = 0 then 'https://github.com/org/r' || event_id % 7 else '' end as repositories, 6 + case when event_id % 4 = 0 then 1 else 0 end - case when event_id % 2 = 0 then 0 else 1 end as known_fields
from won""",
    SOURCE_EVENTS,
)
def incremental_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of events that came in three batches, each of which derived the works that it touched; records move between works."""
    held = incremental_catalog(spark, sf_dir, f"{shared_checkpoint_dir(spark)}/catalog-{uuid.uuid4().hex}")
    listed = lambda name, value: held.table(name).groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*value))), lambda x: x[value[-1]]), ",").alias(name))
    known = held.table("assertions").where("state = 'known'").groupBy("work_id").agg(F.count("*").alias("known_fields"))
    works = held.table("works").select("work_id", "winner", "event_id", "title")
    for more in (listed("authors", ["position", "name"]), listed("topics", ["name"]), listed("repositories", ["repository"]), known):
        works = works.join(more, "work_id", "left")
    return works.withColumn("repositories", F.coalesce("repositories", F.lit("")))


def incremental_catalog(spark: SparkSession, sf_dir: str, folder: str) -> incremental.Catalog:
    """A catalog that took the events in by three batches, by their ids."""
    event, key = F.col("event_id"), F.col("event_key")
    fields = incremental.demonstration_record(key, event, F.col("value"), F.col("tie_break_key"))
    work = (key.cast("long") + event % 3) % 50
    told = roles.source_events(spark, sf_dir).select("event_id", "event_key", "event_kind", "source_time", "tie_break_key", "position", F.lit("events").alias("source"), work.alias("work_id"), *(v.alias(n) for n, v in fields.items()))
    doi = identifiers.doi(F.when(event % 5 != 0, F.concat(F.lit("10.4321/"), event.cast("string"))))
    held = incremental.Catalog(spark, folder, policies.controlled_identity("v1", {"doi": doi}), "p1")
    for number in (1, 2, 3):
        held.apply(told.where(event % 3 == 3 - number), number)
    return held


# files and small rules


@query(
    """
with e as (select user_id + 1 as pmid, 1 + event_id % 3 as seq, event_id, event_type = 'error' as gone, date_trunc('day', ts) as revised, event_type || ' ' || event_id as title from events),
    files as (select seq, max(max(case when not gone then revised end)) over (order by seq) as latest from e group by 1),
    ranked as (select *, row_number() over (partition by pmid order by case when gone then latest else revised end desc, seq desc, event_id desc) as k from e join files using (seq))
select 'pubmed:' || pmid as event_key, title, revised as source_time, cast(seq as integer) as sequence from ranked where k = 1 and not gone"""
)
def pubmed_file_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and their deletions in three numbered bulk files of XML, read back as one stream of events: what is there in the end."""
    folder = _bulk_files(spark, sf_dir)
    path = f"{folder}/*.xml"
    told = publication.events_of(records.pubmed(spark, path))
    told = told.unionByName(publication.deletions_of(records.pubmed_deletions(spark, path), told))
    # titles are asked for; what else a record holds is neither derived nor shuffled
    return publication.current_records(told.withColumn("record", F.struct("record.title"))).select("event_key", "record.title", "source_time", F.substring("tie_break_key", 1, 8).cast("int").alias("sequence"))


def _bulk_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the events as three numbered files of articles and deletions."""
    folder = f"{shared_checkpoint_dir(spark)}/bulk-{uuid.uuid4().hex}"
    k, day = F.col("event_id"), F.col("ts").cast("timestamp")
    revised = F.concat(*(F.concat(F.lit(f"<{tag}>"), F.date_format(day, form), F.lit(f"</{tag}>")) for tag, form in (("Year", "yyyy"), ("Month", "MM"), ("Day", "dd"))))
    pmid = F.concat(F.lit("<PMID>"), (F.col("user_id") + 1).cast("string"), F.lit("</PMID>"))
    title = F.concat(F.lit("<Article><ArticleTitle>"), "event_type", F.lit(" "), k.cast("string"), F.lit("</ArticleTitle></Article>"))
    article = F.concat(F.lit("<PubmedArticle><MedlineCitation>"), pmid, F.lit("<DateRevised>"), revised, F.lit("</DateRevised>"), title, F.lit("</MedlineCitation></PubmedArticle>"))
    gone = F.concat(F.lit("<DeleteCitation>"), pmid, F.lit("</DeleteCitation>"))
    events = table(spark, sf_dir, "events")
    for number in (1, 2, 3):
        lines = events.where(k % 3 == number - 1).repartitionByRange("event_id").sortWithinPartitions("event_id").select(F.when(F.col("event_type") == "error", gone).otherwise(article).alias("value"))
        lines.write.text(f"{folder}/pubmed26n{number:04d}.xml")
    return folder


@query(
    """
select cast(1 + event_id % 3 as integer) as sequence, case when event_type = 'error' then 'delete' else 'upsert' end as kind, count(*) as events, count(distinct user_id) as articles
from events group by 1, 2"""
)
def bulk_file_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ledger of bulk files holds, after files out of order, with a wrong hash and twice over."""
    folder = _bulk_files(spark, sf_dir)
    held = bulk.Ledger(spark, f"{folder}/ledger")
    for number, sha in ((2, None), (1, "0" * 64), (1, None), (1, None), (3, None), (2, None), (3, None)):
        with contextlib.suppress(bulk.Refused):
            held.take(f"{folder}/pubmed26n{number:04d}.xml", number, sha)
    return held.events().groupBy("sequence", "kind").agg(F.count("*").alias("events"), F.count_distinct("record_id").alias("articles"))


@query(
    """
with f as (select n_nationkey as position, case when n_nationkey = 9 then 7 when n_nationkey > 14 then n_nationkey + 2 else n_nationkey + 1 end as s from nation where n_nationkey <> 20),
    b as (select *, coalesce(lag(s) over (order by position), 0) as before, count(*) over (partition by s order by position) as seen from f)
select position, s as sequence, coalesce(case when seen > 1 then 'duplicate' when s <= before then 'out_of_order' when s <> before + 1 then 'missing_before' end, 'none') as problem from b"""
)
def file_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk files whose numbers don't follow each other."""
    n = F.col("n_nationkey")
    number = F.when(n == 9, 7).when(n > 14, n + 2).otherwise(n + 1)
    name = F.concat(F.lit("pubmed26n"), F.lpad(number.cast("string"), 4, "0"), F.lit(".xml.gz"))
    files = table(spark, sf_dir, "nation").where("n_nationkey <> 20").select(n.alias("position"), name.alias("name"), F.sha2("n_name", 256).alias("sha256"))
    return jobs.sequence_problems(files, 2026, 0).select("position", "sequence", F.coalesce("problem", F.lit("none")).alias("problem"))


@query("select p_partkey, case when p_partkey % 3 = 0 and p_partkey > 0 then 'A' || p_partkey else 'none' end as author, case when p_partkey % 3 = 1 then 'T' || p_partkey else 'none' end as topic from part")
def openalex_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.concat(F.lit(" https://OpenAlex.org/"), F.element_at(F.array(F.lit("a"), F.lit("t"), F.lit("w0")), (k % 3 + 1).cast("int")), k.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", *(F.coalesce(identifiers.openalex_entity(raw, p), F.lit("none")).alias(n) for p, n in (("A", "author"), ("T", "topic"))))


@query(
    """
select p_partkey, case p_partkey % 6 when 0 then 'year' when 1 then 'month' when 2 then 'day' when 3 then 'season' when 4 then 'text' else 'none' end as precision,
    case p_partkey % 6 when 5 then 'season_and_month' else 'none' end as problem, case when p_partkey % 6 = 2 then '2024-02-' || lpad(cast(1 + p_partkey % 28 as varchar), 2, '0') else 'none' end as day
from part"""
)
def bibliographic_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of articles: structured, seasons, or plain text; mixtures are errors."""
    kind = F.col("p_partkey") % 6
    none = F.lit(None).cast("string")
    at = lambda value, *kinds: F.when(kind.isin(*kinds), value).otherwise(none)
    date = text.bibliographic_date(at(F.lit("2024"), 0, 1, 2, 3, 5), at(F.lit("Feb"), 1, 2, 5), at((F.col("p_partkey") % 28 + 1).cast("string"), 2), at(F.lit(" Winter"), 3, 5), at(F.lit("2024 Nov-Dec"), 4))
    shown = table(spark, sf_dir, "part").select("p_partkey", date.alias("d"))
    return shown.select("p_partkey", F.coalesce("d.precision", F.lit("none")).alias("precision"), F.coalesce("d.problem", F.lit("none")).alias("problem"), F.coalesce(F.date_format("d.at", "yyyy-MM-dd"), F.lit("none")).alias("day"))


@query("select o_orderkey, strftime(coalesce(case when o_orderkey % 3 = 0 then o_orderdate + interval 1 day end, case when o_orderkey % 5 = 0 then o_orderdate + interval 2 day end, o_orderdate), '%Y-%m-%d') as revised from orders")
def revision_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    told = text.revision_time(F.when(k % 3 == 0, at + F.expr("interval 1 day")), none, F.when(k % 5 == 0, at + F.expr("interval 2 days")), none, at)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(told, "yyyy-MM-dd").alias("revised"))


@query("select o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month from orders")
def months_in_own_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month that a time names in its own zone, whatever it is in UTC."""
    zone = F.when(F.col("o_orderkey") % 2 == 0, "T23:30:00-11:00").otherwise("T00:30:00+13:00")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(text.month_in_own_zone(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), zone)), "yyyy-MM-dd").alias("month"))


@query("select p_partkey, p_partkey % 3 <> 0 as whole, p_size between 10 and 40 as in_range from part")
def list_and_score_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists without nulls, and scores from 0 to 1."""
    k = F.col("p_partkey")
    listed = F.array(F.lit("a"), F.when(k % 3 != 0, "b"))
    return table(spark, sf_dir, "part").select("p_partkey", text.no_nulls(listed).alias("whole"), text.in_range((F.col("p_size") - 10) / 30).alias("in_range"))


@query(
    """
select p_partkey, case p_partkey % 3 when 0 then '$.best=cc-by' when 1 then '$.first=cc-by,$.locations[1]=mit' else '$.first=cc-by,$.best=cc0,$.locations[1]=mit' end as licenses from part"""
)
def license_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of a work's locations: each once, where it comes first."""
    kind = F.col("p_partkey") % 3
    place = lambda name: F.struct(F.when(name != "", name).alias("license"), F.lit("").alias("license_id"))
    first, best = F.when(kind == 0, "").otherwise("cc-by"), F.when(kind == 0, "cc-by").when(kind == 1, "").otherwise("cc0")
    others = F.array(place(F.lit("cc-by")), place(F.when(kind == 0, "cc-by").otherwise("mit")))
    found = text.licenses([("$.first", place(first)), ("$.best", place(best))], [("$.locations", others)])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(found, lambda x: F.concat(x["path"], F.lit("="), x["name"])), ",").alias("licenses"))


@query("select paper_id, case citation_count_state when 'known' then citation_count_value || ' times' when 'unknown' then 'not covered' else 'missing' end as cited, case has_code_state when 'known' then case when has_code_value then 'yes' else 'no' end else 'not covered' end as code from papers", PAPERS)
def presented_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tri-state values as text."""
    shown = [tristate.presented(tristate.state(n), tristate.value(n), suffix=s).alias(a) for n, s, a in (("citation_count", " times", "cited"), ("has_code", "", "code"))]
    return roles.papers(spark, sf_dir).select("paper_id", *shown)


# lookups, pages and outcomes


@query(
    """
select 'paper' as asked, canonical_key as key, lifecycle_status as told from papers where canonical_key = 'order:7'
union all select 'topic', slug, cast(count(distinct paper_id) as varchar) from topics where slug = 'brand-11' group by slug""",
    PAPERS,
    TOPICS,
)
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper and a topic by key; absent, malformed and null keys all find nothing."""
    papers = roles.papers(spark, sf_dir).select("canonical_key", "lifecycle_status")
    topics = catalog.taxonomy(roles.topics(spark, sf_dir), "paper_id", "slug", "name")
    asked = [("paper", papers, "canonical_key", "lifecycle_status", k, None) for k in ("order:7", "order:-1", None)]
    asked += [("topic", topics, "slug", "paper_count", k, catalog.SLUG) for k in ("brand-11", "brand-9999", "Not A Slug")]
    found = [catalog.lookup(rows, key, wanted, pattern).select(F.lit(name).alias("asked"), F.col(key).alias("key"), F.col(told).cast("string").alias("told")) for name, rows, key, told, wanted, pattern in asked]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _relevance_sql(where: str, limit: int) -> str:
    from folioscope.plans.analytics_queries import _words_sql

    return _words_sql(f""", r as (select 'doc:' || doc_id as canonical_key, round(len([x for x in s if x in ('erh', 'thtion')]) / (1.0 + ln(1.0 + len(s))), 6) as sort_value
        from w where list_contains(s, 'erh') or list_contains(s, 'thtion')),
    p as (select *, row_number() over (order by sort_value desc, canonical_key) as place from r where {where})
select place, canonical_key, sort_value from p where place <= {limit}""")


def _relevance_page(spark: SparkSession, sf_dir: str, position: tuple[int, object, str] | None) -> DataFrame:
    from folioscope.plans.analytics_queries import document_index

    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), _key("doc_id")).alias("canonical_key"))
    page = catalog.page(rows, catalog.PaperQuery(q="thtion or erhe").normalised(), position, document_index(spark, sf_dir))
    # a page has a hundred rows at most, so one window numbers them
    order = Window.orderBy(F.desc("sort_value"), "canonical_key")
    return page.select(F.row_number().over(order).cast("long").alias("place"), "canonical_key", "sort_value")


@query(_relevance_sql("true", 21))
def search_relevance_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page by relevance, and one row more."""
    return _relevance_page(spark, sf_dir, None)


@query(_relevance_sql("sort_value < 0.5 or (sort_value = 0.5 and canonical_key > 'doc:5')", 21))
def search_relevance_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page by relevance after a rank and key."""
    return _relevance_page(spark, sf_dir, (0, 0.5, "doc:5"))


@query(
    """
with r as (select canonical_key, citation_count_value as v, case citation_count_state when 'known' then 0 when 'unknown' then 1 else 2 end as k from papers),
    p as (select canonical_key, k as sort_rank, cast(v as double) as sort_value, row_number() over (order by k, v desc nulls last, canonical_key) as place from r where k > 0 or v < 150 or (v = 150 and canonical_key > 'order:5'))
select place, canonical_key, sort_rank, sort_value from p where place <= 21""",
    PAPERS,
)
def paper_keyset_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a known count and key."""
    page = catalog.page(roles.papers(spark, sf_dir), catalog.PaperQuery(sort="citations_desc").normalised(), (0, 150, "order:5"))
    order = Window.orderBy("sort_rank", F.desc_nulls_last("sort_value"), "canonical_key")
    return page.select(F.row_number().over(order).cast("long").alias("place"), "canonical_key", "sort_rank", F.col("sort_value").cast("double").alias("sort_value"))


@query("select o_orderkey, concat_ws(',', case when o_orderkey % 3 = 0 then 'start' end, case when o_orderkey % 5 = 0 then 'end' end, case when o_orderkey % 7 = 0 then 'start_at' end) as missing from orders")
def missing_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which inputs of a formula are missing, by name."""
    k = F.col("o_orderkey")
    fields = {n: F.when(k % m != 0, 1) for n, m in (("start", 3), ("end", 5), ("start_at", 7))}
    return table(spark, sf_dir, "orders").select("o_orderkey", analytics.missing(fields).alias("missing"))


@query(
    """
with w as (select o_orderkey as k, case o_orderkey % 8 when 7 then 40 else 0 end as b0, case o_orderkey % 8 when 1 then -5 when 2 then 0 when 7 then 70 else 30 end as b1,
        case o_orderkey % 8 when 3 then -10 when 4 then 20 when 7 then 70 else 30 end as c0, case o_orderkey % 8 when 3 then 20 when 4 then 50 when 5 then 70 when 7 then 100 else 60 end as c1 from orders)
select k as o_orderkey, case when k % 8 = 6 then 'missing_signal' when b1 < b0 or c1 < c0 then 'reversed_time' when b1 = b0 or c1 = c0 then 'zero_denominator' when c0 < b0 then 'reversed_time'
    when c0 < b1 or b1 - b0 <> c1 - c0 then 'window_mismatch' when k % 3 = 0 then 'zero_denominator' else 'ok' end as status from w"""
)
def growth_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth between windows that overlap, run backwards, are empty or differ in length."""
    kind = F.col("o_orderkey") % 8

    def day(otherwise: int, **at: int) -> Column:
        number = F.lit(otherwise)
        for k, days in at.items():
            number = F.when(kind == int(k[1:]), days).otherwise(number)
        return F.timestamp_seconds(number * 86_400)

    b0 = F.when(kind != 6, day(0, k7=40))
    windows = (b0, day(30, k1=-5, k2=0, k7=70), day(30, k3=-10, k4=20, k7=70), day(60, k3=20, k4=50, k5=70, k7=100))
    status, _ = analytics.topic_growth(F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(2), F.lit(5), windows)
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@query(
    """
select case when p_partkey % 10 = 0 then 'topic_id' when p_partkey % 10 = 1 then 'topic_name' when p_partkey % 10 = 2 then 'generated_at' when p_partkey % 10 = 3 then 'share'
    when p_partkey % 10 = 4 then 'paper_id' when p_partkey % 10 = 5 then 'signal' when p_partkey % 10 = 6 then 'growth_window' else 'none' end as problem, count(*) as assessments from part group by 1"""
)
def assessment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with assessments, the first of all checks."""
    kind = F.col("p_partkey") % 10
    start, end = F.lit("2024-01-01").cast("timestamp"), F.when(~kind.isin(6, 7), F.lit("2024-02-01").cast("timestamp"))
    lacking = F.when(kind == 5, F.array(F.lit("mood"))).when(kind == 7, F.array(F.lit("growth_window"))).otherwise(F.array().cast("array<string>"))
    problem = analytics.assessment_problem(
        F.when(kind == 0, " t").otherwise("t"), F.when(kind == 1, "").otherwise("n"), F.when(kind != 2, start), [F.when(kind == 3, 1.5).otherwise(0.5)],
        F.array(F.lit("p"), F.when(kind != 4, "q")), lacking, start, end,
    )
    return table(spark, sf_dir, "part").groupBy(F.coalesce(problem, F.lit("none")).alias("problem")).agg(F.count("*").alias("assessments"))
