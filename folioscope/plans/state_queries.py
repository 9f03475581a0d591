"""Current state, deduplication, conflicts and identity, from event-like tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.operators import state
from folioscope.operators.components import connected_components, shared_checkpoint_dir
from folioscope.operators.ranking import best_before, placed_within
from folioscope.plans import roles
from folioscope.plans.registry import query
from folioscope.plans.roles import SOURCE_EVENTS, table
from folioscope.sources.keyed_log import KeyedLog
from folioscope.streaming.state_stream import follow

LATEST = """
latest as (
    select * from (select *, row_number() over (partition by event_key order by source_time desc, tie_break_key desc, position desc, event_id desc) as n from source_events)
    where n = 1)
"""


@query("select event_key, event_kind, tie_break_key, event_id, value from latest", SOURCE_EVENTS, LATEST)
def source_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event with the greatest ordering tuple of each key."""
    return state.latest_by(roles.source_events(spark, sf_dir), ["event_key"]).select("event_key", "event_kind", "tie_break_key", "event_id", "value")


@query(
    """
with ranked as (select event_key, event_id, source_time, tie_break_key, position,
        max(struct_pack(a := source_time, b := tie_break_key, c := position)) over (partition by event_key order by event_id rows between unbounded preceding and 1 preceding) as best from source_events)
select event_key, count(*) as events, count(*) filter (best is not null and struct_pack(a := source_time, b := tie_break_key, c := position) < best) as late
from ranked group by event_key""",
    SOURCE_EVENTS,
)
def late_event_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of a key arrived after one of a greater ordering tuple."""
    rank = F.struct("source_time", "tie_break_key", "position")
    events = roles.source_events(spark, sf_dir).select("event_key", "event_id", rank.alias("r"))
    seen = best_before(events, ["event_key"], "event_id", "r", 4096, "best")
    return seen.groupBy("event_key").agg(F.count("*").alias("events"), F.count_if(F.col("r") < F.col("best")).alias("late"))


@query("select event_kind, count(*) as keys, count(*) filter (event_kind <> 'delete') as visible from latest group by event_kind", SOURCE_EVENTS, LATEST)
def tombstone_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by the kind of their current event; tombstones aren't visible."""
    current = state.latest_by(roles.source_events(spark, sf_dir), ["event_key"])
    return current.groupBy("event_kind").agg(F.count("*").alias("keys"), F.count_if(F.col("event_kind") != "delete").alias("visible"))


@query("select tie_break_key, sha256(props) as content_hash, min(event_id) as event_id, count(*) as times_seen from source_events group by 1, 2", SOURCE_EVENTS)
def raw_event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each kind and content, with how often it was seen."""
    events = roles.source_events(spark, sf_dir).select("tie_break_key", F.sha2("props", 256).alias("content_hash"), "position", "event_id")
    return state.deduplicated(events, ["tie_break_key", "content_hash"]).select("tie_break_key", "content_hash", "event_id", "times_seen")


@query(
    """
with w as (select *, row_number() over (partition by cast(event_key as bigint) % 7 order by source_time desc, tie_break_key desc, position desc, event_id desc) as r
    from latest where event_kind <> 'delete' and value < 80)
select cast(event_key as bigint) % 7 as work_id, event_key, event_id from w where r = 1""",
    SOURCE_EVENTS,
    LATEST,
)
def winning_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning source of each work among those visible and included."""
    current = state.latest_by(roles.source_events(spark, sf_dir), ["event_key"])
    current = current.withColumn("work_id", F.col("event_key").cast("long") % 7).withColumn("included", F.col("value") < 80)
    return state.winners(current, "work_id").select("work_id", "event_key", "event_id")


@query(
    """
with w as (select distinct cast(event_key as bigint) % 7 as work_id from source_events),
    v as (select distinct cast(event_key as bigint) % 7 as work_id from latest where event_kind <> 'delete' and value > 95)
select work_id, v.work_id is not null as has_winner from w left join v using (work_id)""".replace("v.work_id is not null", "work_id in (select work_id from v)"),
    SOURCE_EVENTS,
    LATEST,
)
def winner_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works stay when no visible source of theirs remains; their winner is cleared."""
    events = roles.source_events(spark, sf_dir)
    works = events.select((F.col("event_key").cast("long") % 7).alias("work_id")).distinct()
    current = state.latest_by(events, ["event_key"]).withColumn("work_id", F.col("event_key").cast("long") % 7).withColumn("included", F.col("value") > 95)
    won = state.winners(current, "work_id").select("work_id", F.lit(True).alias("won"))
    return works.join(won, "work_id", "left").select("work_id", F.coalesce("won", F.lit(False)).alias("has_winner"))


@query(
    """
with s as (select *, case when tie_break_key <> 'error' then 'active' when event_id % 4 = 0 then 'withdrawn' when event_id % 4 = 1 then 'retracted' when event_id % 4 = 2 then 'rejected' else 'superseded' end as status from source_events)
select event_key, coalesce(arg_min(status, struct_pack(a := source_time, b := event_id)) filter (status <> 'active'), 'active') as status
from s group by event_key""",
    SOURCE_EVENTS,
)
def status_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A terminal status is never left again."""
    terminal = F.element_at(F.array(*(F.lit(s) for s in state.TERMINAL)), (F.col("event_id") % 4 + 1).cast("int"))
    events = roles.source_events(spark, sf_dir).withColumn("status", F.when(F.col("tie_break_key") == "error", terminal).otherwise("active"))
    return state.monotonic_status(events, "event_key")


@query(
    """
with s as (select event_key, source_time, event_id, case when tie_break_key <> 'error' then 'active' when event_id % 4 = 0 then 'withdrawn' when event_id % 4 = 1 then 'retracted' when event_id % 4 = 2 then 'rejected' else 'superseded' end as status from source_events),
    pairs as (select lag(status) over (partition by event_key order by source_time, event_id) as before, status as after from s)
select before, after, before = 'active' or before = after as allowed, count(*) as moves from pairs where before is not null group by 1, 2""",
    SOURCE_EVENTS,
)
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a status follows another one, and whether it may.

    Neighbours are joined by their places, so that no key's events are sorted in one task.
    """
    terminal = F.element_at(F.array(*(F.lit(s) for s in state.TERMINAL)), (F.col("event_id") % 4 + 1).cast("int"))
    events = roles.source_events(spark, sf_dir).select("event_key", "source_time", "event_id", F.when(F.col("tie_break_key") == "error", terminal).otherwise("active").alias("status"))
    numbered = placed_within(events, ["event_key"], ["source_time", "event_id"], "place")
    before = numbered.select("event_key", (F.col("place") + 1).alias("place"), F.col("status").alias("before"))
    pairs = numbered.select("event_key", "place", F.col("status").alias("after")).join(before, ["event_key", "place"])
    return pairs.groupBy("before", "after").agg(F.count("*").alias("moves")).withColumn("allowed", state.allowed_transition(F.col("before"), F.col("after")))


@query(
    """
with r as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events)
select user_id, event_type, value from r where n = 1"""
)
def latest_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest observation of each metric of each subject."""
    return state.latest_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], ("ts", "event_id")).select("user_id", "event_type", "value")


@query(
    """
with r as (select o_custkey, date_trunc('year', o_orderdate) as asserted, o_orderstatus as value, rank() over (partition by o_custkey order by date_trunc('year', o_orderdate) desc) as n from orders)
select o_custkey as work_id, strftime(max(asserted), '%Y-%m-%d') as asserted_at, min(value) as value, count(distinct value) > 1 as conflict from r where n = 1 group by 1"""
)
def latest_assertion_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest assertion of each work; several values at one time are a conflict."""
    assertions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("work_id"), F.date_trunc("year", "o_orderdate").alias("at"), F.col("o_orderstatus").alias("value"))
    last = state.latest_assertions(assertions, ["work_id"], "at", "value")
    return last.select("work_id", F.date_format("at", "yyyy-MM-dd").alias("asserted_at"), "value", "conflict")


@query("select doc_id, first_value(doc_id) over (partition by sha256(text) order by n_chars, doc_id) as survivor from documents")
def survivor_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest row of each identity, told to every row of it.

    Only the hash and the row's numbers are shuffled, not the texts.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("identity"))
    first = rows.groupBy("identity").agg(F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("survivor"))
    return rows.join(first, "identity").select("doc_id", "survivor")


@query(
    """
with r as (select l_orderkey, l_linenumber, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber) as duplicate_rank from lineitem)
select l_orderkey, l_linenumber, duplicate_rank from r where duplicate_rank > 1"""
)
def duplicate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the first of each compound key."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ranked = placed_within(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"], "duplicate_rank")
    return ranked.where("duplicate_rank > 1").select("l_orderkey", "l_linenumber", "duplicate_rank")


@query(
    """
with o as (select o_custkey, o_orderkey, o_orderdate, case when o_orderstatus <> 'O' then o_orderstatus end as status, case when o_totalprice > 100000 then o_orderpriority end as priority from orders)
select o_custkey as identity, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as survivor, count(*) as merged,
    (list(status order by o_orderdate, o_orderkey) filter (status is not null))[1] as status,
    (list(priority order by o_orderdate, o_orderkey) filter (priority is not null))[1] as priority
from o group by 1"""
)
def merge_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates merge into the earliest; its nulls are filled in order of age."""
    works = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("identity"), "o_orderdate", "o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("priority"))
    return state.merged_survivors(works, "identity", ["o_orderdate", "o_orderkey"], ["status", "priority"])


@query(
    """
select o_custkey as work_id, count(distinct o_orderpriority) filter (o_orderstatus = 'F') as priorities, min(o_totalprice) filter (o_orderstatus = 'O') as least_open
from orders group by 1 having count(distinct o_orderpriority) filter (o_orderstatus = 'F') > 1"""
)
def conflict_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose finished records disagree."""
    finished, pending = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    agg = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("work_id")).agg(F.count_distinct(F.when(finished, F.col("o_orderpriority"))).alias("priorities"), F.min(F.when(pending, F.col("o_totalprice"))).alias("least_open"))
    return agg.where("priorities > 1")


@query("select n_regionkey, string_agg(distinct n_name, '; ' order by n_name) as names from nation group by 1")
def ordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "; ").alias("names"))


@query(
    """
with ids as (select s_nationkey as venue, array_agg(distinct s_suppkey % 40 order by s_suppkey % 40) as found from supplier group by 1)
select venue, len(found) as identities, case when len(found) = 0 then 'insert' when len(found) = 1 then 'reuse' else 'conflict' end as resolution from ids"""
)
def venue_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No match inserts, one is reused, several are a conflict."""
    found = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("venue")).agg(F.size(F.collect_set(F.col("s_suppkey") % 40)).cast("long").alias("identities"))
    return found.withColumn("resolution", F.when(F.col("identities") == 0, "insert").when(F.col("identities") == 1, "reuse").otherwise("conflict"))


def _conflicts(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    kinds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), "o_orderpriority")
    agg = found.join(kinds, "node", "left").groupBy("component")
    return agg.agg(F.count_if(F.col("node") > 0).alias("records"), (F.count_distinct("o_orderpriority") > 1).alias("conflict"))


WHOLE_IDENTITIES = """
recursive edges as (select distinct l_orderkey as a, -l_partkey as b from lineitem where l_orderkey is not null and l_partkey is not null),
    both_ways as (select a, b from edges union select b, a from edges),
    comp(node, component) using key (node) as (
        select distinct a, a from both_ways union
        select e.b, min(c.component) from comp c join both_ways e on c.node = e.a join recurring.comp r on r.node = e.b where c.component < r.component group by e.b)"""


@query("select node, component from comp", WHOLE_IDENTITIES)
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and identifiers that hang together, named by their smallest member; every link counts."""
    return connected_components(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), (-F.col("l_partkey")).alias("b")))


@query(
    """
select component, count(*) filter (node > 0) as records, count(distinct o_orderpriority) > 1 as conflict
from comp left join orders on node = o_orderkey group by component""",
    WHOLE_IDENTITIES,
)
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components, the records in each, and whether those disagree in one scheme."""
    return _conflicts(spark, sf_dir, identity_components(spark, sf_dir))


@query(
    """
with stored as (select o_orderkey, o_orderstatus, o_totalprice from orders),
    replay as (select o_orderkey, case when o_orderkey % 97 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 89 <> 0 then o_totalprice end as o_totalprice from orders)
select s.o_orderkey from stored s join replay r using (o_orderkey) where (s.o_orderstatus, s.o_totalprice) is distinct from (r.o_orderstatus, r.o_totalprice)"""
)
def replay_differs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on which a replay isn't identical, nulls counting as equal."""
    stored = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    replay = stored.select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 89 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return state.replay_differences(stored, replay, ["o_orderkey"])


@query("select event_id, event_type from events e where not exists (select 1 from events f where f.event_id = e.event_id and f.ts < timestamp '2024-01-20')")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replayed batch adds to a ledger that has its first part."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return state.appended(events.where("ts < timestamp_ntz '2024-01-20'"), events.drop("ts"), ["event_id"])


@query(
    """
select count(*) as input, count(*) filter (event_type = 'purchase') as projected, count(*) filter (value > 99) as failed, count(*) filter (event_id % 10 = 0) as raw_events, count(distinct user_id) as normalized, count(*) filter (event_type = 'error') as deleted,
    count(*) filter (event_type not in ('purchase', 'error') and value > 50) as excluded, count(*) filter (event_type not in ('purchase', 'error') and value <= 50) as unchanged
from events"""
)
def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight counters of a job in one pass."""
    kind, value = F.col("event_type"), F.col("value")
    rest = ~kind.isin("purchase", "error")
    return table(spark, sf_dir, "events").agg(F.count("*").alias("input"), F.count_if(value > 99).alias("failed"), F.count_if(F.col("event_id") % 10 == 0).alias("raw_events"), F.count_distinct("user_id").alias("normalized"), F.count_if(kind == "purchase").alias("projected"), F.count_if(kind == "error").alias("deleted"), F.count_if(rest & (value > 50)).alias("excluded"), F.count_if(rest & (value <= 50)).alias("unchanged"))


@query("select distinct o_custkey from orders intersect select c_custkey from customer where c_acctbal > 5000")
def identity_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_custkey").intersect(rich)


@query("select o_custkey as work_id, list_has_any(list(o_orderpriority), ['1-URGENT', '2-HIGH']) as overlap from orders group by 1")
def identity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any of a work's values is among those asked for."""
    asked = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("work_id")).agg(F.arrays_overlap(F.collect_set("o_orderpriority"), asked).alias("overlap"))


@query(
    """
select s_suppkey as id, s_name as name, 'supplier' as source from supplier union all
select c_custkey, c_name, 'customer' from customer"""
)
def multi_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several sources in one table."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("source"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("source"))
    return suppliers.unionByName(customers, allowMissingColumns=True)


@query("select event_key, event_kind, tie_break_key, event_id, value from latest", SOURCE_EVENTS, LATEST)
def stream_state_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state as ``source_state_latest``, by a stream over the table's files."""
    folder = f"{shared_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path if _is_folder(spark, path) else f"{sf_dir}/events*.parquet")
    states = KeyedLog(spark, f"{folder}/state", ["event_key"])
    follow(roles.as_source_events(stream), states, f"{folder}/checkpoint")
    return states.read().select("event_key", "event_kind", "tie_break_key", "event_id", "value")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
