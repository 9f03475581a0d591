"""Publication: source records become events, works, and one wide row per paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import identifiers, text, tristate
from folioscope.operators import state
from folioscope.operators.components import checkpointed, connected_components


RECORD = ("doi", "identifiers", "title", "published", "authors", "issns", "urls", "retracted", "record_id", "abstract", "work_type", "topics", "citations", "licenses", "venue", "relations", "raw_hash")
_NO_TIME = "1970-01-01"


def events_of(records: DataFrame) -> DataFrame:
    """Upsert events of source records, with their ordering tuple.

    Of records of one time, the one later in numbered files wins; elsewhere the greater hash.
    """
    return records.where("record_id is not null").select(
        "source",
        F.concat_ws(":", "source", "record_id").alias("event_key"),
        F.lit("upsert").alias("event_kind"),
        F.coalesce("updated_at", F.lit(_NO_TIME).cast("timestamp")).alias("source_time"),
        F.coalesce("order_key", "raw_hash").alias("tie_break_key"),
        F.lit(1).cast("long").alias("position"),
        F.xxhash64("raw_hash", "source", "record_id", "order_key").alias("event_id"),
        F.struct(*RECORD).alias("record"),
    )


def deletions_of(deletions: DataFrame, like: DataFrame) -> DataFrame:
    """Tombstones of (source, record_id, deleted_at, order_key), of the schema of the events ``like``."""
    return deletions.where("record_id is not null").select(
        "source",
        F.concat_ws(":", "source", "record_id").alias("event_key"),
        F.lit("delete").alias("event_kind"),
        F.coalesce("deleted_at", F.lit(_NO_TIME).cast("timestamp")).alias("source_time"),
        F.col("order_key").alias("tie_break_key"),
        F.lit(1).cast("long").alias("position"),
        F.xxhash64(F.lit("delete"), "source", "record_id", "order_key").alias("event_id"),
        F.lit(None).cast(like.schema["record"].dataType).alias("record"),
    )


def current_records(events: DataFrame) -> DataFrame:
    """The latest record of each key that no later tombstone has taken back."""
    return state.visible(state.latest_by(events, ["event_key"]))


def works(records: DataFrame) -> DataFrame:
    """Records with the work they belong to: those that share an identifier of any scheme hang together.

    A work is named by the smallest event key among its records.  Each identifier links its
    records to the smallest of them: links are told by values, not by hashes of them.
    Records are written once, so that their files aren't parsed again for each use.
    """
    records = checkpointed(records)
    held = records.select(F.col("event_key").alias("a"), F.explode("record.identifiers").alias("i"))
    least = held.groupBy("i").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    found = connected_components(held.join(least, "i").where("a <> b"))
    return checkpointed(records.join(found, F.col("event_key") == F.col("node"), "left").withColumn("work_id", F.coalesce("component", "event_key")).drop("component", "node"))


#: Relations by which a record says that another one is retracted.
RETRACTIONS = ("retraction", "retractionof")


def retracted_works(resolved: DataFrame) -> DataFrame:
    """(work_id): works that a record of whatever source names as retracted."""
    said = resolved.select(F.explode("record.relations").alias("r")).where(F.lower("r.type").isin(*RETRACTIONS) & F.col("r.target").isNotNull())
    targets = said.select(F.struct(F.col("r.scheme").alias("scheme"), F.col("r.target").alias("value")).alias("i")).distinct()
    return resolved.select("work_id", F.explode("record.identifiers").alias("i")).join(targets, "i", "left_semi").select("work_id").distinct()


def papers(resolved: DataFrame) -> DataFrame:
    """One wide row per work: the winner's fields, all sources, and whether they disagree in a scheme."""
    winner = F.max_by(F.struct("record", "event_key"), F.struct(*state.ORDER)).alias("w")
    sources = F.array_sort(F.collect_set("source")).alias("source_names")
    provenance = F.array_sort(F.collect_set(F.struct("source", "record.record_id", "record.raw_hash"))).alias("source_provenance")
    doi = F.min("record.doi").alias("doi")
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_set("record.identifiers")))).alias("found")
    grouped = resolved.groupBy("work_id").agg(winner, sources, provenance, doi, F.bool_or("record.retracted").alias("retracted"), found)
    named = retracted_works(resolved).withColumn("named", F.lit(True))
    grouped = grouped.join(named, "work_id", "left").withColumn("retracted", F.col("retracted") | F.coalesce("named", F.lit(False))).drop("named")
    values = lambda scheme: F.transform(F.filter("found", lambda x: x["scheme"] == scheme), lambda x: x["value"])
    grouped = grouped.withColumn("identity", identifiers.canonical_identity({s: values(s) for s in identifiers.SCHEMES})).withColumn("conflict", F.size("found") > F.size(F.array_distinct("found.scheme")))
    record = F.col("w.record")
    at = record["published"]["at"]
    state_of, value_of = tristate.known(at)
    code = F.size(record["urls"]) > 0
    return grouped.select(
        F.coalesce(F.concat("identity.scheme", F.lit(":"), "identity.value"), F.col("w.event_key")).alias("canonical_key"),
        record["title"].alias("title"),
        state_of.alias("published_at_state"),
        value_of.alias("published_at_value"),
        F.when(record["urls"].isNull(), "unknown").otherwise("known").alias("has_code_state"),
        code.alias("has_code_value"),
        F.when(F.col("retracted"), "retracted").otherwise("active").alias("lifecycle_status"),
        *(x for n, v in (("abstract", record["abstract"]), ("paper_type", paper_type(record["work_type"])), ("citation_count", record["citations"])) for x in _known(n, v)),
        # no source tells of data, benchmarks or trends; formulas and curators do
        *(x for n, kind, absent in (("has_data", "boolean", "unknown"), ("has_benchmark", "boolean", "unknown"), ("trend_score", "double", "missing"), ("curation", "string", "missing")) for x in _known(n, F.lit(None).cast(kind), absent)),
        _slugs(record["topics"]).alias("topic_slugs"),
        F.array().cast("array<string>").alias("method_slugs"),
        record["authors"].alias("authors"),
        record["licenses"].alias("licenses"),
        record["venue"].alias("venue"),
        "source_provenance",
        "source_names",
        "conflict",
        text.search_text(record["title"], F.coalesce("doi", F.lit("")), record["abstract"], F.array_join(author_names(record["authors"]), " ")).alias("search_text"),
    )


def author_names(authors: Column) -> Column:
    """Names in order; a collective's where there is no person's."""
    return F.filter(F.transform(authors, lambda a: F.coalesce(F.nullif(a["name"], F.lit("")), F.nullif(a["collective"], F.lit("")))), lambda n: n.isNotNull())


#: Kinds of works of sources in the catalog's terms.
PAPER_TYPES = {"article": "research_article", "journal-article": "research_article", "proceedings-article": "research_article", "review": "review", "preprint": "preprint", "posted-content": "preprint", "dataset": "dataset"}


def paper_type(kind: Column) -> Column:
    """The catalog's type of a source's kind of work, or null."""
    return F.create_map(*(F.lit(x) for pair in PAPER_TYPES.items() for x in pair))[kind]


def _known(name: str, v: Column, absent: str = tristate.MISSING) -> tuple[Column, Column]:
    state_of, value_of = tristate.known(v, absent)
    return state_of.alias(f"{name}_state"), value_of.alias(f"{name}_value")


def _slugs(topics: Column) -> Column:
    """Slugs of named topics, sorted, each once, none empty."""
    found = F.transform(F.coalesce(topics, F.array().cast("array<struct<id:string,name:string,score:double>>")), lambda t: text.slug(t["name"]))
    return F.array_sort(F.array_distinct(F.filter(found, lambda s: F.coalesce(s != "", F.lit(False)))))


#: Fields of papers that are known, unknown or missing.
FIELDS = ("published_at", "has_code", "abstract", "paper_type", "citation_count", "has_data", "has_benchmark", "trend_score", "curation")


def broken() -> dict[str, Column]:
    """Rules that a catalog's papers must not violate to be published."""
    states = (tristate.KNOWN, tristate.UNKNOWN, tristate.MISSING)
    invalid, without, beside = F.lit(False), F.lit(False), F.lit(False)
    for name in FIELDS:
        state_of, value = F.col(f"{name}_state"), F.col(f"{name}_value")
        invalid = invalid | state_of.isNull() | ~state_of.isin(*states)
        without = without | (state_of.eqNullSafe(tristate.KNOWN) & value.isNull())
        beside = beside | (F.coalesce(state_of.isin(tristate.UNKNOWN, tristate.MISSING), F.lit(False)) & value.isNotNull())
    incomplete = F.exists("source_provenance", lambda p: p["source"].isNull() | p["record_id"].isNull() | p["raw_hash"].isNull())
    return {
        "state is invalid": invalid,
        "known without a value": without,
        "a value that isn't known": beside,
        "no provenance": F.coalesce(F.size("source_provenance"), F.lit(0)) < 1,
        "provenance is incomplete": F.coalesce(incomplete, F.lit(False)),
        "no title": F.coalesce(F.trim("title"), F.lit("")) == "",
        "lifecycle is invalid": F.col("lifecycle_status").isNull() | ~F.col("lifecycle_status").isin(*state.STATUSES),
    }


def one_of_a_kind() -> dict[str, Column]:
    """Values that papers must not share: the slugs of their keys."""
    return {"slug is shared": text.slug(F.col("canonical_key"))}
