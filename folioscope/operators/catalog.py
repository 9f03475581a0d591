"""Reads of a published catalog: filters, order, keyset pages, facets, statistics."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
from dataclasses import asdict, dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import tristate as ts
from folioscope.operators import search, textindex
from folioscope.operators.ranking import placed_within

#: Fixed values.
PAPER_TYPES = ("research_article", "review", "preprint", "dataset", "benchmark")
LIFECYCLES = ("active", "withdrawn", "retracted", "rejected", "superseded")
SOURCES = ("crossref", "arxiv", "openreview", "s2", "pubmed", "pmc", "openalex", "springer_nature", "elsevier", "manual")
SORTS = ("published_at_desc", "citations_desc", "trend_desc", "relevance")
DEFAULT_LIMIT, MAX_LIMIT, MAX_TEXT, MAX_CURSOR = 20, 100, 300, 2048
#: Pairs of a task of a facet, about.
TASK_PAIRS = 500_000
SLUG = re.compile(r"^[a-z0-9]+(?:-[a-z0-9]+)*$")


class InvalidQuery(ValueError):
    """A parameter that isn't allowed."""


@dataclass(frozen=True)
class PaperQuery:
    """What to list. ``None`` doesn't filter."""

    q: str | None = None
    published_from: datetime | None = None
    published_to: datetime | None = None
    paper_type: str | None = None
    topic: str | None = None
    method: str | None = None
    source: str | None = None
    has_code: bool | None = None
    has_data: bool | None = None
    has_benchmark: bool | None = None
    lifecycle: str | None = None
    sort: str | None = None
    limit: int = DEFAULT_LIMIT

    def normalised(self) -> PaperQuery:
        """Checked, with blanks trimmed and a default order."""
        text = (self.q or "").strip() or None
        if text and len(text.encode()) > MAX_TEXT:
            raise InvalidQuery("q is too long")
        if self.published_from and self.published_to and self.published_from > self.published_to:
            raise InvalidQuery("published_from is after published_to")
        for name, allowed in (("paper_type", PAPER_TYPES), ("source", SOURCES), ("lifecycle", LIFECYCLES), ("sort", SORTS)):
            if getattr(self, name) is not None and getattr(self, name) not in allowed:
                raise InvalidQuery(f"{name} isn't one of {', '.join(allowed)}")
        for name in ("topic", "method"):
            if getattr(self, name) is not None and not SLUG.match(getattr(self, name)):
                raise InvalidQuery(f"{name} isn't a slug")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise InvalidQuery(f"limit isn't from 1 to {MAX_LIMIT}")
        order = self.sort or ("relevance" if text else "published_at_desc")
        if order == "relevance" and not text:
            raise InvalidQuery("relevance needs q")
        return replace(self, q=text, sort=order)

    @classmethod
    def from_parameters(cls, parameters: list[tuple[str, str]]) -> PaperQuery:
        """Of query-string pairs; unknown and repeated names are errors."""
        seen: dict[str, str] = {}
        for name, given in parameters:
            if name not in cls.__dataclass_fields__:
                raise InvalidQuery(f"unknown parameter {name}")
            if name in seen:
                raise InvalidQuery(f"repeated parameter {name}")
            seen[name] = given
        out: dict[str, object] = dict(seen)
        for name in ("has_code", "has_data", "has_benchmark"):
            if name in seen:
                if seen[name] not in ("true", "false"):
                    raise InvalidQuery(f"{name} isn't true or false")
                out[name] = seen[name] == "true"
        for name in ("published_from", "published_to"):
            if name in seen:
                try:
                    out[name] = datetime.fromisoformat(seen[name])
                except ValueError as e:
                    raise InvalidQuery(f"{name} isn't a time") from e
        if "limit" in seen:
            if not seen["limit"].isdigit():
                raise InvalidQuery("limit isn't a number")
            out["limit"] = int(seen["limit"])
        return cls(**out).normalised()

    def filter_hash(self) -> str:
        """Hash of all that decides which rows are listed in which order."""
        kept = {k: v.isoformat() if isinstance(v, datetime) else v for k, v in asdict(self).items() if k != "limit"}
        return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def filtered(papers: DataFrame, query: PaperQuery, index: textindex.Index | None = None) -> DataFrame:
    """Papers that meet all conditions; list, total and facets share this predicate.

    With a text query they get their ``relevance``: from an index, or from their texts, which
    is for small catalogs only.
    """
    conditions: list[Column] = []
    if query.q and index:
        papers = papers.join(index.search(query.q).withColumnRenamed("key", "canonical_key"), "canonical_key")
    elif query.q:
        papers = search.with_stems(papers, "search_text", "search_stems").withColumn("relevance", search.relevance(F.col("search_stems"), query.q))
        papers = papers.where(search.matches(F.col("search_stems"), query.q)).drop("search_stems")
    if query.published_from:
        conditions.append(ts.is_known("published_at") & (ts.value("published_at") >= F.lit(query.published_from)))
    if query.published_to:
        conditions.append(ts.is_known("published_at") & (ts.value("published_at") <= F.lit(query.published_to)))
    for name in ("paper_type", "has_code", "has_data", "has_benchmark"):
        if getattr(query, name) is not None:
            conditions.append(ts.equals(name, getattr(query, name)))
    for name, column in (("topic", "topic_slugs"), ("method", "method_slugs"), ("source", "source_names")):
        if getattr(query, name) is not None:
            conditions.append(F.array_contains(column, getattr(query, name)))
    if query.lifecycle:
        conditions.append(F.col("lifecycle_status") == query.lifecycle)
    for c in conditions:
        papers = papers.where(c)
    return papers


def order_columns(sort: str) -> tuple[Column, Column]:
    """State rank and value of an order; relevance has no state."""
    name = {"published_at_desc": "published_at", "citations_desc": "citation_count", "trend_desc": "trend_score"}.get(sort)
    if name is None:
        return F.lit(0), F.col("relevance")
    return ts.rank(ts.state(name)), F.when(ts.is_known(name), ts.value(name))


def ordered(papers: DataFrame, sort: str) -> DataFrame:
    """By state rank, value downwards (nulls last), key in bytewise order."""
    rank, value = order_columns(sort)
    return papers.withColumn("sort_rank", rank).withColumn("sort_value", value).orderBy(F.asc("sort_rank"), F.desc_nulls_last("sort_value"), F.asc("canonical_key"))


def after(sort: str, rank: int, value: object, key: str) -> Column:
    """Rows that follow (rank, value, key) in an order."""
    r, v = order_columns(sort)
    later = r > rank
    if value is None:
        return later | ((r == rank) & v.isNull() & (F.col("canonical_key") > key))
    return later | ((r == rank) & (v.isNull() | (v < F.lit(value)) | ((v == F.lit(value)) & (F.col("canonical_key") > key))))


def page(papers: DataFrame, query: PaperQuery, position: tuple[int, object, str] | None = None, index: textindex.Index | None = None) -> DataFrame:
    """One page and one row more, which tells that there are more."""
    rows = filtered(papers, query, index)
    if position:
        rows = rows.where(after(query.sort, *position))
    return ordered(rows, query.sort).limit(query.limit + 1)


def scalar_facet(papers: DataFrame, column: str, known_only: str | None = None) -> DataFrame:
    rows = papers.where(ts.is_known(known_only)) if known_only else papers
    return rows.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "key")


def array_facet(papers: DataFrame, column: str) -> DataFrame:
    rows = papers.select(F.explode(F.array_distinct(column)).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "key")


def facets(papers: DataFrame) -> dict[str, DataFrame]:
    """The five facets of papers that are already filtered."""
    return {
        "paper_type": scalar_facet(papers, "paper_type_value", "paper_type"),
        "lifecycle": scalar_facet(papers, "lifecycle_status"),
        "topics": array_facet(papers, "topic_slugs"),
        "methods": array_facet(papers, "method_slugs"),
        "sources": array_facet(papers, "source_names"),
    }


def pair_tasks(rows: DataFrame) -> int:
    """Tasks that pairs are dealt over, of ``TASK_PAIRS`` each, whatever number of them the session has for shuffles."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_PAIRS))


def pair_facet(pairs: DataFrame, papers: DataFrame, paper: str, key: str, tasks: int | None = None) -> DataFrame:
    """Papers of each key, from (paper, key) rows of the papers that a filter leaves.

    A task holds the pairs of its papers, so there are as many as ``pair_tasks`` tells of ``pairs``;
    a caller that knows of a cheaper count gives it.
    """
    tasks = tasks or pair_tasks(pairs)
    left = papers.select(paper).repartition(tasks, paper)
    kept = pairs.select(paper, key).repartition(tasks, paper).join(left, paper, "left_semi").distinct()
    return kept.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "key")


def taxonomy(pairs: DataFrame, paper: str, slug: str, name: str, description: str | None = None) -> DataFrame:
    """Papers of each taxon, and whether its rows disagree about its name or description.

    A description beside none is a disagreement.  Rows of a paper and taxon are merged first, so
    that no row is counted twice or expanded.
    """
    told = [F.min(name).alias("least"), F.max(name).alias("most")]
    conflict = F.min("least") != F.max("most")
    if description:
        told += [F.min(description).alias("least_told"), F.max(description).alias("most_told"), F.bool_or(F.col(description).isNull()).alias("untold")]
        differs = F.coalesce(F.min("least_told") != F.max("most_told"), F.lit(False))
        conflict = F.coalesce(conflict, F.lit(False)) | differs | (F.bool_or("untold") & F.max("most_told").isNotNull())
    each = pairs.groupBy(slug, paper).agg(*told)
    return each.groupBy(slug).agg(F.count("*").alias("paper_count"), F.min("least").alias("name"), conflict.alias("conflict"))


def taxon_papers(pairs: DataFrame, paper: str, slug: str, width: int = 10_000) -> DataFrame:
    """(slug, chunk, papers, paper_ids): the papers of each taxon in order, each once, in lists of at most ``width``.

    Lists are numbered from 0, and all but a taxon's last are full.  A hot taxon is sorted
    range by range, and never lies in one row or task.
    """
    once = pairs.select(slug, paper).where(F.col(slug).isNotNull() & F.col(paper).isNotNull()).distinct()
    numbered = placed_within(once, [slug], [paper], "place").withColumn("chunk", F.floor((F.col("place") - 1) / width))
    return numbered.groupBy(slug, "chunk").agg(F.count("*").alias("papers"), F.array_sort(F.collect_list(paper)).alias("paper_ids"))


def lookup(rows: DataFrame, key: str, wanted: object, pattern: re.Pattern[str] | None = None) -> DataFrame:
    """The row of a key, or none: a malformed key, a null one and an absent one look alike."""
    if wanted is None or (pattern and not pattern.match(str(wanted))):
        return rows.limit(0)
    return rows.where(F.col(key) == F.lit(wanted)).limit(1)


def rankable(status: Column, excluded: Column) -> Column:
    """Only active works that aren't excluded are ranked."""
    return F.coalesce((status == "active") & ~excluded, F.lit(False))


def statistics(papers: DataFrame, now: Column, topics: DataFrame | None = None, methods: DataFrame | None = None) -> DataFrame:
    """One row: totals, tri-state ratios and papers of the last seven days.

    ``topics`` and ``methods`` are rows with a ``slug``, of which each counts once.
    """
    taxa = {f"{name}_total": rows.select(F.count_distinct("slug")).scalar() for name, rows in (("topics", topics), ("methods", methods)) if rows is not None}
    recent = F.count_if(ts.is_known("published_at") & ts.value("published_at").between(now - F.expr("interval 7 days"), now))
    all_dated = F.coalesce(F.bool_and(ts.is_known("published_at")), F.lit(False))
    return papers.agg(
        F.count("*").alias("papers"),
        *ts.ratio("has_code"),
        *ts.ratio("has_data"),
        *(ts.ratio("has_benchmark") if "has_benchmark_state" in papers.columns else []),
        F.when(all_dated, ts.KNOWN).otherwise(ts.UNKNOWN).alias("recent_state"),
        F.when(all_dated, recent).alias("papers_last_7_days"),
    ).select("*", *(n.alias(name) for name, n in taxa.items()))


class CursorSigner:
    """Page positions as signed text, bound to a generation, resource, filter and order."""

    FIELDS = ("generation", "resource", "filters", "sort", "rank", "value", "key")

    def __init__(self, secret: bytes) -> None:
        if len(secret) < 32:
            raise ValueError("the secret has fewer than 32 bytes")
        self._secret = secret

    def encode(self, **fields: object) -> str:
        if set(fields) != set(self.FIELDS):
            raise InvalidQuery("a cursor has other fields")
        body = json.dumps(fields, sort_keys=True, separators=(",", ":"), default=str).encode()
        return f"{_b64(body)}.{_b64(hmac.new(self._secret, body, hashlib.sha256).digest())}"

    def decode(self, cursor: str, **bound: object) -> dict[str, object]:
        """The fields; an error if signature, form or any of ``bound`` differ."""
        if len(cursor) > MAX_CURSOR or cursor.count(".") != 1:
            raise InvalidQuery("malformed cursor")
        body, mark = (_unb64(x) for x in cursor.split("."))
        if not hmac.compare_digest(hmac.new(self._secret, body, hashlib.sha256).digest(), mark):
            raise InvalidQuery("the cursor's signature is wrong")
        fields = json.loads(body)
        if set(fields) != set(self.FIELDS) or any(fields[k] != v for k, v in bound.items()):
            raise InvalidQuery("the cursor belongs to another query")
        return fields


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _unb64(text: str) -> bytes:
    try:
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    except ValueError as e:
        raise InvalidQuery("malformed cursor") from e
    if _b64(raw) != text:
        raise InvalidQuery("the cursor's coding isn't canonical")
    return raw
