"""What a winning record says of its work: authors, topics, repositories, metrics, assertions.

A work's rows are replaced by those of its present winner, so each function gives all rows
of the works it is given, and a writer overwrites those works' rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import identifiers
from folioscope.functions.text import trim_space
from folioscope.functions.tristate import KNOWN, MISSING, UNKNOWN

#: Fields that assertions are made about: single values are known or missing, lists known or unknown.
FIELDS = ("title", "abstract", "published_at", "venue", "citation_count")
LISTS = ("authors", "topics", "code_urls")


def _named(v: Column) -> Column:
    return F.nullif(trim_space(v), F.lit(""))


def authors(works: DataFrame) -> DataFrame:
    """(work_id, position, name, orcid, corresponding) of ``authors``, in order.

    A collective's name stands where a person's is blank; nameless authors are left out but
    keep their place; an author without a position has that of the list.
    """
    rows = works.select("work_id", F.posexplode("authors").alias("place", "a"))
    name = F.coalesce(_named(F.col("a.name")), _named(F.col("a.collective")))
    position = F.when(F.col("a.position") > 0, F.col("a.position")).otherwise(F.col("place") + 1)
    return rows.select("work_id", position.alias("position"), name.alias("name"), _named(F.col("a.orcid")).alias("orcid"), F.coalesce("a.corresponding", F.lit(False)).alias("corresponding")).where("name is not null")


def author_entities(rows: DataFrame, order: str) -> DataFrame:
    """One row of each ORCID, with the name that came last."""
    return rows.where("orcid is not null").groupBy("orcid").agg(F.max_by("name", order).alias("name"), F.count("*").alias("works"))


def topics(works: DataFrame) -> DataFrame:
    """(work_id, name, confidence) of ``topics``; without a score, confidence is 1."""
    rows = works.select("work_id", F.explode("topics").alias("t"))
    return rows.select("work_id", _named(F.col("t.name")).alias("name"), F.coalesce("t.score", F.lit(1.0)).alias("confidence")).where("name is not null")


def repositories(works: DataFrame) -> DataFrame:
    """(work_id, repository): the canonical code repositories among ``code_urls``."""
    return works.select("work_id", F.explode("code_urls").alias("url")).select("work_id", identifiers.github_repository(F.col("url")).alias("repository")).where("repository is not null").distinct()


def citation_metrics(works: DataFrame, stored: DataFrame) -> DataFrame:
    """(work_id, source, observed_at, value) of citation counts that aren't stored for that time."""
    found = works.where("citation_count >= 0").select("work_id", "source", "observed_at", F.col("citation_count").alias("value"))
    keys = ["work_id", "source", "observed_at"]
    return found.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def assertions(works: DataFrame) -> DataFrame:
    """(work_id, field, state, value) of all eight fields; values are JSON."""

    def there(v: Column, kind: str) -> Column:
        return v.isNotNull() & (v != "") if kind == "string" else v.isNotNull()

    types = dict(works.dtypes)
    shown = lambda f: F.get_json_object(F.to_json(F.struct(F.col(f).alias("v"))), "$.v")
    told = [(f, there(F.col(f), types[f]), MISSING) for f in FIELDS] + [(f, F.col(f).isNotNull(), UNKNOWN) for f in LISTS]
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.when(k, KNOWN).otherwise(absent).alias("state"), F.when(k, shown(f)).alias("value")) for f, k, absent in told))
    return works.select("work_id", F.inline(rows))
