"""Source records from files: works in JSON, articles in XML, metrics in CSV.

Every reader has an explicit schema and gives rows of one shape:
source, record_id, doi, identifiers, title, published, authors, issns, urls, retracted, updated_at,
abstract, work_type, topics, citations, licenses, venue, relations, order_key, raw, raw_hash.
Identifiers are (scheme, value), in every controlled scheme; authors are objects in their order;
relations say what a record does to others; ``order_key`` tells the place of a record in numbered
files.  What a source doesn't tell is null.
Network access is left to whoever brings the files; a page of an interface is a file here.  A page
that is cut short, and an item without an id or of another form, is an error that names the page
and the item; ``on_error="skip"`` leaves such items out, and ``malformed`` lists them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import documents, identifiers, text
from folioscope.operators import venues

OPENALEX_WORK = (
    "id string, doi string, title string, display_name string, publication_date string, created_date string, updated_date string, "
    "abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,is_corresponding:boolean,"
    "institutions:array<struct<id:string,display_name:string,ror:string>>>>, topics array<struct<id:string,display_name:string,score:double>>, "
    "cited_by_count int, is_retracted boolean, ids struct<openalex:string,doi:string,arxiv:string,pmid:string,pmcid:string>, "
    "type string, primary_location struct<license:string,license_id:string,source:struct<display_name:string,type:string,issn:array<string>>>, best_oa_location struct<license:string,license_id:string>, "
    "locations array<struct<landing_page_url:string,pdf_url:string,license:string,license_id:string>>"
)
CROSSREF_ITEM = (
    "DOI string, type string, title array<string>, author array<struct<given:string,family:string,name:string,ORCID:string,affiliation:array<struct<name:string>>>>, "
    "`container-title` array<string>, ISSN array<string>, published struct<`date-parts`:array<array<int>>>, "
    "`is-referenced-by-count` long, license array<struct<URL:string>>, indexed struct<`date-time`:string>, abstract string, `update-to` array<struct<DOI:string,type:string,label:string>>"
)
_DATE = "struct<Year:string,Month:string,Day:string>"
PUBMED_ARTICLE = (
    f"MedlineCitation struct<PMID:string, DateCompleted:{_DATE}, DateRevised:{_DATE}, Article:struct<ArticleTitle:string, Abstract:struct<AbstractText:array<string>>, Journal:struct<Title:string, ISSN:string, JournalIssue:struct<PubDate:struct<Year:string,Month:string,Day:string,Season:string,MedlineDate:string>>>,"
    "ArticleDate:array<struct<_DateType:string,Year:string,Month:string,Day:string>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,CollectiveName:string,Identifier:array<struct<_Source:string,_VALUE:string>>,AffiliationInfo:array<struct<Affiliation:string>>>>>, PublicationTypeList:struct<PublicationType:array<string>>>,"
    "CommentsCorrectionsList:struct<CommentsCorrections:array<struct<_RefType:string,RefSource:string,PMID:string>>>>, "
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
)
#: What a record does to another one, told by an identifier of a scheme.
RELATIONS = "array<struct<type:string,scheme:string,target:string,note:string>>"
METRICS = "title string, issn_l string, issn string, eissn string, metric_year int, category string, jif decimal(38,6), quartile string, status string, source string"


def _shape(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    absent = {"topics": "array<struct<id:string,name:string,score:double>>", "licenses": "array<struct<name:string,id:string,path:string>>", "citations": "long", "venue": "struct<kind:string,name:string>", "abstract": "string", "work_type": "string", "relations": RELATIONS, "order_key": "string"}
    columns = {**{n: F.lit(None).cast(kind) for n, kind in absent.items()}, **columns}
    names = ("record_id", "doi", "identifiers", "title", "published", "authors", "issns", "urls", "retracted", "updated_at", *absent)
    return rows.select(F.lit(source).alias("source"), *(columns[n].alias(n) for n in names), F.col("raw"), F.sha2("raw", 256).alias("raw_hash"))


def _identifiers(**found: Column) -> Column:
    """array of struct(scheme, value) of arrays of normalised values by scheme, without null ones."""

    def pairs(scheme: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(scheme).alias("scheme"), x.alias("value")))

    return F.array_distinct(F.filter(F.concat(*(pairs(s, v) for s, v in found.items())), lambda x: x["value"].isNotNull()))


def _items(spark: SparkSession, path: str, schema: str, wrong: Column, name: str = "file_name") -> DataFrame:
    """(file, item, raw, r, problem) for each element of each page's array of works, by its number in the page.

    ``wrong`` tells what is the matter with a work ``r``, or null.  A page without an array is
    one row whose item is 0.
    """
    pages = spark.read.text(path, wholetext=True).select("value", F.col(f"_metadata.{name}").alias("file"))
    form = "results array<string>, message struct<items:array<string>>, _corrupt_record string"
    page = pages.withColumn("p", F.from_json("value", form, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    found = F.when(F.col("p._corrupt_record").isNull(), F.coalesce("p.results", "p.message.items"))
    items = F.transform(found, lambda raw, i: F.struct((i + 1).alias("item"), raw.alias("raw")))
    rows = page.select("file", F.explode(F.coalesce(items, F.array(F.struct(F.lit(0).alias("item"), F.lit(None).cast("string").alias("raw"))))).alias("i")).select("file", "i.*")
    rows = rows.withColumn("r", F.from_json("raw", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    form_of = F.when(F.col("item") == 0, "page").when(F.col("raw").isNull() | F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "form")
    return rows.withColumn("problem", F.coalesce(form_of, wrong))


def _sound(items: DataFrame, on_error: str) -> DataFrame:
    """(raw, r) of items without a problem; one with a problem is an error, or left out."""
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is fail or skip")
    sound = F.col("problem").isNull()
    if on_error == "fail":
        message = F.format_string("malformed %s, item %d: %s", "file", "item", "problem")
        sound = F.when(sound, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return items.where(sound).select("raw", "r")


def _openalex_items(spark: SparkSession, path: str, name: str = "file_name") -> DataFrame:
    score = F.exists("r.topics", lambda t: ~text.in_range(t["score"]))
    return _items(spark, path, OPENALEX_WORK, F.when(identifiers.openalex_work(F.col("r.id")).isNull(), "id").when(score, "topic_score"), name)


def _crossref_items(spark: SparkSession, path: str, name: str = "file_name") -> DataFrame:
    target = F.exists("r.update-to", lambda u: identifiers.doi(u["DOI"]).isNull())
    return _items(spark, path, CROSSREF_ITEM, F.when(identifiers.doi(F.col("r.DOI")).isNull(), "id").when(target, "update_to"), name)


def malformed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(file, item, problem) of what ``openalex`` or ``crossref`` would stop at; item 0 is a whole page.

    Abstracts that aren't well-formed are listed too (``abstract: ..``); readers give null for them.
    """
    items = {"openalex": _openalex_items, "crossref": _crossref_items}[source](spark, path)
    if source == "crossref":
        items = items.withColumn("problem", F.coalesce("problem", F.concat(F.lit("abstract: "), documents.marked_text(F.col("r.abstract"))["problem"])))
    return items.where("problem is not null").select("file", "item", "problem")


def _authors(rows: Column, name, orcid, corresponding, institutions) -> Column:
    """Objects (name, collective, orcid, position, corresponding, institutions) of a source's authors, nameless ones too."""
    no_one = "array<struct<name:string,collective:string,orcid:string,position:int,corresponding:boolean,institutions:array<string>>>"
    one = lambda a, i: F.struct(
        name(a)[0].alias("name"), name(a)[1].alias("collective"), identifiers.orcid(orcid(a)).alias("orcid"), (i + 1).alias("position"), corresponding(a).alias("corresponding"), institutions(a).alias("institutions")
    )
    return F.transform(rows, one).cast(no_one)


def openalex(spark: SparkSession, path: str, on_error: str = "fail", items: DataFrame | None = None) -> DataFrame:
    """Works of pages of an interface, stored as JSON files, or of ``items`` of such (see ``page_chains``)."""
    rows = _sound(_openalex_items(spark, path), on_error) if items is None else items.select("raw", "r")
    links = F.flatten(F.transform("r.locations", lambda x: F.array(x["landing_page_url"], x["pdf_url"])))
    code = F.array_distinct(F.filter(F.transform(links, identifiers.github_repository), lambda x: x.isNotNull()))
    return _shape(
        rows,
        "openalex",
        record_id=identifiers.openalex_work(F.col("r.id")),
        doi=identifiers.doi(F.coalesce("r.doi", "r.ids.doi")),
        identifiers=_identifiers(
            doi=F.array(identifiers.doi(F.col("r.doi")), identifiers.doi(F.col("r.ids.doi"))),
            arxiv=F.array(identifiers.arxiv(F.col("r.ids.arxiv"))),
            openalex=F.array(identifiers.openalex_work(F.col("r.id")), identifiers.openalex_work(F.col("r.ids.openalex"))),
            pmid=F.array(identifiers.pmid(F.col("r.ids.pmid"))),
            pmcid=F.array(identifiers.pmcid(F.col("r.ids.pmcid"))),
        ),
        title=text.collapse_space(F.coalesce("r.title", "r.display_name")),
        published=text.partial_date(*(F.try_to_number(F.substring("r.publication_date", a, n), F.lit("9" * n)).cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))),
        authors=_authors(
            F.col("r.authorships"),
            lambda a: (text.collapse_space(a["author"]["display_name"]), F.lit(None).cast("string")),
            lambda a: a["author"]["orcid"],
            lambda a: F.coalesce(a["is_corresponding"], F.lit(False)),
            lambda a: F.filter(F.transform(a["institutions"], lambda i: i["display_name"]), lambda n: n.isNotNull()),
        ),
        issns=F.coalesce(F.array_distinct(F.filter(F.transform("r.primary_location.source.issn", identifiers.issn), lambda x: x.isNotNull())), F.array().cast("array<string>")),
        urls=code,
        abstract=text.inverted_index_text(F.col("r.abstract_inverted_index")),
        work_type=F.col("r.type"),
        topics=F.transform("r.topics", lambda t: F.struct(identifiers.openalex_entity(t["id"], "T").alias("id"), t["display_name"].alias("name"), t["score"].alias("score"))),
        citations=F.col("r.cited_by_count").cast("long"),
        licenses=text.licenses([("$.primary_location", F.col("r.primary_location")), ("$.best_oa_location", F.col("r.best_oa_location"))], [("$.locations", F.col("r.locations"))]),
        venue=F.when(F.col("r.primary_location.source").isNotNull(), F.struct(venues.venue_type(F.col("r.primary_location.source.type")).alias("kind"), F.col("r.primary_location.source.display_name").alias("name"))),
        retracted=F.coalesce("r.is_retracted", F.lit(False)),
        updated_at=F.coalesce(*(F.try_to_timestamp(F.col(c)) for c in ("r.updated_date", "r.created_date", "r.publication_date"))),
    )


def crossref(spark: SparkSession, path: str, on_error: str = "fail", items: DataFrame | None = None) -> DataFrame:
    """Items of work lists, stored as JSON files, or ``items`` of such (see ``page_chains``).

    ``update-to`` stands on a notice and names the work that it updates: it is kept as a
    relation, and says nothing of the notice itself.
    """
    rows = _sound(_crossref_items(spark, path), on_error) if items is None else items.select("raw", "r")
    parts = F.get("r.published.date-parts", F.lit(0))
    return _shape(
        rows,
        "crossref",
        record_id=identifiers.doi(F.col("r.DOI")),
        doi=identifiers.doi(F.col("r.DOI")),
        identifiers=_identifiers(doi=F.array(identifiers.doi(F.col("r.DOI")))),
        title=text.collapse_space(F.get("r.title", F.lit(0))),
        published=text.partial_date(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))),
        authors=_authors(
            F.col("r.author"),
            lambda a: (text.person_name(a["given"], a["family"], F.lit(None).cast("string")), text.collapse_space(a["name"])),
            lambda a: a["ORCID"],
            lambda a: F.lit(False),
            lambda a: F.filter(F.transform(a["affiliation"], lambda i: i["name"]), lambda n: n.isNotNull()),
        ),
        issns=F.array_distinct(F.filter(F.transform("r.ISSN", identifiers.issn), lambda x: x.isNotNull())),
        urls=F.array().cast("array<string>"),
        abstract=documents.marked_text(F.col("r.abstract"))["text"],
        work_type=F.col("r.type"),
        citations=F.col("r.is-referenced-by-count"),
        licenses=F.transform("r.license", lambda x, i: F.struct(F.lit("").alias("name"), x["URL"].alias("id"), F.concat(F.lit("$.license["), i.cast("string"), F.lit("]")).alias("path"))),
        venue=F.when(F.size("r.container-title") > 0, F.struct(venues.type_of_work(F.col("r.type")).alias("kind"), F.get("r.container-title", F.lit(0)).alias("name"))),
        retracted=F.lit(False),
        relations=F.transform("r.update-to", lambda u: F.struct(text.collapse_space(u["type"]).alias("type"), F.lit("doi").alias("scheme"), identifiers.doi(u["DOI"]).alias("target"), text.collapse_space(u["label"]).alias("note"))),
        updated_at=F.try_to_timestamp(F.col("r.indexed.date-time")),
    )


def pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Articles of XML files, gzipped or not; ``raw`` is the article's own text, which its hash is of.

    An article's time is that of its revision, else of its electronic or its journal's
    publication; ``order_key`` tells which of two articles of one time came later in the files.
    """
    events = pubmed_events(spark, path).where("kind = 'upsert'")
    rows = events.select("raw", "order_key", F.from_xml("raw", PUBMED_ARTICLE).alias("r")).select("raw", "order_key", F.col("r.MedlineCitation").alias("m"), F.col("r.PubmedData").alias("d"))
    date = F.col("m.Article.Journal.JournalIssue.PubDate")
    digits = lambda c: F.when(c.rlike("^[0-9]{1,4}$"), c.cast("int"))
    found = F.filter("d.ArticleIdList.ArticleId", lambda x: x["_IdType"] == "doi")
    values = lambda kind, norm: F.transform(F.filter("d.ArticleIdList.ArticleId", lambda x: x["_IdType"] == kind), lambda x: norm(x["_VALUE"]))
    digital = F.get(F.filter("m.Article.ArticleDate", lambda x: F.lower(x["_DateType"]) == "electronic"), F.lit(0))
    corrections = F.col("m.CommentsCorrectionsList.CommentsCorrections")
    retracted = F.array_contains("m.Article.PublicationTypeList.PublicationType", "Retracted Publication") | F.coalesce(F.exists(corrections, lambda c: F.lower(c["_RefType"]) == "retractionin"), F.lit(False))
    year = F.coalesce(digits(date["Year"]), digits(F.regexp_extract(date["MedlineDate"], "([0-9]{4})", 1)))
    published = text.partial_date(year, text.month_number(date["Month"]), digits(date["Day"]))
    return _shape(
        rows,
        "pubmed",
        record_id=identifiers.pmid(F.col("m.PMID")),
        doi=identifiers.doi(F.get(found, F.lit(0))["_VALUE"]),
        identifiers=F.array_union(
            _identifiers(doi=values("doi", identifiers.doi), pmid=values("pubmed", identifiers.pmid), pmcid=values("pmc", identifiers.pmcid)),
            _identifiers(pmid=F.array(identifiers.pmid(F.col("m.PMID")))),
        ),
        title=text.collapse_space(F.col("m.Article.ArticleTitle")),
        published=published,
        authors=_authors(
            F.col("m.Article.AuthorList.Author"),
            lambda a: (text.person_name(a["ForeName"], a["LastName"], F.lit(None).cast("string")), text.collapse_space(a["CollectiveName"])),
            lambda a: F.get(F.filter(a["Identifier"], lambda i: F.upper(i["_Source"]) == "ORCID"), F.lit(0))["_VALUE"],
            lambda a: F.lit(False),
            lambda a: F.filter(F.transform(a["AffiliationInfo"], lambda i: i["Affiliation"]), lambda n: n.isNotNull()),
        ),
        issns=F.array_compact(F.array(identifiers.issn(F.col("m.Article.Journal.ISSN")))),
        urls=F.array().cast("array<string>"),
        abstract=F.nullif(text.collapse_space(F.array_join("m.Article.Abstract.AbstractText", " ")), F.lit("")),
        venue=F.when(F.col("m.Article.Journal.Title").isNotNull(), F.struct(F.lit("journal").alias("kind"), F.col("m.Article.Journal.Title").alias("name"))),
        retracted=F.coalesce(retracted, F.lit(False)),
        relations=F.transform(corrections, lambda c: F.struct(text.trim_space(c["_RefType"]).alias("type"), F.lit("pmid").alias("scheme"), identifiers.pmid(c["PMID"]).alias("target"), text.collapse_space(c["RefSource"]).alias("note"))),
        order_key=F.col("order_key"),
        updated_at=text.revision_time(F.lit(None).cast("timestamp"), _day(F.col("m.DateRevised")), F.lit(None).cast("timestamp"), _day(digital), published["at"]),
    )


def _day(date: Column) -> Column:
    """The time of a date of an article, where it is whole."""
    blank = F.lit(None).cast("string")
    return text.bibliographic_date(date["Year"], date["Month"], date["Day"], blank, blank)["at"]


def pubmed_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, sequence, position, order_key, kind, record_id, raw) of bulk files, in one scan.

    Files are cut after each article, so no file is held whole; position orders the events
    of a file as they stand in it.  What follows an article may take ids back, one event each.
    ``sequence`` is the number in the file's name, or in that of a folder of its parts, or null;
    ``order_key`` is a text that orders the events of all files.
    """
    end = "</PubmedArticle>"
    pieces = spark.read.option("lineSep", end).text(path)
    pieces = pieces.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"))
    start = r"(?s)<PubmedArticle[\s>].*"
    article = F.concat(F.nullif(F.regexp_extract("value", start, 0), F.lit("")), F.lit(end))
    upsert = F.struct(F.lit("upsert").alias("kind"), F.regexp_extract(article, r"<PMID[^>]*>\s*([0-9]+)\s*</PMID>", 1).alias("record_id"), article.alias("raw"))
    lists = F.regexp_extract_all("value", F.lit(r"(?s)<DeleteCitation[\s>].*?</DeleteCitation>"), F.lit(0))
    ids = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"<PMID[^>]*>\s*([0-9]+)\s*</PMID>"), F.lit(1))))
    deletes = F.transform(ids, lambda i: F.struct(F.lit("delete").alias("kind"), i.alias("record_id"), F.lit(None).cast("string").alias("raw")))
    events = pieces.select("file", "path", "place", F.posexplode(F.concat(deletes, F.when(article.isNotNull(), F.array(upsert)).otherwise(F.array().cast("array<struct<kind:string,record_id:string,raw:string>>")))).alias("turn", "e"))
    number = F.regexp_extract("path", r"n([0-9]{4})\.xml(?:\.gz)?(?:/[^/]*)?$", 1)
    sequence = F.when(number != "", number.cast("int"))
    order = F.format_string("%08d/%s/%015d/%019d/%06d", F.coalesce(sequence, F.lit(0)), "file", "place.block", "place.at", "turn")
    return events.select("file", sequence.alias("sequence"), F.struct("place.block", "place.at", "turn").alias("position"), order.alias("order_key"), "e.*")


def pubmed_deletions(spark: SparkSession, path: str) -> DataFrame:
    """(source, record_id, deleted_at, order_key): ids that bulk files take back.

    A deletion has no date; it counts from the latest revision in its file and those before it,
    by their numbers, so that it comes after what the files had told of the article.  Each date of
    a file is read once.
    """
    events = pubmed_events(spark, path)
    dated = events.where("kind = 'upsert'").select(F.coalesce("sequence", F.lit(0)).alias("sequence"), F.from_xml("raw", f"MedlineCitation struct<DateRevised:{_DATE}>")["MedlineCitation"]["DateRevised"].alias("d")).distinct()
    gone = events.where("kind = 'delete'").withColumn("sequence", F.coalesce("sequence", F.lit(0)))
    times = dated.groupBy("sequence").agg(F.max(_day(F.col("d"))).alias("t")).unionByName(gone.select("sequence", F.lit(None).cast("timestamp").alias("t"))).groupBy("sequence").agg(F.max("t").alias("t"))
    # one row for each file
    latest = F.max("t").over(Window.orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0))
    return gone.join(times.withColumn("deleted_at", latest).drop("t"), "sequence").select(F.lit("pubmed").alias("source"), "record_id", "deleted_at", "order_key")


def pubmed_rejected(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, scheme, value): identifiers that their source marks as not valid."""
    schema = "MedlineCitation struct<PMID:string, Article:struct<ELocationID:array<struct<_EIdType:string,_ValidYN:string,_VALUE:string>>>>"
    rows = pubmed_events(spark, path).where("kind = 'upsert'").select("record_id", F.explode(F.from_xml("raw", schema)["MedlineCitation"]["Article"]["ELocationID"]).alias("e"))
    marked = rows.where((F.lower("e._EIdType") == "doi") & (F.upper("e._ValidYN") == "N"))
    return marked.select("record_id", F.lit("doi").alias("scheme"), text.trim_space(F.col("e._VALUE")).alias("value"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a metrics CSV with their ``problem``: null, or what is wrong with them."""
    rows = spark.read.schema(METRICS).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)
    known = F.col("status") == "known"
    problem = (
        F.when(identifiers.issn(F.col("issn_l")).isNull(), "issn_l")
        .when(~F.col("status").isin("known", "unknown"), "status")
        .when(known & (F.col("jif").isNull() | F.col("quartile").isNull()), "known_without_value")
        .when(~known & (F.col("jif").isNotNull() | F.col("quartile").isNotNull()), "unknown_with_value")
        .when(F.col("jif") < 0, "jif")
        .when(F.col("quartile").isNotNull() & ~F.col("quartile").isin("Q1", "Q2", "Q3", "Q4"), "quartile")
    )
    return rows.withColumn("problem", problem)
