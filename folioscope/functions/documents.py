"""JSON and markup values: canonical forms, strictness, plain text, normalised lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _only_value(v: Column) -> Column:
    """Whether a text holds one JSON value and nothing after it (which parsing passes over)."""
    alone = F.concat(F.lit("["), F.to_json(F.try_parse_json(v)), F.lit("]"))
    return F.coalesce(F.to_json(F.try_parse_json(F.concat(F.lit("["), v, F.lit("]")))) == alone, F.lit(False))


def canonical_json(v: Column) -> Column:
    """JSON with sorted keys; null for anything but one valid value without repeated keys."""
    return F.when(_only_value(v), F.to_json(F.try_parse_json(v)))


def same_json(a: Column, b: Column) -> Column:
    """Equal as JSON values, whatever the order of keys."""
    return F.coalesce(canonical_json(a) == canonical_json(b), F.lit(False))


def json_kind(v: Column) -> Column:
    """object, array, string, number, boolean, null or invalid."""
    schema = F.schema_of_variant(F.when(_only_value(v), F.try_parse_json(v)))
    return (
        F.when(schema.isNull(), "invalid")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .otherwise("number")
    )


#: Elements of marked-up abstracts, those that may be outermost, and those that stand apart from their neighbours.
JATS_ELEMENTS = (
    "abstract alternatives bold break disp-formula email ext-link inline-formula italic label list list-item monospace named-content p sc sec "
    "styled-content sub sup tex-math title underline uri xref"
).split()
JATS_ROOTS = ("abstract", "p", "sec", "title")
JATS_BLOCKS = "abstract break disp-formula label list list-item p sec title".split()
#: Namespaces that a prefix of the elements, if it isn't ``jats``, must stand for.
JATS_SPACES = ("http://www.ncbi.nlm.nih.gov/JATS1", "http://jats.nlm.nih.gov")
#: How deep elements nest, how many there are, and bytes of text, at most.
JATS_DEPTH, JATS_COUNT, JATS_BYTES = 64, 10_000, 1 << 20
#: Entities with names.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}

_QUOTED = r"""(?:"[^"]*"|'[^']*')"""
#: The pieces of a marked-up text; every character is in one.
_PIECE = rf"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<[!?][^>]*>|</?[A-Za-z_][^<>\"']*+(?:{_QUOTED}[^<>\"']*+)*+>|[^<]+|<"
_TAG = r"""(?s)^(?:</[A-Za-z_][\w:.-]*\s*>|<[A-Za-z_][\w:.-]*(?:\s+[A-Za-z_][\w:.-]*\s*=\s*(?:"[^"<]*"|'[^'<]*'))*+\s*/?>)$"""


def _code_point(x: Column) -> Column:
    """The number of a numeric entity that XML allows, or null."""
    hexed, plain = (F.regexp_extract(x, pattern, 1) for pattern in ("^&#x([0-9A-Fa-f]{1,6});$", "^&#([0-9]{1,7});$"))
    n = F.when(hexed != "", F.conv(hexed, 16, 10).cast("int")).when(plain != "", plain.cast("int"))
    return F.when(n.isin(9, 10, 13) | n.between(0x20, 0xD7FF) | n.between(0xE000, 0xFFFD) | n.between(0x10000, 0x10FFFF), n)


def _resolved(text: Column) -> Column:
    """A text with its entities replaced; null if one isn't known."""

    def one(x: Column) -> Column:
        named = F.when(~x.startswith("&"), x)
        for entity, char in ENTITIES.items():
            named = named.when(x == entity, char)
        return named.otherwise(F.decode(F.unhex(F.lpad(F.hex(_code_point(x)), 8, "0")), "UTF-32"))

    parts = F.transform(F.regexp_extract_all(text, F.lit("&[^;&]*;?|[^&]+"), F.lit(0)), one)
    return F.when(~text.contains("&"), text).when(~F.exists(parts, lambda x: x.isNull()), F.array_join(parts, ""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def marked_text(v: Column) -> Column:
    """struct(text, problem) of an abstract: plain text as it is, or the text of well-formed markup; white space collapsed.

    What doesn't begin with ``<`` is plain: ``1 < 2`` stays.  Else it is cut into pieces once,
    which are folded with a stack of the open elements.  A problem (syntax, markup, element,
    root, entity, nesting, outside, incomplete, or a limit: depth, elements, text_bytes) leaves
    no text.
    """

    def known(value: Column) -> Column:
        pieces = F.regexp_extract_all(value, F.lit(_PIECE), F.lit(0))
        root = F.regexp_extract(value, rf"(?s)^<[^<>\"']*+(?:{_QUOTED}[^<>\"']*+)*+>", 0)
        spaces = "|".join(JATS_SPACES).replace(".", "\\.")
        own = F.regexp_extract(root, rf"xmlns:([A-Za-z_][\w.-]*)\s*=\s*[\"'](?:{spaces})[\"']", 1)
        bare = root.rlike(rf"xmlns\s*=\s*[\"'](?:{spaces})[\"']")
        return _let(F.transform(pieces, lambda t: piece(t, own, bare)), folded)

    def piece(t: Column, own: Column, bare: Column) -> Column:
        full = F.regexp_extract(t, r"^</?([A-Za-z_][\w:.-]*)", 1)
        prefix, local = F.regexp_extract(full, "^(?:([^:]*):)?", 1), F.regexp_replace(full, "^[^:]*:", "")
        kind = F.when(t.startswith("<![CDATA["), "data").when(t.rlike("^<[!?]"), "markup").when(t == "<", "stray").when(~t.startswith("<"), "text").when(t.startswith("</"), "close").when(t.endswith("/>"), "empty").otherwise("open")
        tag = kind.isin("open", "close", "empty")
        allowed = local.isin(*JATS_ELEMENTS) & F.when(full.contains(":"), (prefix == "jats") | (prefix == own)).otherwise(bare)
        text = F.when(kind == "text", _resolved(t)).when(kind == "data", F.substr(t, F.lit(10), F.char_length(t) - 12)).when(tag & local.isin(*JATS_BLOCKS), " ").otherwise("")
        problem = F.when((kind == "stray") | (tag & ~t.rlike(_TAG)) | ((kind == "text") & t.contains("]]>")), "syntax").when(kind == "markup", "markup").when(tag & ~allowed, "element").when(text.isNull(), "entity")
        return F.struct(kind.alias("kind"), full.alias("name"), local.alias("local"), text.alias("text"), problem.alias("problem"))

    def folded(pieces: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("elements"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("string").alias("problem"))

        def step(state: Column, t: Column) -> Column:
            depth = F.size(state["open"])
            opens, told = t["kind"].isin("open", "empty"), t["kind"].isin("text", "data")
            elements = state["elements"] + F.when(opens, 1).otherwise(0)
            size = state["bytes"] + F.when(told, F.octet_length(F.coalesce(t["text"], F.lit("")))).otherwise(0)
            wrong = (
                F.when(opens & (depth == 0) & ~t["local"].isin(*JATS_ROOTS), "root")
                .when(opens & (depth >= JATS_DEPTH), "depth")
                .when(elements > JATS_COUNT, "elements")
                .when(size > JATS_BYTES, "text_bytes")
                .when((t["kind"] == "close") & ((depth == 0) | (F.element_at(state["open"], -1) != t["name"])), "nesting")
                .when(told & (depth == 0) & ~t["text"].rlike(r"^\s*$"), "outside")
            )
            problem = F.coalesce(state["problem"], t["problem"], wrong)
            stack = F.when(problem.isNotNull(), state["open"]).when(t["kind"] == "open", F.array_append(state["open"], t["name"])).when(t["kind"] == "close", F.slice(state["open"], 1, depth - 1)).otherwise(state["open"])
            return F.struct(stack.alias("open"), elements.alias("elements"), size.cast("long").alias("bytes"), problem.alias("problem"))

        end = F.aggregate(pieces, start, step, lambda s: F.coalesce(s["problem"], F.when(F.size(s["open"]) > 0, "incomplete")))
        return F.struct(F.array_join(F.transform(pieces, lambda t: F.coalesce(t["text"], F.lit(""))), "").alias("text"), end.alias("problem"))

    def whole(value: Column) -> Column:
        read = F.when(value.startswith("<"), known(value)).otherwise(F.struct(value.alias("text"), F.lit(None).cast("string").alias("problem")))
        return _let(read, lambda r: F.struct(F.when(r["problem"].isNull(), F.trim(F.regexp_replace(r["text"], r"\s+", " "))).alias("text"), r["problem"].alias("problem")))

    return F.when(v.isNotNull(), _let(F.regexp_replace(v, r"^\s+|\s+$", ""), whole))


def normalised_list(v: Column) -> Column:
    """Trimmed, without blanks and repeats, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(v, lambda x: F.trim(x)), lambda x: x != "")))


def undeclared(required: Column, declared: Column) -> Column:
    """What is required but not declared."""
    return F.array_sort(F.array_except(required, declared))
