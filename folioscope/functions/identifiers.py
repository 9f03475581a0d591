"""Normal forms of scholarly identifiers; null where a value isn't valid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import trim_space

#: Fixed list: archives of arXiv identifiers from before April 2007.
LEGACY_ARCHIVES = (
    "acc-phys adap-org alg-geom ao-sci astro-ph atom-ph bayes-an chao-dyn chem-ph cmp-lg comp-gas cond-mat cs dg-ga "
    "funct-an gr-qc hep-ex hep-lat hep-ph hep-th math math-ph mtrl-th nlin nucl-ex nucl-th patt-sol physics plasm-ph "
    "q-alg q-bio quant-ph solv-int supr-con"
).split()
#: Precedence of identifier schemes for a work's identity.
SCHEMES = ("doi", "arxiv", "openreview", "s2", "openalex")


def _if(valid: Column, v: Column) -> Column:
    return F.when(valid, v)


def doi(raw: Column) -> Column:
    """Trimmed, without resolver address or label, in lower case."""
    v = trim_space(raw)
    v = F.regexp_replace(v, r"^(?i)https?://(?:dx\.)?doi\.org/", "")
    v = F.lower(trim_space(F.regexp_replace(v, r"^(?i)doi:", "")))
    return _if(v.rlike(r"^10\.[0-9]{4,9}/\S+$"), v)


def arxiv(raw: Column) -> Column:
    """Without address, label, ``.pdf`` and version; new and old forms with valid months."""
    v = trim_space(raw)
    v = F.regexp_replace(v, r"^(?i)https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/", "")
    v = F.lower(trim_space(F.regexp_replace(v, r"^(?i)arxiv:", "")))
    v = F.regexp_replace(v, r"\.pdf$", "")
    plain = F.regexp_replace(v, r"v[1-9][0-9]*$", "")
    month = F.regexp_extract(plain, r"^([0-9]{4})\.([0-9]{4,5})$", 1)
    number = F.regexp_extract(plain, r"^([0-9]{4})\.([0-9]{4,5})$", 2)
    yymm = F.when(month != "", month.cast("int"))
    calendar = (yymm % 100).between(1, 12)
    long = F.char_length(number)
    new = calendar & (((long == 4) & yymm.between(704, 1412)) | ((long == 5) & (yymm >= 1501))) & (number.cast("int") > 0)
    old_pattern = r"^([a-z-]+)(?:\.[a-z]{2})?/([0-9]{2})([0-9]{2})([0-9]{3})$"
    archive = F.regexp_extract(plain, old_pattern, 1)
    year, mon, seq = (F.regexp_extract(plain, old_pattern, k) for k in (2, 3, 4))
    full = F.when(year != "", F.when(year.cast("int") >= 91, 1900).otherwise(2000) + year.cast("int"))
    stamp = full * 100 + F.when(mon != "", mon.cast("int"))
    old = archive.isin(LEGACY_ARCHIVES) & mon.cast("int").between(1, 12) & stamp.between(199108, 200703) & (seq.cast("int") > 0)
    safe_old = F.when(year != "", F.coalesce(old, F.lit(False))).otherwise(False)
    safe_new = F.when(month != "", F.coalesce(new, F.lit(False))).otherwise(False)
    return _if(safe_new | safe_old, plain)


def openreview(raw: Column) -> Column:
    v = F.regexp_replace(trim_space(raw), r"^(?i)https?://(?:www\.)?openreview\.net/(?:forum|pdf)\?id=", "")
    v = F.regexp_replace(v, r"^(?i)openreview:", "")
    return _if(v.rlike(r"^[A-Za-z0-9_-]{5,64}$"), v)


def semantic_scholar(raw: Column) -> Column:
    v = F.lower(F.regexp_replace(trim_space(raw), r"^(?i)(?:https?://(?:www\.)?semanticscholar\.org/paper/(?:[^/]+/)?|s2:)", ""))
    return _if(v.rlike(r"^[0-9a-f]{40}$"), v)


def openalex_work(raw: Column) -> Column:
    v = F.upper(F.regexp_replace(trim_space(raw), r"^(?i)https?://(?:api\.)?openalex\.org/(?:works/)?", ""))
    return _if(v.rlike(r"^W[1-9][0-9]*$"), v)


def pmid(raw: Column) -> Column:
    v = F.regexp_replace(trim_space(raw), r"^(?i)https?://(?:www\.)?(?:pubmed\.ncbi\.nlm\.nih\.gov|ncbi\.nlm\.nih\.gov/pubmed)/", "")
    v = F.regexp_replace(trim_space(F.regexp_replace(v, r"^(?i)pmid:", "")), r"/$", "")
    return _if(v.rlike(r"^[1-9][0-9]{0,8}$"), v)


def pmcid(raw: Column) -> Column:
    v = F.regexp_replace(trim_space(raw), r"^(?i)https?://(?:www\.)?(?:pmc\.ncbi\.nlm\.nih\.gov|ncbi\.nlm\.nih\.gov/pmc)/articles/", "")
    v = F.upper(F.regexp_replace(trim_space(F.regexp_replace(v, r"^(?i)pmcid:", "")), r"/$", ""))
    return _if(v.rlike(r"^PMC[1-9][0-9]*$"), v)


def _check_value(c: Column) -> Column:
    """The value of a digit, of which X is 10."""
    return F.when(c == "X", 10).otherwise(c.try_cast("int"))


def _folded(v: Column, begin: int, step: Callable[[Column, Column], Column]) -> Column:
    """The characters of ``v`` taken in one after the other."""
    return F.aggregate(F.split(v, ""), F.lit(begin), lambda total, c: step(total, _check_value(c)))


def issn(raw: Column) -> Column:
    """``NNNN-NNNC``, hyphen included, with a valid check digit (weights 8 to 2, modulo 11)."""
    v = F.upper(trim_space(raw))
    digits = F.split(F.replace(v, F.lit("-"), F.lit("")), "")
    total = F.aggregate(F.transform(digits, lambda c, i: _check_value(c) * (8 - i)), F.lit(0), lambda a, b: a + b)
    return _if(F.when(v.rlike(r"^[0-9]{4}-[0-9]{3}[0-9X]$"), total % 11 == 0).otherwise(False), v)


def openalex_entity(raw: Column, prefix: str) -> Column:
    """An entity's id of one kind: ``A`` authors, ``I`` institutions, ``S`` sources, ``T`` topics, ``W`` works."""
    v = F.upper(trim_space(F.regexp_replace(trim_space(raw), r"^(?i)https?://openalex\.org/", "")))
    return _if(v.rlike(rf"^{prefix}[1-9][0-9]*$"), v)


def orcid(raw: Column) -> Column:
    """Four groups of four, without address, with a valid ISO 7064 mod 11-2 check character."""
    v = F.upper(F.regexp_replace(trim_space(raw), r"^(?i)https?://(?:www\.)?orcid\.org/", ""))
    plain = F.replace(v, F.lit("-"), F.lit(""))
    total = _folded(F.substring(plain, 1, 15), 0, lambda t, d: (t + d) * 2 % 11)
    valid = F.when(v.rlike(r"^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$"), (12 - total) % 11 == _check_value(F.substring(plain, 16, 1))).otherwise(False)
    return _if(valid, v)


def github_repository(raw: Column) -> Column:
    """``https://github.com/owner/name`` of an address on that host, without ``.git``."""
    pattern = r"^(?i)https?://(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?(?:[/?#].*)?$"
    owner, name = (F.regexp_extract(trim_space(raw), pattern, k) for k in (1, 2))
    return _if((owner != "") & (name != "") & ~name.isin(".", ".."), F.concat(F.lit("https://github.com/"), F.lower(owner), F.lit("/"), F.lower(name)))


def canonical_identity(candidates: dict[str, Column]) -> Column:
    """struct(scheme, value, conflict) of arrays of normalised identifiers, by precedence.

    Invalid (null) candidates are passed over.  More than one distinct value in any scheme
    is a conflict.
    """
    distinct = {s: F.array_distinct(F.filter(candidates[s], lambda x: x.isNotNull())) for s in SCHEMES if s in candidates}
    conflict = F.lit(False)
    for v in distinct.values():
        conflict = conflict | (F.size(v) > 1)
    scheme = F.coalesce(*(F.when(F.size(v) > 0, F.lit(s)) for s, v in distinct.items()))
    found = F.coalesce(*(F.get(v, F.lit(0)) for v in distinct.values()))
    return F.struct(scheme.alias("scheme"), found.alias("value"), conflict.alias("conflict"))


def scheme_priority(scheme: Column) -> Column:
    case = F.lit(None).cast("int")
    for i, s in enumerate(SCHEMES):
        case = F.when(scheme == s, i + 1) if i == 0 else case.when(scheme == s, i + 1)
    return case.otherwise(len(SCHEMES) + 1)
