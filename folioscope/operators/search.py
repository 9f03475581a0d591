"""Full-text match and rank over plain English text.

Words are lower-cased runs of letters and digits; stop words are passed over, and the English
Snowball stemmer joins inflections.  A query has words (all must occur), ``"phrases"``,
``OR`` between alternatives and ``-`` before what must not occur.  Rank is the share of the
text's words that the query names, damped by length; it isn't comparable with other engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import stemming

#: Fixed list of English words that don't count.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our s she "
    "so t than that the their them then there these they this those to too us was we were what when which who will with you your".split()
)


def words_of(text: Column) -> Column:
    """A text's words in order, stop words left out."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*sorted(STOP_WORDS)))


def with_stems(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the stems of a text, stop words left out, in order; null for a null text."""
    return rows.withColumn("words_of_text", words_of(F.col(text))).withColumn(name, stemming.stems("words_of_text")).drop("words_of_text")


def parse(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of conjunctions of (wanted, stems of a word or phrase)."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)(\S+)', query.lower()):
        minus, text = (m[1], m[2]) if m[2] is not None else (m[3], m[4])
        if m[4] == "or":
            out.append([])
            continue
        words = [w for w in re.findall(r"[^\W_]+", text) if w not in STOP_WORDS]
        if words:
            out[-1].append((not minus, words))
    stems = stemming.stems_of(tuple(sorted({w for c in out for _, words in c for w in words})))
    return [[(wanted, [stems[w] for w in words]) for wanted, words in c] for c in out if c]


def _occurs(found: Column, words: list[str]) -> Column:
    """Stems hold no blank, so a phrase is a piece of the stems joined by blanks."""
    if len(words) == 1:
        return F.array_contains(found, words[0])
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" ")).contains(f" {' '.join(words)} ")


def meets(query: str, occurs: Callable[[list[str]], Column]) -> Column:
    """Whether any alternative of a query holds; ``occurs`` tells of a word or phrase."""
    any_of = F.lit(False)
    for conjunction in parse(query):
        all_of = F.lit(True)
        for wanted, words in conjunction:
            hit = occurs(words)
            all_of = all_of & (hit if wanted else ~hit)
        any_of = any_of | all_of
    return any_of


def matches(found: Column, query: str) -> Column:
    """Whether stems meet a query; a query of stop words only is met by nothing, and no text meets none."""
    return F.coalesce(meets(query, lambda words: _occurs(found, words)), F.lit(False))


def named_stems(query: str) -> list[str]:
    """Stems that a query asks for, sorted."""
    return sorted({w for c in parse(query) for wanted, words in c if wanted for w in words})


def rank(hits: Column, size: Column) -> Column:
    return F.round(hits / (F.lit(1.0) + F.log(F.lit(1.0) + size)), 6)


def relevance(found: Column, query: str) -> Column:
    """Rank of a text, by its stems, for a query."""
    named = named_stems(query)
    return rank(F.size(F.filter(found, lambda w: w.isin(*named))) if named else F.lit(0), F.size(found))
