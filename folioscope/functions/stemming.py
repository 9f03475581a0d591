"""The English Snowball stemmer (Porter, 2001) as a column expression.

Every step replaces the longest suffix of its list, on conditions on where regions of the word
begin: R1 after the first consonant that follows a vowel, R2 after the next such one in R1.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words with stems of their own, words that stay, and words that stay after their plural is undone.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
INVARIANT = "sky news howe atlas cosmos bias andes".split()
AFTER_PLURAL = "inning outing canning herring earring proceed exceed succeed".split()
#: Beginnings after which R1 begins.
BEGINNINGS = "gener|commun|arsen"
#: Suffixes of steps 2 and 3 that R1 must hold, and what stands for them.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Suffixes of step 4 that R2 must hold, which go.
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
#: Letters before a final ``li`` that goes.
BEFORE_LI = "cdeghkmnrt"

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
#: A short syllable at the end of what is left.
_SHORT = f"(^{_VOWEL}{_OTHER}|{_OTHER}{_VOWEL}[^aeiouywxY])$"


def _one_of(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _has(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, '{pattern}', 0) <> ''"


def _suffix(suffixes) -> str:
    return f"regexp_extract(v, '({'|'.join(sorted(suffixes, key=len, reverse=True))})$', 0)"


_CUT = "left(v, length(v) - 1)"


def steps() -> list[tuple[str, str]]:
    """(suffix, replacement) of each step as SQL over the word ``v``, its regions' begins ``p1`` and ``p2``, the
    suffix ``b`` found and what stands before it, ``u``.

    The expressions use functions alone that SQL engines agree on.
    """
    swaps = lambda table: " ".join(f"when b = '{k}' then concat(u, '{x}')" for k, x in table.items())
    plural = (
        "case when v like '%sses' then left(v, length(v) - 2) "
        "when v like '%ied' or v like '%ies' then case when length(v) > 4 then left(v, length(v) - 2) else left(v, length(v) - 1) end "
        f"when v like '%us' or v like '%ss' then v when v like '%s' and {_has('left(v, greatest(length(v) - 2, 0))', _VOWEL)} then {_CUT} else v end"
    )
    past = (
        "case when b = '' then v when b in ('eed', 'eedly') then case when length(u) >= p1 then concat(u, 'ee') else v end "
        f"when not ({_has('u', _VOWEL)}) then v when {_has('u', '(at|bl|iz)$')} then concat(u, 'e') "
        f"when {_has('u', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} then left(u, length(u) - 1) "
        f"when p1 >= length(u) and {_has('u', _SHORT)} then concat(u, 'e') else u end"
    )
    final_y = f"case when {_has('v', f'.{_OTHER}[yY]$')} then concat({_CUT}, 'i') else v end"
    two = (
        f"case when b = '' or length(u) < p1 then v when b = 'ogi' then case when u like '%l' then concat(u, 'og') else v end "
        f"when b = 'li' then case when {_has('u', f'[{BEFORE_LI}]$')} then u else v end {swaps(STEP2)} else v end"
    )
    three = f"case when b = '' or length(u) < p1 then v when b = 'ative' then case when length(u) >= p2 then u else v end {swaps(STEP3)} else v end"
    four = f"case when b = '' or length(u) < p2 then v when b = 'ion' then case when {_has('u', '[st]$')} then u else v end else u end"
    last = (
        f"case when v like '%e' and (length(v) - 1 >= p2 or (length(v) - 1 >= p1 and not ({_has(_CUT, _SHORT)}))) then {_CUT} "
        f"when v like '%ll' and length(v) - 1 >= p2 then {_CUT} else v end"
    )
    return [
        ("''", plural),
        (_suffix("eedly ingly edly eed ing ed".split()), past),
        ("''", final_y),
        (_suffix([*STEP2, "ogi", "li"]), two),
        (_suffix([*STEP3, "ative"]), three),
        (_suffix([*STEP4, "ion"]), four),
        ("''", last),
    ]


def region(text: str) -> str:
    """Characters of a text up to where the region after its first vowel and consonant begins."""
    found = f"length(regexp_extract({text}, '^.*?{_VOWEL}{_OTHER}', 0))"
    return f"case when {found} = 0 then length({text}) else {found} end"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def stem_sql(word: str) -> str:
    """SQL of Spark for the stem of the lower-case word that an expression gives."""
    marked = f"regexp_replace(regexp_replace({word}, '^y', 'Y'), '([aeiouy])y', '$1Y')"
    chain = "v"
    for k, (suffix, replaced) in reversed(list(enumerate(steps()))):
        after = chain if k else f"case when v in ({_one_of(AFTER_PLURAL)}) then v else {chain} end"
        value = replaced if suffix == "''" else _let("b", suffix, _let("u", "left(v, length(v) - length(b))", replaced))
        chain = _let("v", value, after)
    first = f"case when {_has('v', f'^({BEGINNINGS})')} then length(regexp_extract(v, '^({BEGINNINGS})', 0)) else {region('v')} end"
    second = _let("r", "substring(v, p1 + 1)", f"p1 + {region('r')}")
    whole = _let("v", marked, _let("p1", first, _let("p2", second, chain)))
    own = " ".join(f"when '{k}' then '{v}'" for k, v in {**EXCEPTIONS, **{w: w for w in INVARIANT}}.items())
    return f"case when length({word}) <= 2 then {word} else case {word} {own} else lower({whole}) end end"


def stems(words: str) -> Column:
    """Stems of the lower-case words of an array column, by its name."""
    return F.expr(f"transform({words}, w -> {stem_sql('w')})")


def vocabulary(words: DataFrame, name: str) -> DataFrame:
    """(``name``, stem) of the distinct lower-case words of a column.

    Steps are columns after each other, not expressions within one another: each is computed
    once a word.  Where texts are many, join to this rather than stem every word of them.
    """
    own = " ".join(f"when {name} = '{k}' then '{v}'" for k, v in {**EXCEPTIONS, **{w: w for w in INVARIANT}}.items())
    starts = f"regexp_extract(v, '^({BEGINNINGS})', 0)"
    rows = words.select(name).distinct().selectExpr(name, f"regexp_replace(regexp_replace({name}, '^y', 'Y'), '([aeiouy])y', '$1Y') as v")
    rows = rows.selectExpr("*", f"case when {starts} <> '' then length({starts}) else {region('v')} end as p1").selectExpr("*", "substring(v, p1 + 1) as r").selectExpr(name, "v", "p1", f"p1 + {region('r')} as p2", "cast(null as string) as fixed")
    for k, (suffix, replaced) in enumerate(steps()):
        rows = rows.selectExpr("*", f"{suffix} as b").selectExpr("*", "left(v, length(v) - length(b)) as u").selectExpr(name, f"{replaced} as v", "p1", "p2", "fixed")
        if not k:
            rows = rows.selectExpr(name, "v", "p1", "p2", f"case when v in ({_one_of(AFTER_PLURAL)}) then v end as fixed")
    return rows.selectExpr(name, f"case when length({name}) <= 2 then {name} {own} else lower(coalesce(fixed, v)) end as stem")


@lru_cache(maxsize=10_000)
def stems_of(words: tuple[str, ...]) -> dict[str, str]:
    """The stems of the words of a query, in one small job."""
    rows = SparkSession.active().createDataFrame([(w,) for w in words], "word string").coalesce(1)
    return {r["word"]: r["stem"] for r in vocabulary(rows, "word").collect()}
