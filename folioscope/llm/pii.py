"""Personal data by weak supervision, in DataFrame functions only.

Method: patterns propose candidate spans.  Three labelers vote on each: a format check
(regex), lists of known providers, prefixes and ranges (gazetteer), and the words just
before the span (context).  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is; the posteriors train a naive Bayes classifier over
features of the span, which decides about every candidate.  Base spans (well-formed e-mail
and IP addresses, card and phone numbers) always stay; the classifier adds others.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import spans

#: Kinds in their order: four base kinds, then kinds that only the classifier adds.
KINDS = ("email", "ip", "card", "phone", "mail_words", "phone_local", "ssn", "iban")
BASE = 4
#: The patterns start only where a leftmost match can (after the last match, or where the
#: run of characters begins), which spares a retry at each character of a long run; a look
#: at the first character comes before anything dearer.  Groups repeat possessively, which
#: takes no stack however long the match.
PATTERNS = (
    r"(?=[A-Za-z0-9._%+-])(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9]){11,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z]{2,24}+",
    r"(?=[(0-9])(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
)
#: A plainer pattern that is in every text with a match of the pattern, for a quick look.
HOLDS = ("@", None, None, r"\+", r"[\[(](?:at|AT)[\])]", None, "[0-9]-[0-9]", None)
#: Fixed lists: public suffixes that mail is often sent to, issuer prefixes of payment cards,
#: country codes of phone numbers, countries of bank accounts.
MAIL_SUFFIXES = r"\.(?:com|net|org|edu|gov|info|biz|io|co|us|uk|de|fr|es|it|nl|ch|at|be|eu)$"
CARD_PREFIXES = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|39|35|6011|64|65|62)"
COUNTRY_CODES = r"^\+(?:1|7|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
IBAN_COUNTRIES = r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|HU|IE|IT|LU|NL|NO|PL|PT|SE)"
#: Words before a span that speak for its kind, and words that speak for a plain number.
FOR = (
    r"mail|contact|write|send|kontakt|correo|courriel",
    r"\bip\b|host|address|server|login|client",
    r"card|visa|master|amex|credit|debit|karte|tarjeta|carte",
    r"phone|tel|call|fax|mobile|cell|whatsapp|handy",
    r"mail|contact|write|send",
    r"phone|tel|call|fax|mobile|cell",
    r"ssn|social|security",
    r"iban|account|bank|konto|cuenta|compte",
)
AGAINST = r"version|isbn|order|invoice|serial|build|release|part no|sku"
#: Characters before a span that the context labeler reads, back to the candidate before it.
CONTEXT = 32
#: Posterior from which a candidate that is no base span is added.
THRESHOLD = 0.9
#: Worth of the prior belief in each labeler, in votes; and rounds.
PRIOR, ROUNDS = 20.0, 50

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _well_formed(kind: int, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == 1:
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == 2:
        return F.char_length(digits).between(12, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == 3:
        return F.char_length(digits).between(9, 15)
    if kind == 6:
        return ~hit.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == 7:
        return F.char_length(F.regexp_replace(hit, " ", "")).between(15, 34)
    return F.lit(True)


def _gazetteer(kind: int, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    known, wrong = {
        0: (F.lower(hit).rlike(MAIL_SUFFIXES), F.lit(False)),
        1: (F.lit(False), hit.rlike(r"^0*(?:0|127|255)\.")),
        2: (digits.rlike(CARD_PREFIXES), digits.rlike(r"^([0-9])\1+$")),
        3: (hit.rlike(COUNTRY_CODES), hit.rlike(r"^\+0")),
        5: (digits.rlike(r"^[2-9][0-9]{2}[2-9]"), digits.rlike(r"^[01]")),
        7: (hit.rlike(IBAN_COUNTRIES), F.lit(False)),
    }.get(kind, (F.lit(False), F.lit(False)))
    return F.when(wrong, -1).when(known, 1).otherwise(0)


def _features(kind: int, s: Column) -> Column:
    """Votes of the labelers and features of a span: small whole numbers."""
    before, last = F.lower(s["before"]), F.substring(s["before"], -1, 1)
    return F.struct(
        F.lit(kind).alias("kind"),
        F.when(_well_formed(kind, s["hit"]), 1).otherwise(-1).alias("v_format"),
        _gazetteer(kind, s["hit"]).alias("v_list"),
        F.when(before.rlike(FOR[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0).alias("v_context"),
        F.least(F.floor(F.char_length(s["hit"]) / 6), F.lit(5)).cast("int").alias("f_length"),
        F.when(last == "", 0).when(last.rlike(r"^\s"), 1).when(last.rlike(r"^[A-Za-z0-9]"), 2).otherwise(3).alias("f_left"),
    )


@dataclass(frozen=True)
class PiiModel:
    """Log-odds of the trained classifier, and how often each labeler was found right."""

    prior: dict[int, float]
    weights: dict[tuple[str, int, int], float]
    reliability: dict[str, float]

    def probability(self, features: Column, kind: int) -> Column:
        """Probability that a span of this kind with these features is personal data."""
        total = F.lit(self.prior.get(kind, 0.0))
        for name in ("v_format", "v_list", "v_context", "f_length", "f_left"):
            known = [(value, w) for (n, k, value), w in sorted(self.weights.items()) if n == name and k == kind]
            case = None
            for value, weight in known:
                hit = features[name] == value
                case = F.when(hit, F.lit(weight)) if case is None else case.when(hit, F.lit(weight))
            if case is not None:
                total = total + case.otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _formed(kind: int) -> Callable[[Column], Column]:
    return lambda s: _well_formed(kind, s["hit"])


def _featured(kind: int) -> Callable[[Column], Column]:
    return lambda s: _features(kind, s)


def _likely(model: PiiModel, kind: int, threshold: float) -> Callable[[Column], Column]:
    return lambda s: model.probability(_features(kind, s), kind) >= threshold


def _candidates(text: Column) -> list[Column]:
    return [spans.matches(text, pattern, k, HOLDS[k], CONTEXT) for k, pattern in enumerate(PATTERNS)]


def estimate(counts: list[tuple[dict[str, int], float]]) -> tuple[list[float], dict[str, float]]:
    """Posterior of each vote pattern, and each labeler's accuracy, by expectation-maximisation.

    ``counts`` has the votes (1, -1, or 0 for none) of each pattern and how often it occurs.
    Labelers are taken as independent given the truth; a beta prior holds each accuracy near
    0.8 until votes outweigh it.
    """
    names = ("v_format", "v_list", "v_context")
    accuracy = dict.fromkeys(names, 0.8)
    share = {}
    posterior = [0.5] * len(counts)
    for _ in range(ROUNDS):
        for i, (votes, _) in enumerate(counts):
            p = share.get(votes["kind"], 0.5)
            odds = math.log(p / (1 - p))
            for n in names:
                odds += votes[n] * math.log(accuracy[n] / (1 - accuracy[n]))
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for n in names:
            right = sum(c * (q if v[n] > 0 else 1 - q) for (v, c), q in zip(counts, posterior, strict=True) if v[n])
            cast = sum(c for v, c in counts if v[n])
            accuracy[n] = min(0.99, max(0.51, (right + 0.8 * PRIOR) / (cast + PRIOR)))
        for kind in {v["kind"] for v, _ in counts}:
            own = [(c, q) for (v, c), q in zip(counts, posterior, strict=True) if v["kind"] == kind]
            share[kind] = (sum(c * q for c, q in own) + 0.5 * PRIOR) / (sum(c for c, _ in own) + PRIOR)
    return posterior, accuracy


def fit(df: DataFrame, text_col: str = "text") -> PiiModel:
    """A classifier trained on all candidates of ``df`` from the labelers' votes alone.

    Spark counts how often each combination of kind, votes and features occurs; those counts
    (fewer than 5,000 combinations, whatever the size of ``df``) are all that is collected.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = df.select(text.alias("t")).select(*(c.alias(f"c{k}") for k, c in enumerate(_candidates(F.col("t")))))
    rows = found.select(F.concat(*(F.transform(F.col(f"c{k}"), _featured(k)) for k in range(len(KINDS)))).alias("f"))
    counted = rows.select(F.explode("f").alias("f")).groupBy("f.kind", "f.v_format", "f.v_list", "f.v_context", "f.f_length", "f.f_left").agg(F.count("*").alias("n")).collect()
    cells = sorted((r.asDict() for r in counted), key=lambda r: [r[k] for k in sorted(r) if k != "n"])
    posterior, accuracy = estimate([(r, r["n"]) for r in cells])
    mass: dict[tuple[str, int, int], list[float]] = {}
    prior: dict[int, list[float]] = {}
    for r, q in zip(cells, posterior, strict=True):
        for side, part in ((1, q), (0, 1 - q)):
            prior.setdefault(r["kind"], [1.0, 1.0])[side] += part * r["n"]
            for name in ("v_format", "v_list", "v_context", "f_length", "f_left"):
                mass.setdefault((name, r["kind"], r[name]), [1.0, 1.0])[side] += part * r["n"]
    weights = {key: math.log(m[1] / prior[key[1]][1]) - math.log(m[0] / prior[key[1]][0]) for key, m in mass.items()}
    return PiiModel({k: math.log(p[1] / p[0]) for k, p in prior.items()}, weights, accuracy)


def find(df: DataFrame, model: PiiModel, text_col: str = "text", to: str = "pii", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with column ``to``: all spans (kind, start, end, hit) by start, then kind.

    Base spans are leftmost and non-overlapping within their kind, and stay if well formed.
    Other candidates are added if well formed, no base span overlaps them, and the classifier
    gives them ``threshold`` or more.  A null text counts as empty: no spans.  A column named
    ``to`` is replaced, other columns stay; repeated rows give repeated results.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = df.withColumn(to, F.struct(*(c.alias(f"c{k}") for k, c in enumerate(_candidates(text)))))
    base = F.concat(*(F.filter(F.col(to)[f"c{k}"], _formed(k)) for k in range(BASE)))
    found = found.withColumn(to, F.struct(base.alias("base"), *(F.col(to)[f"c{k}"].alias(f"c{k}") for k in range(BASE, len(KINDS)))))
    more = [
        F.filter(F.filter(spans.outside(F.col(to)[f"c{k}"], F.col(to)["base"]), _formed(k)), _likely(model, k, threshold))
        for k in range(BASE, len(KINDS))
    ]
    return found.withColumn(to, spans.ordered(F.col(to)["base"], *more))


def redact(df: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """``df`` with each span of personal data in its texts replaced by ``<KIND>``.

    A null text stays null; a text without personal data stays as it is.  Other columns stay,
    whatever their names.
    """
    own = f"pii {uuid.uuid4().hex}"
    found = find(df, model, text_col, own)
    return found.withColumn(text_col, spans.replaced(F.col(text_col), F.col(own), KINDS)).drop(own)
