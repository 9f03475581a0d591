"""Secret scans with character Markov models, in DataFrame functions only.

Method: two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are counted from labelled samples.  A candidate token is a secret if
the log-likelihood ratio of the models, per character, exceeds a threshold set on the
samples.  Patterns of well-known secrets find base spans, which always stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import spans

#: Kinds in their order; the last is what the models add.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of hex digits or of capitals after AKIA is matched whole or not at all, so that
#: the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Candidates for the models: 20 characters or more, a digit among them.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Parts of ordinary identifiers of programs in the default labelled sample.
WORDS = (
    "get set user name file path index count value list item data table row column key "
    "config option server client request response header body error message handler "
    "parse format read write open close create update delete query filter sort group "
    "page view model test main build release version default static public private "
    "image thumb small large left right top bottom width height color font"
).split()


#: Texts that ordinary identifiers are drawn from at most, and identifiers of each.
TEXTS, EACH = 2000, 16


def ordinary_identifiers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: int = TEXTS, each: int = EACH) -> DataFrame:
    """Rows (text, random = false): words of ``df``'s own texts, joined as identifiers are.

    A bounded sample: the ``texts`` rows with the smallest hashes of id and text (repeats of
    the last one included), and ``each`` identifiers of three words from each, spread over
    the whole text; words have 3 to 12 ASCII letters.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    order = F.xxhash64(F.lit("identifiers"), "id", F.substring("t", 1, 200))
    # the hashes are ranked without the texts
    last = rows.select(order.alias("o")).orderBy("o").limit(texts).agg(F.max("o")).first()[0]
    drawn = rows.select("t", order.alias("o")).where(F.col("o") <= F.lit(last))

    def made(w: Column) -> Column:
        def identifier(i: Column) -> Column:
            three = F.transform(F.slice(w, i, F.lit(3)), F.lower)
            number = F.pmod(F.xxhash64("o", i), F.lit(2000)).cast("string")
            forms = (
                F.concat(F.array_join(three, "_"), F.lit("_"), number),
                F.concat(F.array_join(F.transform(three, F.initcap), ""), number),
                F.concat(F.array_join(three, "-"), F.lit("-"), number),
                F.concat(F.array_join(three, "/"), F.lit("/"), number),
                F.upper(F.concat(F.array_join(three, "_"), number)),
            )
            return F.element_at(F.array(*forms), (F.pmod(F.xxhash64(i, "o"), F.lit(len(forms))) + 1).cast("int"))

        step = F.greatest(F.lit(1), F.floor((F.size(w) - 2) / each)).cast("int")
        places = F.slice(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1)), step), F.lit(1), F.lit(each))
        return F.when(F.size(w) >= 3, F.transform(places, identifier))

    # a text is taken apart once, and its identifiers leave before the rows multiply
    words = F.filter(F.split("t", "[^A-Za-z]+"), lambda w: F.char_length(w).between(3, 12))
    return drawn.select(F.explode(spans.let(words, made)).alias("text"), F.lit(False).alias("random"))


def labelled_sample(spark: SparkSession, size: int = 4000) -> DataFrame:
    """Default labelled sample (text, random): hashes in several codings, and identifiers of programs.

    ``ordinary_identifiers`` adds those that the words of a corpus make.
    """
    words = F.array(*(F.lit(w) for w in WORDS))
    raw = spark.range(size).select(F.col("id"), F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512).alias("h"))
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(2000)).cast("string")
    coded = F.base64(F.unhex("h"))
    random = raw.select(F.explode(F.array(F.substring("h", 1, 40), F.substring(coded, 1, 40), F.substring(F.upper(F.translate(coded, "+/=", "")), 1, 32), F.substring(F.translate(coded, "+/=", ""), 1, 24))).alias("text"), F.lit(True).alias("random"))
    ordinary = raw.select(
        F.explode(
            F.array(
                F.concat_ws("_", pick(1), pick(2), pick(3), number),
                F.concat(pick(4), F.initcap(pick(5)), F.initcap(pick(6)), F.initcap(pick(7)), number),
                F.concat_ws("-", pick(8), pick(9), number, pick(10)),
                F.concat_ws("/", pick(11), pick(12), F.concat(pick(13), number), pick(14)),
                F.upper(F.concat_ws("_", pick(15), pick(16), pick(17), number)),
                F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit("t")), F.lit(2_000_000_000))), "yyyy-MM-dd-HH-mm-ss"),
                F.concat(pick(18), F.lit("="), pick(19), F.lit("-"), pick(20), number),
                F.concat(pick(1), F.lit("-"), F.lpad(number, 12, "0")),
            )
        ).alias("text"),
        F.lit(False).alias("random"),
    )
    return random.union(ordinary)


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratio of each pair of characters, row by row, and the threshold."""

    ratios: tuple[float, ...]
    threshold: float

    def score(self, token: Column) -> Column:
        """Log-likelihood ratio of a token per character step; above 0 is rather random."""
        size = len(ALPHABET) + 1
        table = F.split(F.lit(",".join(f"{x:.5f}" for x in self.ratios)), ",").cast("array<double>")
        place = F.split(F.lit(",".join(str(ALPHABET.find(chr(c)) % size) for c in range(128))), ",").cast("array<int>")
        codes = F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(place, F.ascii(c)), F.lit(size - 1)))
        steps = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(table, a * size + b))
        total = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.char_length(token) > 1, total / F.greatest(F.size(steps), F.lit(1))).otherwise(0.0)


def fit(sample: DataFrame, missed: float = 0.02) -> MarkovModels:
    """Models from labelled rows (text string, random boolean).

    Pair counts are aggregated by Spark; at most (alphabet + 1) squared pairs for each label
    reach the driver.  The threshold lies halfway between the score that all but ``missed``
    of the random strings exceed and the one that 99.9 % of the ordinary ones stay below,
    but not below 0, where both models are equally likely.  Null texts or labels
    are passed over; without samples every ratio is 0 and nothing is ever found.
    """
    size = len(ALPHABET) + 1
    rows = sample.where("text is not null and random is not null")
    chars = rows.select("random", F.split("text", "").alias("c"))
    pairs = chars.select("random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    place = F.create_map(*(F.lit(x) for i, c in enumerate(ALPHABET) for x in (c, i)))
    code = lambda c: F.coalesce(place[c], F.lit(size - 1))
    counted = pairs.groupBy("random", "p").agg(F.count("*").alias("n")).groupBy("random", code(F.col("p.a")).alias("a"), code(F.col("p.b")).alias("b")).agg(F.sum("n").alias("n")).collect()
    tables = {True: [1.0] * (size * size), False: [1.0] * (size * size)}
    for r in counted:
        tables[r["random"]][r["a"] * size + r["b"]] += r["n"]
    logs = {}
    for label, table in tables.items():
        logs[label] = [math.log(table[i] / sum(table[i // size * size : (i // size + 1) * size])) for i in range(size * size)]
    ratios = tuple(a - b for a, b in zip(logs[True], logs[False], strict=True))
    if not counted:
        return MarkovModels(ratios, float("inf"))
    scored = rows.select("random", MarkovModels(ratios, 0.0).score(F.col("text")).alias("s"))
    cut = scored.agg(F.percentile(F.when(F.col("random"), F.col("s")), F.lit(missed)).alias("low"), F.percentile(F.when(~F.col("random"), F.col("s")), F.lit(0.999)).alias("high")).first()
    found = [x for x in (cut["low"], cut["high"]) if x is not None]
    return MarkovModels(ratios, max(0.0, sum(found) / len(found)))


def scan(df: DataFrame, models: MarkovModels, text_col: str = "text", to: str = "secrets") -> DataFrame:
    """``df`` with column ``to``: all spans (kind, start, end, hit) by start, then kind.

    Base spans are leftmost and non-overlapping within their kind; the models add tokens
    that overlap no base span.  A null text counts as empty: no spans.  A column named
    ``to`` is replaced, other columns stay as they are; repeated rows give repeated results.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign = F.filter(spans.matches(text, ASSIGN, 0), lambda s: F.char_length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 12)
    base = F.concat(assign, spans.matches(text, ACCESS, 1, "AKIA"), spans.matches(text, HEX, 2))
    found = df.withColumn(to, F.struct(base.alias("base"), spans.matches(text, CANDIDATE, 3).alias("tokens")))
    free = spans.outside(F.col(to)["tokens"], F.col(to)["base"])
    more = F.filter(free, lambda s: models.score(s["hit"]) >= models.threshold)
    return found.withColumn(to, spans.ordered(F.col(to)["base"], more))
