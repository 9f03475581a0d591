"""An inverted index with positions, written once and read by the stems of a query.

A posting is a row (bucket, word, key, place, length): where a word stands in a text, and how
many words the text has.  A task writes the postings of its own texts, in folders by the bucket
of their word, so that no posting is shuffled and none is joined; the vocabulary, which tells the
words of a stem, is read back from them and stemmed once.  A query reads the folders of the words
of its stems.  Boolean queries merge the postings of a text, phrases intersect their positions,
ranks come from their counts: no text is read or stemmed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import stemming
from folioscope.operators import search

#: Folders that words are dealt to.
BUCKETS = 64
#: The folder of the rows that tell the lengths of texts: of no word, with the length as their place.
LENGTHS = -1


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


class Index:
    """Postings and lengths of texts, and their vocabulary, below a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def write(self, rows: DataFrame, key: str, text: str) -> Index:
        """Indexes the texts of ``rows``, each under its key; null texts aren't indexed."""
        read = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), search.words_of(F.col(text)).alias("words"))
        # no word is empty, so the empty one after the last has the length as its place
        places = read.select("key", F.size("words").alias("length"), F.posexplode(F.array_append("words", F.lit(""))).alias("place", "word"))
        bucket = F.when(F.col("word") == "", F.lit(LENGTHS)).otherwise(_bucket(F.col("word"), self.buckets))
        places.select(bucket.alias("bucket"), "word", "key", "place", "length").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings")
        # each word of the vocabulary is stemmed once
        stems = stemming.vocabulary(self._postings().where(F.col("bucket") != LENGTHS), "word")
        stems.select(_bucket(F.col("stem"), self.buckets).alias("bucket"), "stem", "word").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/words")
        return self

    def _postings(self) -> DataFrame:
        return self.spark.read.schema("word string, key string, place int, length int, bucket int").parquet(f"{self.folder}/postings")

    def _buckets(self, words: DataFrame, column: str) -> list[int]:
        """Buckets of the values of a column, as many as there are at most."""
        return sorted(r[0] for r in words.select(_bucket(F.col(column), self.buckets)).distinct().collect())

    def postings(self, stems: list[str]) -> DataFrame:
        """Postings (stem, key, place, length) of some stems, from the folders of their words alone."""
        asked = self._buckets(self.spark.createDataFrame([(s,) for s in stems], "stem string"), "stem")
        words = self.spark.read.schema("stem string, word string, bucket int").parquet(f"{self.folder}/words")
        words = words.where(F.col("bucket").isin(*asked) & F.col("stem").isin(*stems)).select("stem", "word")
        rows = self._postings().where(F.col("bucket").isin(*self._buckets(words, "word")))
        return rows.join(words, "word").select("stem", "key", "place", "length")

    def _texts(self) -> DataFrame:
        """(key, length) of all texts."""
        return self._postings().where(F.col("bucket") == LENGTHS).select("key", "length")

    def search(self, query: str) -> DataFrame:
        """(key, relevance) of the texts that meet a query."""
        parsed = search.parse(query)
        stems = sorted({w for c in parsed for _, words in c for w in words})
        if not stems:
            return self.spark.createDataFrame([], "key string, relevance double")
        column = {w: f"at{k}" for k, w in enumerate(stems)}
        at = [F.sort_array(F.collect_list(F.when(F.col("stem") == w, F.col("place")))).alias(c) for w, c in column.items()]
        found = self.postings(stems).groupBy("key").agg(*at, F.max("length").alias("length"))
        if any(not any(wanted for wanted, _ in c) for c in parsed):
            # an alternative that asks for nothing is met by texts without any posting
            found = self._texts().join(found.drop("length"), "key", "left")
            found = found.select("key", "length", *(F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in column.values()))
        hits = sum((F.size(column[w]) for w in search.named_stems(query)), F.lit(0))
        return found.where(search.meets(query, lambda words: _stands([F.col(column[w]) for w in words]))).select("key", search.rank(hits, F.col("length")).alias("relevance"))


def _stands(places: list[Column]) -> Column:
    """Whether a word, or the words of a phrase next to each other, stand in a text."""
    if len(places) == 1:
        return F.size(places[0]) > 0

    def followed(p: Column) -> Column:
        out = F.lit(True)
        for k, after in enumerate(places[1:], 1):
            out = out & F.array_contains(after, p + k)
        return out

    return F.exists(places[0], followed)
