"""Inputs that the registered queries share, from the provided tables.

lines: documents.text split at line feeds. tokens: all that stands between white space in them, with
counts; segmentation by scores, language models and decoders take these. words: the commonest tokens, as
many as there are embeddings, with id = rank - 1 and the embedding of that id: a word without a vector
can't take part in what needs vectors. The projection is the same matrix. vocabulary: the commonest VOCABULARY
tokens, for what needs a fixed word vocabulary without vectors. Edges: all substrings of up to LONGEST code
points of each word, as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subspark.functions import text as T
from subspark.operators import cooc, counts, linalg, lm, viterbi
from subspark.plans.store import stored

LONGEST, VOCABULARY = 10, 50_000


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = stored(make(), name)
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lines(self, *keep: str) -> DataFrame:
        docs = self.table("documents").select("doc_id", "text", *keep)
        if len(docs.inputFiles()) < self.spark.sparkContext.defaultParallelism:
            docs = counts.spread(docs)  # a small file is read by one task
        return counts.doc_lines(docs, *keep)

    def word_counts(self) -> DataFrame:
        return counts.word_counts(self.lines())

    def tokens(self) -> DataFrame:
        """(word, n), counted once: all else starts from it."""
        return self._once("tokens", self.word_counts)

    def vectors(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.col("vec_id").cast("int").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))

    def words(self) -> DataFrame:
        """(id, word, n, vec)"""

        def make():
            top = counts.top_words(self.tokens(), self.table("embeddings").count())
            return top.join(self.vectors(), "id").select("id", "word", "n", "vec")

        return self._once("words", make)

    def vocabulary(self) -> DataFrame:
        """(id, word, n)"""
        return self._once("vocabulary", lambda: counts.top_words(self.tokens(), VOCABULARY))

    def edges(self, words: DataFrame | None = None) -> DataFrame:
        """(subword, word, weight)"""
        words = self.words() if words is None else words
        return words.select(F.explode(T.substrings(F.col("word"), LONGEST)).alias("subword"), "word", F.lit(1.0).alias("weight"))

    def subwords(self) -> DataFrame:
        """(subword, id): the distinct substrings in order."""

        def make():
            return counts.ranked(self.edges().select("subword").distinct(), "subword").withColumn("id", F.col("id").cast("int"))

        return self._once("subwords", make)

    def pieces(self) -> DataFrame:
        """(subword, id): the distinct substrings of all tokens in order."""

        def make():
            return counts.ranked(self.piece_counts().select(F.col("piece").alias("subword")), "subword")

        return self._once("pieces", make)

    def projection(self) -> DataFrame:
        return linalg.long_form(self.vectors())

    def cooc(self, window: int = 3, words: DataFrame | None = None) -> DataFrame:
        words = self.words() if words is None else words
        return cooc.word_word(self.lines(), words.select("word", "id"), window)

    def stats(self) -> DataFrame:
        ids = self.words().select("word", F.col("id").alias("word_id"))
        return cooc.edges_times_cooc(self.edges().join(ids, "word"), self.cooc())

    def embeddings(self) -> DataFrame:
        """(subword, vec)"""
        words = self.words()
        return linalg.subword_embeddings(self.stats(), self.subwords(), self.projection(), words.count())

    def piece_counts(self) -> DataFrame:
        """(piece, n): the substrings of all tokens, and how often they stand in words."""
        return self._once("piece_counts", lambda: counts.substring_counts(self.tokens(), LONGEST))

    def piece_scores(self) -> DataFrame:
        """(piece, score): log share of each substring among all, by how often it stands in words."""
        sums = self.piece_counts()
        total = sums.agg(F.sum("n").alias("total"))
        return sums.crossJoin(F.broadcast(total)).select("piece", F.round(F.log(F.col("n") / F.col("total")), 9).alias("score"))

    def scores(self) -> DataFrame:
        return self._once("scores", self.piece_scores)

    def segmented(self, mode: str = "sum") -> DataFrame:
        """(word, n, pieces, score), decoded once."""

        def make():
            return viterbi.best_cuts(self.tokens(), self.scores(), mode, False, LONGEST)

        return self._once(f"segmented-{mode}", make)

    def unigrams(self) -> DataFrame:
        return lm.unigrams(self.segmented())

    def bigrams(self) -> DataFrame:
        return lm.bigrams(self.segmented())
