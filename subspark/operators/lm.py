"""Counts of pieces and pairs of pieces, and language models from them, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subspark.functions import text as T
from subspark.operators.counts import merged

WORD, WORD_END, BOUNDARY = "<w>", "</w>", "###"


def unigrams(segmented: DataFrame) -> DataFrame:
    """segmented: (word, n, pieces). (token, n), with the number of words under the word mark."""
    found = segmented.select(F.explode("pieces").alias("token"), "n")
    marks = segmented.select(F.lit(WORD).alias("token"), "n")
    return found.unionByName(marks).groupBy("token").agg(F.sum("n").cast("long").alias("n"))


def with_vocab(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """vocab: (token). A row for each of its tokens, 0 for those without counts."""
    return vocab.join(merged(counts), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def inside(segmented: DataFrame, vocab: DataFrame) -> DataFrame:
    """Pieces of the vocabulary only; those around a piece that isn't become neighbours."""
    at = segmented.select("word", "n", F.posexplode("pieces").alias("pos", "token"))
    kept = at.join(vocab.select("token"), "token", "left_semi")
    return kept.groupBy("word", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("pieces"))


def bigrams(segmented: DataFrame, mark: str = WORD, close: str | None = None) -> DataFrame:
    """(prev, token, n) with the mark before each word, and `close` behind it if given."""
    ends = [F.array(F.lit(close))] if close else []
    items = F.concat(F.array(F.lit(mark)), F.col("pieces"), *ends)
    pair = segmented.select(F.explode(T.pairs(items)).alias("p"), "n")
    return pair.groupBy("p.prev", "p.token").agg(F.sum("n").cast("long").alias("n")).select("prev", "token", "n")


def folded(counts: DataFrame, vocab: DataFrame, unknown: str = "<unk>") -> DataFrame:
    """counts: (prev, token, n), vocab: (token). Counts with all tokens that the vocabulary lacks as one."""
    known = vocab.select(F.col("token").alias("known")).distinct()
    out = counts.join(known, F.col("prev") == F.col("known"), "left").select(F.coalesce("known", F.lit(unknown)).alias("prev"), "token", "n")
    out = out.join(known, F.col("token") == F.col("known"), "left").select("prev", F.coalesce("known", F.lit(unknown)).alias("token"), "n")
    return out.groupBy("prev", "token").agg(F.sum("n").alias("n"))


def bigram_observations(segmented: DataFrame) -> DataFrame:
    """One (prev, token) row for each pair, with the boundary before the first piece and none behind the last."""
    items = F.concat(F.array(F.lit(BOUNDARY)), F.col("pieces"))
    return segmented.select(F.explode(T.pairs(items)).alias("p")).select("p.prev", "p.token")


def next_edges(segmented: DataFrame) -> DataFrame:
    """(subword, word, weight): one row for each occurrence of a piece in a word's segmentation."""
    return segmented.select(F.explode("pieces").alias("subword"), "word", F.lit(1.0).alias("weight"))


def used(vocab: DataFrame, edges: DataFrame) -> DataFrame:
    """vocab: (subword). Those that some word still uses."""
    return vocab.join(merged(edges.select("subword").distinct()), "subword", "left_semi")


def model(counts: DataFrame, n_vocab: int, add_one: bool = False) -> DataFrame:
    """(prev, token, logp, default_logp): log of the count over the row's sum plus n_vocab; with add_one, count + 1."""
    total = F.log(F.sum("n").over(Window.partitionBy("prev")) + n_vocab)
    logp = F.log(F.col("n") + (1 if add_one else 0)) - total
    return counts.select("prev", "token", logp.alias("logp"), (-total).alias("default_logp"))


def backoff_scores(pairs: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """pairs: (prev, token). Adds score: of a known prev, log of (pair + 1) / prev, which isn't normalised; of another,
    log of token / all; of an unknown token after such, -log of all. Counts of 0 are unknown."""
    total = one.agg(F.sum("n").alias("total"))
    some = one.filter("n > 0")
    joined = (
        pairs.join(merged(some.select(F.col("token").alias("prev"), F.col("n").alias("n_prev"))), "prev", "left")
        .join(merged(some.select("token", F.col("n").alias("n_token"))), "token", "left")
        .join(merged(two.select("prev", "token", F.col("n").alias("n_pair"))), ["prev", "token"], "left")
        .crossJoin(F.broadcast(total))  # one row
    )
    score = (
        F.when(F.col("n_prev").isNotNull(), F.log((F.coalesce("n_pair", F.lit(0)) + 1) / F.col("n_prev")))
        .when(F.col("n_token").isNotNull(), F.log(F.col("n_token") / F.col("total")))
        .otherwise(-F.log("total"))
    )
    return joined.select("prev", "token", score.alias("score"))


def uniform(vocab_size: int) -> float:
    """Log probability under the uniform model."""
    from math import log

    return -log(vocab_size)


def posteriors(lm: DataFrame) -> DataFrame:
    """lm: (prev, token, logp). (token, score): log of the sum of a token's probabilities over all prev."""
    top = lm.groupBy("token").agg(F.max("logp").alias("top"))
    joined = lm.join(merged(top), "token")
    return joined.groupBy("token").agg((F.max("top") + F.log(F.sum(F.exp(F.col("logp") - F.col("top"))))).alias("score"))


def bottom(counts: DataFrame, most: int, by: str = "n", key: str = "token") -> DataFrame:
    """The `most` rows of least count among tokens of over one character."""
    from subspark.operators.counts import least_rows

    return least_rows(counts.filter((F.char_length(key) > 1) & (F.col(key) != BOUNDARY)), most, by, key)


def reduced(vocab: DataFrame, lm: DataFrame, keep: int) -> DataFrame:
    """vocab: (id, token). What is left in order of id when the tokens of lowest posterior score go; single characters
    and the boundary stay. Tokens without a score go first."""
    size = vocab.count()
    scored = vocab.join(merged(posteriors(lm)), "token", "left")
    gone = bottom(scored.withColumn("score", F.coalesce("score", F.lit(-1e300))), max(0, size - keep), "score")
    return vocab.join(gone.select("token"), "token", "left_anti")


def dot_product_model(embeddings: DataFrame, weights: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """embeddings, weights: (token, vec). (prev, token, logp): log softmax of the products of prev's embedding with all
    weights, for `pairs` (prev, token). Without pairs, for all: that is a table for vocabularies of thousands."""
    from subspark.operators.estimator import pair_scores

    if pairs is None:
        each = weights.select("token")
        pairs = embeddings.select(F.col("token").alias("prev")).join(F.broadcast(each) if each.count() <= 100_000 else each, F.lit(True))
    return pair_scores(pairs, embeddings, weights)


def closed_form(embeddings: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, vec): weights W of least squares, E W = log(counts + 1). With G = E'E summed by Spark, W = G^-1 E' L:
    only the small Gram matrix is inverted on the driver. Constants of a row cancel in the softmax."""
    from subspark.operators.linalg import long_form, pseudo_inverse, to_vectors

    inverse = pseudo_inverse(embeddings.withColumnRenamed("token", "id")).withColumnRenamed("id", "prev")
    logs = counts.select("prev", "token", F.log(F.col("n") + 1).alias("l"))
    long = logs.join(inverse, "prev").groupBy("token", "dim").agg(F.sum(F.col("l") * F.col("x")).alias("x"))
    dims = long_form(embeddings, "token").select("dim").distinct()
    full = embeddings.select("token").crossJoin(F.broadcast(dims)).join(long, ["token", "dim"], "left")  # some hundred dimensions
    return to_vectors(full.withColumn("x", F.coalesce("x", F.lit(0.0))), "token")
