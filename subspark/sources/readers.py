"""Readers of the text formats; each gives a typed table with explicit ids where a file's order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subspark.functions import text as T

FIELD = r"\s+"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): order isn't kept."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(id, line): ids follow the lines from 0, through all files of a folder in order of their names. A line's id is its
    place in its block of a file, behind the lines of the blocks before."""
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = spark.read.text(path).select(F.col("value").alias("line"), *block, F.monotonically_increasing_id().alias("place"))
    sizes = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    offsets = sizes.select("file", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(offsets, ["file", "start"]).select((F.col("place") + F.col("shift")).alias("id"), "line")


def _unique(rows: DataFrame, key: str, what: str) -> DataFrame:
    twice = rows.groupBy(key).count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"{what}: {twice[0]!r} stands there twice")
    return rows


def vocab(spark: SparkSession, path: str, boundary: str | None = None) -> DataFrame:
    """(id, token), one a line. Raises on tokens that repeat. With a boundary that the file lacks, it gets id 0."""
    rows = _unique(numbered(spark, path).select("id", F.col("line").alias("token")), "token", path)
    if boundary is None or rows.filter(F.col("token") == boundary).count():
        return rows
    first = spark.createDataFrame([(0, boundary)], rows.schema)
    return first.unionByName(rows.withColumn("id", F.col("id") + 1))


def _vector(fields, start: int):
    return F.transform(F.slice(fields, start, F.greatest(F.size(fields) - (start - 1), F.lit(0))), lambda x: x.cast("double"))


def word2vec(spark: SparkSession, path: str) -> DataFrame:
    """(id, word, vec) of word2vec's text format; the first line has the numbers of words and dimensions."""
    rows = numbered(spark, path)
    fields = F.split(T.trim_end(F.col("line")), FIELD)
    found = rows.filter("id > 0").select((F.col("id") - 1).alias("id"), fields[0].alias("word"), _vector(fields, 2).alias("vec"))
    head = rows.filter("id = 0").select(fields.alias("f")).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    n, dim = map(int, head.f)
    bad = found.filter(F.size("vec") != dim).first()
    if bad is not None or found.count() != n:
        raise ValueError(f"{path}: not {n} words of {dim} dimensions")
    return _unique(found, "word", path)


def matrix(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """(id, vec), a row a line; with names (id, token), (id, token, vec), and an error where the sizes differ."""
    rows = numbered(spark, path).select("id", _vector(F.split(F.trim("line"), FIELD), 1).alias("vec"))
    if names is None:
        return rows
    if rows.count() != names.count():
        raise ValueError(f"{path}: as many rows as names are needed")
    return names.join(rows, "id")


def projection(spark: SparkSession, path: str) -> DataFrame:
    """(id, dim, x) of a file that has a line for each dimension and a column for each word."""
    rows = matrix(spark, path).select(F.col("id").cast("int").alias("dim"), F.posexplode("vec").alias("id", "x"))
    return rows.select("id", "dim", "x")


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(word, subword, weight) of `word s1 s2 ...`; repeats stay."""
    t = F.split(F.trim("line"), FIELD)
    rows = lines(spark, path).select(t.alias("t")).filter(F.size("t") > 1)
    return rows.select(F.col("t")[0].alias("word"), F.explode(F.expr("slice(t, 2, size(t) - 1)")).alias("subword"), F.lit(1.0).alias("weight"))


def weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """(word, subword, weight) of `word s1 w1 s2 w2 ...`."""
    t = F.split(F.trim("line"), FIELD)
    rows = lines(spark, path).select(t.alias("t")).filter(F.size("t") > 2)
    pairs = F.expr("transform(sequence(1, size(t) - 2, 2), i -> struct(t[i] as subword, cast(t[i + 1] as double) as weight))")
    return rows.select(F.col("t")[0].alias("word"), F.explode(pairs).alias("e")).select("word", "e.subword", "e.weight")


def segmented_vocab(spark: SparkSession, path: str, wordpiece: bool = False) -> DataFrame:
    """(word, pieces) of `word seg1 seg2 ...`; with wordpiece, later pieces get ## in front."""
    t = F.split(F.trim("line"), FIELD)
    rows = lines(spark, path).select(t.alias("t")).filter(F.size("t") > 1)
    pieces = F.expr("slice(t, 2, size(t) - 1)")
    if wordpiece:
        pieces = F.transform(pieces, lambda p, i: F.when(i > 0, F.concat(F.lit("##"), p)).otherwise(p))
    return rows.select(F.col("t")[0].alias("word"), pieces.alias("pieces"))


def _tsv(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema=schema, quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """(word, n); counts of a word that repeats add up."""
    return _tsv(spark, path, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def unigrams(spark: SparkSession, path: str) -> DataFrame:
    return word_counts(spark, path).withColumnRenamed("word", "token")


def bigrams(spark: SparkSession, path: str) -> DataFrame:
    """(prev, token, n) of lines of three fields."""
    t = F.split("line", FIELD)
    rows = lines(spark, path).select(t.alias("t")).filter(F.size("t") == 3)
    found = rows.select(F.col("t")[0].alias("prev"), F.col("t")[1].alias("token"), F.col("t")[2].cast("long").alias("n"))
    return found.groupBy("prev", "token").agg(F.sum("n").alias("n"))


def bigram_observations(spark: SparkSession, path: str) -> DataFrame:
    """(prev, token); lines without exactly two fields are passed over."""
    rows = lines(spark, path).select(F.split("line", "\t").alias("t")).filter(F.size("t") == 2)
    return rows.select(F.col("t")[0].alias("prev"), F.col("t")[1].alias("token"))


def sparse_triples(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "i int, j int, n bigint", " ")


def dense_counts(spark: SparkSession, path: str) -> DataFrame:
    """(id, col_id, n) of rows of counts; zeros are left out."""
    rows = matrix(spark, path).select("id", F.posexplode("vec").alias("col_id", "n"))
    return rows.filter("n > 0").withColumn("n", F.col("n").cast("long"))


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec) of a two-dimensional .npy file; the format has no parts, so that one task reads it."""
    import io

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                found = np.load(io.BytesIO(raw), allow_pickle=False).astype(float)
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(range(k, k + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float64()))], names=["id", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, vec array<double>")


def unknown_edges(edges_: DataFrame, words: DataFrame, subwords: DataFrame) -> DataFrame:
    """edges: (word, subword). What a 0/1 matrix of known words and subwords leaves out: (kind, word, subword) of words
    that aren't in words (word), with a null subword, and of subwords of known words that aren't in subwords (subword)."""
    known = edges_.join(words.select("word"), "word", "left_semi")
    no_word = edges_.select("word").distinct().join(words.select("word"), "word", "left_anti")
    no_subword = known.select("word", "subword").distinct().join(subwords.select("subword"), "subword", "left_anti")
    return no_word.select(F.lit("word").alias("kind"), "word", F.lit(None).cast("string").alias("subword")).unionByName(
        no_subword.select(F.lit("subword").alias("kind"), "word", "subword")
    )


def bucket_vectors(subwords: DataFrame, buckets: DataFrame, n: int) -> DataFrame:
    """subwords: (subword); buckets: (id, vec), the n hash buckets of a FastText model. (subword, vec)."""
    keyed = subwords.select("subword", T.bucket(F.col("subword"), n).alias("id"))
    return keyed.join(buckets.select("id", "vec"), "id").select("subword", "vec")


def sentencepiece_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a SentencePiece model: its pieces without marks, each once."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = spark.createDataFrame([(i, model.id_to_piece(i)) for i in range(model.get_piece_size())], "id int, piece string")
    cleaned = rows.select("id", F.explode(T.clean_pieces(F.array("piece"))).alias("piece"))
    return cleaned.groupBy("piece").agg(F.min("id").alias("id")).select("id", "piece")


def sampled_piece_counts(words: DataFrame, path: str, draws: int = 10, alpha: float = 0.1, seed: int = 0) -> DataFrame:
    """words: (word). (subword, word, n): how often each piece stands in `draws` sampled segmentations of a word."""
    drawn = sentencepiece_edges(words, path, draws, alpha, seed)
    return drawn.select(F.explode("pieces").alias("subword"), "word").groupBy("subword", "word").agg(F.count("*").alias("n"))


def sentencepiece_edges(words: DataFrame, path: str, draws: int = 0, alpha: float = 0.1, seed: int = 0) -> DataFrame:
    """words: (word). (word, pieces) by a SentencePiece model, without marks; with draws, so many sampled ones each."""
    import pyarrow as pa

    with open(path, "rb") as f:
        shared = words.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                if not draws:
                    out.append((word, model.encode(word, out_type=str)))
                for k in range(draws):
                    sentencepiece.set_random_generator_seed((hash_of(word) + seed * draws + k) % 2**31)
                    out.append((word, model.encode(word, out_type=str, enable_sampling=True, alpha=alpha, nbest_size=-1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in out], pa.string()), pa.array([p for _, p in out], pa.list_(pa.string()))], names=["word", "pieces"]
            )

    def hash_of(word):
        import zlib

        return zlib.crc32(word.encode())

    return words.select("word").mapInArrow(run, "word string, pieces array<string>").withColumn("pieces", T.clean_pieces(F.col("pieces")))


def trained_word2vec(lines_: DataFrame, dim: int = 200, most: int = 200_000, epochs: int = 10, window: int = 3, seed: int = 0) -> DataFrame:
    """(id, word, vec) by Spark's skip-gram Word2Vec over the `most` commonest words. It has no subword buckets and no
    output matrix, so a projection has to come from the co-occurrence counts."""
    from pyspark.ml.feature import Word2Vec

    from subspark.operators.counts import top_words, word_counts

    best = top_words(word_counts(lines_), most)
    kept = lines_.select(T.words(F.col("line")).alias("ws"))
    model = Word2Vec(vectorSize=dim, maxIter=epochs, windowSize=window, minCount=1, seed=seed, inputCol="ws", outputCol="v").fit(kept)
    from pyspark.ml.functions import vector_to_array

    return best.join(model.getVectors().select("word", vector_to_array("vector").alias("vec")), "word").select("id", "word", "vec")
