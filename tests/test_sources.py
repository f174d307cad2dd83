import pytest
from pyspark.sql import functions as F

from subspark.functions import text as T
from subspark.sources import readers as R
from subspark.sources import sinks as S


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_vocab(spark, tmp_path):
    path = put(tmp_path, "v", "b\na\nc\n")
    assert rows(R.vocab(spark, path)) == [(0, "b"), (1, "a"), (2, "c")]
    assert rows(R.vocab(spark, path, "###")) == [(0, "###"), (1, "b"), (2, "a"), (3, "c")]
    with pytest.raises(ValueError):
        R.vocab(spark, put(tmp_path, "w", "a\nb\na\n"))


def test_word2vec_and_matrix(spark, tmp_path):
    path = put(tmp_path, "e", "2 3\na 1 2 3.5\nb 0 -1 1e-2 \n")
    assert rows(R.word2vec(spark, path)) == [(0, "a", [1.0, 2.0, 3.5]), (1, "b", [0.0, -1.0, 0.01])]
    with pytest.raises(ValueError):
        R.word2vec(spark, put(tmp_path, "bad", "2 3\na 1 2 3\nb 1 2\n"))
    names = R.vocab(spark, put(tmp_path, "n", "x\ny\n"))
    m = put(tmp_path, "m", "1 2\n3 4\n")
    assert [(r.token, r.vec) for r in R.matrix(spark, m, names).orderBy("id").collect()] == [("x", [1.0, 2.0]), ("y", [3.0, 4.0])]
    assert rows(R.projection(spark, m)) == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]
    assert rows(R.dense_counts(spark, put(tmp_path, "d", "0 2\n1 0\n"))) == [(0, 1, 2), (1, 0, 1)]
    with pytest.raises(ValueError):
        R.matrix(spark, put(tmp_path, "m3", "1\n2\n3\n"), names)


def test_edges(spark, tmp_path):
    assert rows(R.edges(spark, put(tmp_path, "a", "word w wo w\n\nx x\n"))) == [("word", "w", 1.0), ("word", "w", 1.0), ("word", "wo", 1.0), ("x", "x", 1.0)]
    assert rows(R.weighted_edges(spark, put(tmp_path, "b", "word w 0.2 wo 0.1 word 0.4 rd 0.1\n"))) == [("word", "rd", 0.1), ("word", "w", 0.2), ("word", "wo", 0.1), ("word", "word", 0.4)]
    assert rows(R.segmented_vocab(spark, put(tmp_path, "c", "word wo r d\n"), True)) == [("word", ["wo", "##r", "##d"])]


def test_counts(spark, tmp_path):
    assert rows(R.word_counts(spark, put(tmp_path, "a", 'a\t2\n"q\t1\na\t3\n'))) == [('"q', 1), ("a", 5)]
    assert rows(R.bigrams(spark, put(tmp_path, "b", "a b 2\na b 1\nx\n"))) == [("a", "b", 3)]
    assert rows(R.bigram_observations(spark, put(tmp_path, "c", "a\tb\na\nb\tc\td\n"))) == [("a", "b")]
    assert rows(R.sparse_triples(spark, put(tmp_path, "d", "0 1 5\n"))) == [(0, 1, 5)]


def test_round_trips(spark, tmp_path):
    e = R.word2vec(spark, put(tmp_path, "e", "2 2\nb 1 2\na 3 4\n"))
    S.word2vec(e, str(tmp_path / "out"))
    assert rows(R.word2vec(spark, str(tmp_path / "out"))) == rows(e)
    seg = spark.createDataFrame([("ab", ["a", "b"]), ("c", ["c"])], "word string, pieces array<string>")
    S.segmentations(seg, str(tmp_path / "seg"))
    assert rows(R.segmented_vocab(spark, str(tmp_path / "seg"))) == rows(seg)
    counts = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "word string, n bigint")
    S.counts(counts, str(tmp_path / "n"))
    assert rows(R.word_counts(spark, str(tmp_path / "n"))) == rows(counts)


def test_sentencepiece(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    words = spark.createDataFrame([("unbelievable",), ("cat",)], "word string")
    once = R.sentencepiece_edges(words, tokenizers.path("piece_bpe_32k.model"))
    assert all("".join(r.pieces) == r.word for r in once.collect())
    drawn = R.sentencepiece_edges(words, tokenizers.path("piece_bpe_32k.model"), draws=3)
    assert drawn.count() == 6


def test_numbers_follow_files_and_lines(spark, tmp_path):
    """The smallest file first, and files of several blocks."""
    (tmp_path / "many").mkdir()
    lines = []
    for k, n in enumerate((1, 3000, 0, 500)):
        own = [f"line {k} {i}" for i in range(n)]
        (tmp_path / "many" / f"part-{k}").write_text("".join(f"{x}\n" for x in own))
        lines += own
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = sorted(map(tuple, R.numbered(spark, str(tmp_path / "many")).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(lines))
    assert R.numbered(spark, put(tmp_path, "none", "")).collect() == []


def slow_bucket(word, n):
    h = 2166136261
    for b in word.encode():
        h = (h ^ (b | 0xFFFFFF00 if b > 127 else b)) * 16777619 % 2**32
    return h % n


def test_buckets(spark):
    words = ["", "a", "ab", "é", "straße", "中文", "x" * 50]
    table = spark.createDataFrame([(w,) for w in words], "subword string")
    found = {r.subword: r.b for r in table.select("subword", T.bucket(F.col("subword"), 1000).alias("b")).collect()}
    assert found == {w: slow_bucket(w, 1000) for w in words}
    buckets = spark.createDataFrame([(i, [float(i)]) for i in range(1000)], "id int, vec array<double>")
    got = {r.subword: r.vec for r in R.bucket_vectors(table, buckets, 1000).collect()}
    assert got == {w: [float(found[w])] for w in words}


def test_npy(spark, tmp_path):
    import numpy as np

    found = np.random.default_rng(0).normal(size=(20, 3))
    np.save(tmp_path / "m.npy", found)
    assert [r.vec for r in R.npy(spark, str(tmp_path / "m.npy")).orderBy("id").collect()] == found.tolist()


def test_unknown_edges(spark):
    edges = spark.createDataFrame([("ab", "a", 1.0), ("ab", "q", 1.0), ("no", "a", 1.0), ("no", "q", 1.0)], "word string, subword string, weight double")
    words, subwords = spark.createDataFrame([("ab",)], "word string"), spark.createDataFrame([("a",)], "subword string")
    assert rows(R.unknown_edges(edges, words, subwords)) == [("subword", "ab", "q"), ("word", "no", None)]


def test_sentencepiece_start(spark, tmp_path):
    model = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    words = spark.createDataFrame([("unbelievable",), ("cats",)], "word string")
    S.sentencepiece_start(words, model, str(tmp_path))
    vocab = {r.line for r in R.lines(spark, str(tmp_path / "spvocab")).collect()}  # some pieces end in a carriage return
    start = {r.word: r.pieces for r in R.segmented_vocab(spark, str(tmp_path / "allowed.init")).collect()}
    assert set(start) == {"unbelievable", "cats"} and all("".join(p) == w and set(p) <= vocab for w, p in start.items())
    counted = R.sampled_piece_counts(words, model, draws=4).collect()
    for word in start:
        assert sum(len(r.subword) * r.n for r in counted if r.word == word) == 4 * len(word)


def test_word2vec_training(spark):
    lines = spark.createDataFrame([("a b c d",)] * 20, "line string")
    got = R.trained_word2vec(lines, dim=5, most=3, epochs=1)
    assert sorted(r.word for r in got.collect()) == ["a", "b", "c"] and len(got.first().vec) == 5
