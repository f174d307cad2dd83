"""Counts of words, pre-tokens, n-grams and pieces."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subspark.functions import text as T
from subspark.plans.store import stored


def doc_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, line_no, line, kept columns)."""
    return docs.select("doc_id", *keep, F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))


def tokens(lines: DataFrame, split=T.words) -> DataFrame:
    """lines with pos and token in the place of line."""
    rest = [c for c in lines.columns if c != "line"]
    return lines.select(*rest, F.posexplode(split(F.col("line"))).alias("pos", "token"))


def count(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def pretoken_vocab(lines: DataFrame, *by: str) -> DataFrame:
    return count(lines.select(*by, F.explode(T.pretokens(F.col("line"))).alias("token")), *by, "token")


def word_counts(lines: DataFrame) -> DataFrame:
    return count(lines.select(F.explode(T.words(F.col("line"))).alias("word")), "word")


def ngrams(lines: DataFrame, order: int = 4, overcount: bool = True) -> DataFrame:
    """n-grams of pre-tokens. Distinct pre-tokens are counted first, so that slices are made once for each."""
    return ngrams_weighted(pretoken_vocab(lines).withColumnRenamed("token", "word"), order, overcount)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt out over all tasks: a table of few bytes that makes many rows would else be read by one or two."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def merged(rows: DataFrame) -> DataFrame:
    """rows for a join that sorts and merges. Spark takes exploded rows, and those of Arrow functions, for as many as they were
    made from, and a stored table for no more than its compressed file; it would collect millions of them on the driver and
    broadcast them."""
    return rows.hint("merge")


def substring_counts(words: DataFrame, longest: int = 10, held_most: int = 1_000_000) -> DataFrame:
    """words: (word, n). (piece, n): for all substrings of up to `longest` characters, how often they occur. Tasks add up
    their words' substrings before they are sent."""

    def run(batches):
        held: dict[str, int] = {}

        def out():
            names, values = list(held), list(held.values())
            for low in range(0, len(names), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[low : low + 100_000], pa.string()), pa.array(values[low : low + 100_000], pa.int64())], names=["piece", "n"])

        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i in range(len(w)):
                    for j in range(i + 1, min(len(w), i + longest) + 1):
                        piece = w[i:j]
                        held[piece] = held.get(piece, 0) + n
                if len(held) > held_most:
                    yield from out()
                    held.clear()
        yield from out()

    found = spread(words.select("word", F.col("n").cast("long")).filter("word is not null and n is not null"), "word").mapInArrow(run, "piece string, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n"))


def ngrams_weighted(vocab: DataFrame, order: int = 8, overcount: bool = True) -> DataFrame:
    """vocab: (word, n). (ngram, n)."""
    found = spread(vocab, "word").select(F.explode(T.ngrams(F.col("word"), order, overcount)).alias("ngram"), "n")
    return found.groupBy("ngram").agg(F.sum("n").alias("n"))


def frequencies(vocab: DataFrame, counted: DataFrame) -> DataFrame:
    """vocab's words with their counts, 0 for words that don't occur."""
    return vocab.join(counted, "word", "left").select(*vocab.columns, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def kth_count(rows: DataFrame, by: str, most: int) -> float | int | None:
    """The largest value that comes after the `most` largest of column `by`, or None if there are no more: rows above it
    number `most` at most. Ranges of values narrow around it; no list of rows is sorted."""
    found = _kth(rows.select((-F.col(by)).alias("v")).filter("v is not null"), most + 1)
    return None if found is None else -found


def _kth(values: DataFrame, k: int, least: int = 5_000, shares: int = 50):
    """The k-th smallest of column v (from 1), or None if there are fewer."""
    inside = values
    while True:
        size, low, high = inside.agg(F.count("*"), F.min("v"), F.max("v")).first()
        if size < k:
            return None
        if low == high:
            return low
        if size <= least:
            return sorted(r.v for r in inside.collect())[k - 1]
        cuts = inside.agg(F.percentile_approx("v", [i / shares for i in range(shares)], 10_000)).first()[0]
        cuts = sorted({c for c in cuts if c < high} | {low})  # of values that occur; none is the largest
        place = F.lit(0)
        for c in cuts:
            place = place + (F.col("v") > c).cast("int")
        counted = dict(inside.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect())
        before, at = 0, 0
        while before + counted.get(at, 0) < k:
            before += counted.get(at, 0)
            at += 1
        inside = inside.filter(place == at)
        k -= before


def least_rows(rows: DataFrame, most: int, by: str, key: str) -> DataFrame:
    """The `most` rows of least `by`, equal ones in order of the distinct strings of `key`, by a condition on both."""
    if most <= 0:
        return rows.limit(0)
    last = _kth(rows.select(F.col(by).alias("v")), most)
    if last is None:
        return rows
    before = rows.filter(F.col(by) < last).count()
    end = _kth_string(rows.filter(F.col(by) == last).select(F.col(key).alias("s")), most - before)
    return rows.filter((F.col(by) < last) | ((F.col(by) == last) & (F.col(key) <= end)))


def _kth_string(strings: DataFrame, k: int, least: int = 5_000, step: int = 2) -> str:
    """The k-th smallest of column s; beginnings of it grow by `step` characters."""
    start, inside = "", strings
    while inside.limit(least + 1).count() > least:
        heads = inside.groupBy(F.substring("s", 1, len(start) + step).alias("head")).agg(F.count("*").alias("n")).collect()
        for head, n in sorted(heads):
            if k <= n:
                break
            k -= n
        start = head
        inside = inside.filter(F.substring("s", 1, len(start)) == start) if len(start) else inside.filter("s = ''")
        if inside.filter(F.char_length("s") > len(start)).limit(1).count() == 0:
            return start
    return sorted(r.s for r in inside.collect())[k - 1]


def top_words(counted: DataFrame, most: int) -> DataFrame:
    """(id, word, n): ids in falling order of count, then by word."""
    best = least_rows(counted.withColumn("cost", -F.col("n")), most, "cost", "word")
    return numbered(best, F.asc("cost"), F.asc("word")).select(F.col("id").cast("int").alias("id"), "word", "n")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """rows with id, their place in this order from 0. They are dealt out by ranges of it; a place is that in the range,
    behind the rows of all ranges before."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("range_of_row", F.spark_partition_id()), "ranges")
    before = F.sum("rows").over(Window.orderBy("range_of_row").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    offsets = dealt.groupBy("range_of_row").agg(F.count("*").alias("rows")).select("range_of_row", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range_of_row").orderBy(*order)) - 1
    return dealt.join(F.broadcast(offsets), "range_of_row").select(*rows.columns, (F.col("before") + place).alias("id"))


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """rows with id: their place in order of the distinct strings of `key`."""
    return numbered(rows, F.asc(key))


def piece_frequency(segmented: DataFrame) -> DataFrame:
    """segmented: (word, n, pieces). For each piece the counts of the words that contain it."""
    once = segmented.select(F.explode(F.array_distinct("pieces")).alias("piece"), "n")
    return once.groupBy("piece").agg(F.sum("n").alias("n"))


def merge(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Sum of several count tables."""
    return reduce(DataFrame.unionByName, tables).groupBy(*keys).agg(F.sum("n").alias("n"))


def concat(tables: list[DataFrame]) -> DataFrame:
    """All rows, with the number of the table they come from."""
    return reduce(DataFrame.unionByName, [t.withColumn("shard", F.lit(k)) for k, t in enumerate(tables)])
