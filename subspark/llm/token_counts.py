"""Token counts by joining distinct pre-tokens to their frequencies in each document.

Frequent pre-tokens come from a sample (`SAMPLE` of the rows): at most `HEAD` of them, each of at most
`HEAD_CHARS` characters, with their piece counts, are broadcast, and documents add those up on the spot.
Which pre-tokens these are changes the work only, not the counts. All others go out as (document,
pre-token, times) rows; their distinct pre-tokens are counted once each, in as many tasks as there are,
and joined back, and a document's counts are summed. Ids are never kept or sent.

Nulls: a null text is empty and has 0 tokens. A null doc_id stays null. Repeated rows each get a row. An empty
table gives no rows. A very long text is cut into pre-tokens as a whole in its task, and its rows go out in
parts. Ids may have any type; extra columns aren't read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subspark.llm import pieces as P
from subspark.llm.common import arrow_schema, doc_key, stored

SAMPLE = 0.05
HEAD, HEAD_CHARS = 200_000, 32
LIMIT = 2048
#: Distinct pre-tokens that a task counts before it sends them on.
FLUSH = 100_000


def _batches(rows, names, size=20_000):
    for k in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + size], strict=True)], names=names)


def head_of(docs: DataFrame, spec) -> dict[str, int]:
    """The sample's most frequent pre-tokens and their piece counts."""

    def count(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0):
                for some in P.words(text.as_py() or ""):
                    seen.update(w if len(w) <= HEAD_CHARS else "" for w in map(lambda w: P.core(w)[0], some))
                if len(seen) > FLUSH:
                    yield from _batches(list(seen.items()), ["word", "n"])
                    seen = Counter()
        yield from _batches(list(seen.items()), ["word", "n"])

    sample = docs.select("text").sample(SAMPLE, seed=7).mapInArrow(count, "word string, n long")
    words = stored(sample.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # the least number of times of which at most HEAD pre-tokens have as many: there are few such numbers
    most, taken = None, 0
    for row in words.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        taken += row["count"]
        if taken > HEAD:
            break
        most = row.n
    found = [] if most is None else [r.word for r in words.filter(F.col("n") >= most).select("word").collect()]
    return dict(zip(found, (len(x) // 4 for x in P.pieces(spec).encode(found)), strict=True))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each document."""
    spark = docs.sparkSession
    spec = P.read(path)
    shared = spark.sparkContext.broadcast((spec, head_of(docs, spec)))
    k1, k2 = doc_key(F.col("doc_id"), F.col("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"k1 long, k2 long, doc_id {kind}, n_bytes long, word string, n long"

    def frequencies(batches):
        """One row for each document, with n the tokens of frequent pre-tokens, and one for each other pre-token.
        A document's own row has a word with a space in front, which is no pre-token: it joins nothing."""
        spec, head = shared.value
        signs = {"": 0}
        for batch in batches:
            rows = []
            ids, texts, a, b = (batch.column(k).to_pylist() for k in range(4))
            for doc_id, text, x, y in zip(ids, texts, a, b, strict=True):
                seen, total, rare = Counter(), 0, Counter()
                for some in P.words(text or ""):
                    seen.update(some)
                for word, n in seen.items():
                    count = head.get(word)
                    if count is None:
                        word, after = P.core(word)
                        if after not in signs:
                            signs[after] = len(P.pieces(spec).encode([after])[0]) // 4
                        total += n * signs[after]
                        if len(signs) > FLUSH:
                            signs = {"": 0}
                        count = head.get(word)
                    if count is None:
                        rare[word] += n
                    else:
                        total += n * count
                rows.append((x, y, doc_id, len((text or "").encode()), f" {x}", total))
                rows.extend((x, y, None, None, w, n) for w, n in rare.items())
                if len(rows) > 20_000:
                    yield typed(rows)
                    rows = []
            if rows:
                yield typed(rows)

    kinds = arrow_schema(schema)

    def typed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    rows = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2")).mapInArrow(frequencies, schema)

    def counted(batches):
        encode = P.pieces(shared.value[0]).encode
        for batch in batches:
            found = [len(x) // 4 for x in encode(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["word", "pieces"])

    rare = rows.filter(F.col("n_bytes").isNull()).select("word").distinct().mapInArrow(counted, "word string, pieces long")
    joined = rows.join(rare, "word", "left")
    own = F.col("n_bytes").isNotNull()
    sums = joined.groupBy("k1", "k2").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_bytes").alias("n_bytes"),
        F.sum(F.when(own, F.col("n")).otherwise(F.col("n") * F.col("pieces"))).alias("total"),
        F.sum(own.cast("long")).alias("times"),
    )
    # rows that repeat doc_id and text have added up; each gets its share
    once = sums.select("doc_id", "n_bytes", (F.col("total") / F.col("times")).cast("long").alias("n_tokens"), "times")
    return once.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), "times")).alias("nth")).drop("nth")


def op7(docs: DataFrame, path: str | None = None) -> DataFrame:
    return count_tokens(docs, path).withColumn("over_limit", F.col("n_tokens") > LIMIT)
