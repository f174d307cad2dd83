"""Mixing sources to target weights.

Every document gets a hash-random key. Rows are sorted by range over (source, key), so that a large source
lies in many partitions; each task adds up its own rows, and prefix sums over the totals of (partition,
source) give each document the number of words of its source before it. A source with a budget of B words
and a size of S is taken whole B div S times, and its first B mod S words in order of key once more: the
document at the cut is taken in part, so that each source meets its budget exactly.

Sources by code point, null last, have the weights 1, 2, 3, repeating, and share the words of all sources.
A target stops at `MOST` times its source's size, and what is above is shared again by weight.

Nulls: a null text has no words; null is a source of its own; a null doc_id is a document like any other.
Repeated rows are documents each; those with equal doc_id and size are interchangeable. Ties of keys go by
doc_id and size. An empty table gives no rows, and where no document has words all targets are 0. A very
long text is one row like others. Ids may have any type that casts to a string. Extra columns are carried
by `mix`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subspark.llm.common import BLANKS, fresh, stored

WEIGHTS, MOST = (1, 2, 3), 3
#: Most rows of (partition, source) sums that are broadcast; beyond that Spark joins them.
BROADCAST_ROWS = 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str = "") -> Column:
    return F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, 16)


def in_order(rows: DataFrame) -> DataFrame:
    """rows: (source, key, doc_id, size, more). Stored with part, the range they lie in, and `before`, the words of
    the same source before them in that range."""
    order = [F.asc_nulls_last("source"), F.asc("key"), F.asc_nulls_last("doc_id"), F.asc("size")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    source, size = rows.columns.index("source"), rows.columns.index("size")

    def run(batches):
        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(source).dictionary_encode(null_encoding="encode")
            at, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            sizes = batch.column(size).to_numpy()
            ends = np.cumsum(sizes)
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            base = (ends - sizes)[starts]
            if last is not None and last == (names[at[0]],):
                base[0] -= carried
            runs = np.diff(np.append(starts, len(at)))
            before = ends - sizes - np.repeat(base, runs)
            last, carried = (names[at[-1]],), int(before[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(before)], names=[*batch.schema.names, "part", "before"]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return stored(dealt.mapInArrow(run, f"{kinds}, part int, before long"), "mixing_order")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: (source, n). With target: the weighted share of all words, at most `most` times n. The shared level rises
    until no target is above its limit; each step is one sum over the sources, and each but the last stops one more."""
    ranked = _ranked(sizes)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = stored(ranked.select("source", "n", weight.alias("w")), "mixing_sources")
    words = rows.agg(F.sum("n")).first()[0] or 0
    level, stopped = None, F.lit(False)
    while True:
        free = rows.agg(F.sum(F.when(~stopped, F.col("w"))), F.sum(F.when(stopped, most * F.col("n"))), F.sum(stopped.cast("long"))).first()
        shared, rest, n = words - (free[1] or 0), free[0] or 0, free[2]
        if level is not None and n == level[2]:
            break
        level = (shared, rest, n)
        # a source that stopped stays stopped, as the level never falls
        stopped = most * F.col("n") * F.lit(float(rest)) <= F.col("w") * F.lit(float(shared))
    target = F.when(stopped, (most * F.col("n")).cast("double")).otherwise((F.col("w") * F.lit(level[0])) / F.lit(level[1]))
    return rows.select("source", "n", target.alias("target"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with rank, from 0 by code point and null last: places in ranges, behind the rows of the ranges before."""
    order = F.asc_nulls_last("source")
    dealt = sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "mixing_ranges")
    earlier = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    offsets = dealt.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(earlier, F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.join(offsets, "part").select("source", "n", (F.col("offset") + place).alias("rank"))


def shares(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """rows: (source, key, doc_id, size, more). With source_size, target, epochs (how often the document is taken whole)
    and rest (its first words that are taken once more)."""
    placed = in_order(rows)
    sums = stored(placed.groupBy("part", "source").agg(F.sum("size").alias("words")), "mixing_sums")
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("n")), weights, most)
    earlier = F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumn("offset", F.coalesce(earlier, F.lit(0))).alias("a")
    plan = offsets.join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.part", "a.source", "offset", "n", "target")
    if plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    a, b = placed.alias("a"), plan.alias("b")
    joined = a.join(b, (F.col("a.part") == F.col("b.part")) & F.col("a.source").eqNullSafe(F.col("b.source")))
    budget, n = F.floor("target").cast("long"), F.col("n")
    epochs = F.when(n > 0, F.expr("floor(target) div n")).otherwise(0)
    left = budget - epochs * n - F.col("offset") - F.col("before")
    return joined.select(
        *[F.col(f"a.{c}") for c in rows.columns], n.alias("source_size"), "target", epochs.alias("epochs"), F.greatest(F.lit(0), F.least(F.col("size"), left)).alias("rest")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "") -> DataFrame:
    """docs (doc_id, text, source, more) as the mixture has them: a row for each time a document is taken, in random
    order within a source, with its columns and `copy` from 0. The last copy of the document at the cut ends behind its
    last word that is taken."""
    id_, text, source = (docs.columns.index(c) for c in ("doc_id", "text", "source"))
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    rows = plain.withColumns({"source": F.col(f"c{source}"), "key": random_key(F.col(f"c{id_}"), seed), "doc_id": F.col(f"c{id_}"), "size": word_count(F.col(f"c{text}"))})
    made = shares(rows, weights, most)
    times = F.col("epochs") + (F.col("rest") > 0).cast("long")
    each = made.filter(times > 0).select(
        *plain.columns, F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("copy"), F.when(F.col("rest") < F.col("size"), F.col("rest")).alias("rest"), F.col("epochs")
    )
    each = each.select(*plain.columns, "copy", F.when(F.col("copy") == F.col("epochs"), F.col("rest")).alias("words"))

    def run(batches):
        word = regex.compile(f"[^{BLANKS}]+")
        for batch in batches:
            columns, limits = list(batch.columns), batch.column(batch.num_columns - 1)
            if limits.null_count < len(limits):
                cut = []
                for one, most_words in zip(batch.column(text), limits.to_pylist(), strict=True):
                    one = one.as_py()
                    if most_words is not None:
                        found = word.finditer(one)
                        end = [next(found).end() for _ in range(most_words)][-1]
                        one = one[:end]
                    cut.append(one)
                columns[text] = pa.array(cut, batch.schema.field(text).type)
            yield pa.RecordBatch.from_arrays(columns[:-1], names=batch.schema.names[:-1])

    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    return each.mapInArrow(run, f"{kinds}, copy long").toDF(*docs.columns, fresh(docs, "copy"))


def op11(docs: DataFrame) -> DataFrame:
    rows = stored(docs.select("source", random_key(F.col("doc_id")).alias("key"), "doc_id", word_count(F.col("text")).alias("size")), "mixing_sizes")
    return shares(rows).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).cast("long").alias("taken")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT AS w FROM d GROUP BY source),
r AS (SELECT source, n, w, row_number() OVER o AS k, (sum(n) OVER () - sum(3 * n) OVER o + 3 * n)::BIGINT AS shared,
  (sum(w) OVER () - sum(w) OVER o + w)::BIGINT AS rest FROM s WINDOW o AS (ORDER BY 3 * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT k AS k1, shared AS s1, rest AS r1 FROM r WHERE 3 * n * rest > w * shared ORDER BY k LIMIT 1),
t AS (SELECT source, n, CASE WHEN k1 IS NULL OR k < k1 THEN (3 * n)::DOUBLE ELSE (w * s1)::DOUBLE / r1::DOUBLE END AS target FROM r LEFT JOIN f ON true),
p AS (SELECT d.doc_id, size, n, target, floor(target)::BIGINT AS budget,
  (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target,
  (CASE WHEN n = 0 THEN 0 ELSE (budget // n) * size + greatest(0, least(size, budget % n - before)) END)::BIGINT AS taken FROM p
"""
