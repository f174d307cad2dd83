"""Ranked lexical search over a bit-sliced impact index.

A document's impact for a term is a whole number: the term's weight times the damped frequency of the term in
the document. The index has one row for a block of documents: for each term that stands in the block and
each bit of an impact, a bitmap of the documents whose impact has that bit. A search adds the slices of a
query's terms with bitwise carries, for all documents of a block and many queries at once, and finds the
best documents from the most significant slice of the sums downwards: those with the bit go ahead while
they are too many, and are taken as a whole while they are too few. Blocks are built and searched in the
task that reads them; only a block's best documents leave it, and a window ranks those of all blocks.

Queries go to all tasks in blocks of at most about `QUERY_WORDS` words; each block of queries has an index
for its terms and a scan of the documents. Counts of documents and terms are those of the whole table.

Nulls: a null text has no terms. Each row is a document, repeated ones too; rows of one item_id are one query
with the terms of all of them, and a null id is an id. Equal scores are ranked by doc_id, null last, by
value for numbers and by bytes for strings. A query without terms or hits and an empty table give no rows.
Very long texts are split about a megabyte at a time. Extra columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subspark.llm.common import LOWER, UPPER, binary_texts, stored
from subspark.llm.terms import byte_table, split

TOP = 50
#: Documents of a block of the index, at most; queries that a block is searched for at once; words of queries that are broadcast at a time.
BLOCK, AT_ONCE, QUERY_WORDS = 1024, 256, 2_000_000
#: Damping of frequencies, and the share of a document's length in it, in per cent.
DAMPING, LENGTH_SHARE = 20, 50
TABLE = byte_table(UPPER + LOWER + "0123456789")


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, at array<int>, tf array<long>), stored: the number of a document's terms, and which of `terms` it has."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                sizes, at, tf, ends = [], [], [], [0]
                for raw in binary_texts(some.column(1)):
                    n, found = 0, Counter()
                    for words in split(raw, TABLE):
                        n += len(words)
                        found.update(words)
                    hits = [(known[t], c) for t, c in found.items() if t in known]
                    sizes.append(n)
                    at += [k for k, _ in hits]
                    tf += [c for _, c in hits]
                    ends.append(len(at))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))],
                    names=["doc_id", "n", "at", "tf"],
                )

    return stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, at array<int>, tf array<long>"), "postings")


def weights(posted: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents that have terms, all their terms, and the weight of each of the n_terms terms asked for."""
    sums = posted.agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("words")).first()
    docs, words = sums.docs or 0, sums.words or 0
    holders = posted.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect()  # terms of queries only
    out = np.zeros(n_terms, np.int64)
    for r in holders:
        out[r["at"]] = floor(1000 * log((2 * docs + 2) / (2 * r.n + 1)))
    return docs, words, out


def impacts(n: list[int], lengths: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, words: int) -> np.ndarray:
    """n: terms of each document, lengths: how many of the entries of tf and weight are its."""
    m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * x * docs // words if words else 0 for x in n], np.int64)
    return weight * (1_000_000_000 * tf // (1000 * tf + DAMPING * np.repeat(m, lengths)))


def sliced(at: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms that stand in a block, and their slices [term, bit, word of 64 documents]: document d of a block is bit
    d % 64 of word d // 64."""
    terms, row = np.unique(at, return_inverse=True)
    bits, width = max(int(impact.max(initial=0)).bit_length(), 1), -(-n_docs // 64)
    out = np.zeros((len(terms), bits, width), np.uint64)
    order = np.argsort(row, kind="stable")
    row, doc, impact = row[order], doc[order], impact[order]
    step = max(1, 1_000_000 // (64 * width))
    for low in range(0, len(terms), step):
        some = slice(*np.searchsorted(row, [low, low + step]))
        dense = np.zeros((min(step, len(terms) - low), 64 * width), np.int64)
        dense[row[some] - low, doc[some]] = impact[some]
        for b in range(bits):
            packed = np.packbits((dense >> b).astype(np.uint8) & 1, axis=1, bitorder="little")
            out[low : low + step, b] = packed.view("<u8")
    return terms, out


def _blocks(batches, docs: int, words: int, weight: np.ndarray, block: int):
    """(number, ids, terms, slices) of each block of a task's documents, which lie in order of their ids."""
    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        for low in range(0, batch.num_rows, block):
            some = batch.slice(low, block)
            some = some.take(pc.sort_indices(some.column(0), null_placement="at_end"))
            lengths = some.column(2).value_lengths().to_numpy()
            at, tf = some.column(2).flatten().to_numpy(), some.column(3).flatten().to_numpy()
            impact = impacts(some.column(1).to_pylist(), lengths, tf, weight[at], docs, words)
            terms, slices = sliced(at, np.repeat(np.arange(len(lengths)), lengths), impact, some.num_rows)
            yield (part << 32) + k, some.column(0), terms, slices
            k += 1


def index(posted: DataFrame, docs: int, words: int, weight: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(block, ids array, terms array<int>, bits int, slices binary): the bit-sliced index, a row for each block, to be
    written and searched more than once."""
    shared = posted.sparkSession.sparkContext.broadcast(weight)
    kind = posted.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for number, ids, terms, slices in _blocks(batches, docs, words, shared.value, block):
            rows = [
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([terms.tolist()], pa.list_(pa.int32())),
                pa.array([slices.shape[1]], pa.int32()),
                pa.array([slices.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(rows, names=["block", "ids", "terms", "bits", "slices"])

    return posted.mapInArrow(run, f"block long, ids array<{kind}>, terms array<int>, bits int, slices binary")


def added(slices: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """slices [term, bit, word]; rows: the terms of each query, longest first. Sums [bit, query, word] of the impacts of a
    query's terms, by full adders over whole words."""
    n, bits, width = len(rows), slices.shape[1], slices.shape[2]
    longest = max(map(len, rows), default=0)
    out = np.zeros((bits + max(longest, 1).bit_length(), n, width), np.uint64)
    for j in range(longest):
        some = sum(len(r) > j for r in rows)
        new = slices[[r[j] for r in rows[:some]]]
        carry = np.zeros((some, width), np.uint64)
        for b in range(len(out)):
            held = out[b, :some]
            if b < bits:
                one = new[:, b]
                either = held ^ one
                out[b, :some], carry = either ^ carry, (held & one) | (either & carry)
            elif carry.any():
                out[b, :some], carry = held ^ carry, held & carry
            else:
                break
    return out


def best(sums: np.ndarray, top: int) -> np.ndarray:
    """sums [bit, query, word]. A mask [query, word] of the `top` largest sums above 0 of each query; of equal ones the
    first."""
    taken, open_ = np.zeros(sums.shape[1:], np.uint64), np.bitwise_or.reduce(sums, axis=0)
    for s in sums[::-1]:
        ahead = taken | (open_ & s)
        many = (np.bitwise_count(ahead).sum(axis=1) > top)[:, None]
        taken, open_ = np.where(many, taken, ahead), np.where(many, open_ & s, open_ & ~s)
    left = top - np.bitwise_count(taken).sum(axis=1).astype(np.int64)
    # what is still open has equal sums
    for q in np.flatnonzero((left > 0) & open_.any(axis=1)):
        at = np.flatnonzero(np.unpackbits(open_[q].view(np.uint8), bitorder="little"))[: left[q]]
        np.bitwise_or.at(taken[q], at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
    return taken


def _best_of(blocks, asked: list[tuple[object, list[int]]], top: int):
    """Record batches (item_id, block, doc_id, score) of the best documents of each block for each query."""
    names = pa.array([q for q, _ in asked])
    for number, ids, terms, slices in blocks:
        place = {t: k for k, t in enumerate(terms.tolist())}
        found = [(k, rows) for k, (_, own) in enumerate(asked) if (rows := [place[t] for t in own if t in place])]
        found.sort(key=lambda x: -len(x[1]))
        for low in range(0, len(found), AT_ONCE):
            some = found[low : low + AT_ONCE]
            sums = added(slices, [np.array(rows) for _, rows in some])
            mask = np.unpackbits(best(sums, top).view(np.uint8), axis=1, bitorder="little")
            q, d = np.nonzero(mask)
            score = np.zeros(len(q), np.int64)
            for b, s in enumerate(sums):
                score |= ((s[q, d // 64] >> (d % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
            own = np.array([k for k, _ in some])[q]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(own)), pa.array(np.full(len(q), number)), ids.take(pa.array(d)), pa.array(score)], names=["item_id", "block", "doc_id", "score"]
            )


def searched(indexed: DataFrame, queries: list[tuple[object, list[int]]], item_type: str, top: int = TOP) -> DataFrame:
    """queries: (item_id, terms by number). (item_id, block, doc_id, score): the best documents of each block of an index."""
    shared = indexed.sparkSession.sparkContext.broadcast(queries)
    id_type = indexed.schema["ids"].dataType.elementType.simpleString()

    def blocks(batches):
        for batch in batches:
            for number, ids, terms, bits, raw in zip(*batch.columns, strict=True):
                shape = len(terms), bits.as_py(), -(-len(ids) // 64)
                yield number.as_py(), ids.values, terms.values.to_numpy(), np.frombuffer(raw.as_buffer(), np.uint64).reshape(shape)

    return indexed.mapInArrow(lambda batches: _best_of(blocks(batches), shared.value, top), f"item_id {item_type}, block long, doc_id {id_type}, score long")


def searched_once(posted: DataFrame, docs: int, words: int, weight: np.ndarray, queries: list[tuple[object, list[int]]], item_type: str, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The same over an index that isn't kept: a block is built and searched in one task, and then let go."""
    shared = posted.sparkSession.sparkContext.broadcast((weight, queries))
    id_type = posted.schema["doc_id"].dataType.simpleString()

    def run(batches):
        weight, asked = shared.value
        yield from _best_of(_blocks(batches, docs, words, weight, block), asked, top)

    return posted.mapInArrow(run, f"item_id {item_type}, block long, doc_id {id_type}, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, query_words: int = QUERY_WORDS) -> DataFrame:
    """docs: (doc_id, text), items: (item_id, text). (item_id, rank, doc_id, score): each item's `top` best documents."""
    kind, id_type = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    words = stored(_query_terms(items, kind), "queries")
    blocks = -(-words.count() // query_words)
    parts = []
    for b in range(blocks):
        own = words if blocks == 1 else words.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        of: dict = {}
        terms: dict[bytes, int] = {}
        for r in own.collect():  # about query_words rows
            of.setdefault(r.item_id, []).append(terms.setdefault(r.term.encode(), len(terms)))
        posted = postings(docs, list(terms))
        n, total, weight = weights(posted, len(terms))
        parts.append(searched_once(posted, n, total, weight, list(of.items()), kind, top, block))
    if not parts:
        return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {id_type}, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # first within groups of blocks, so that no task has the rows of all blocks
    within = Window.partitionBy("item_id", F.pmod(F.xxhash64("block"), F.lit(64))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= top)
    overall = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= top)
    return overall.select("item_id", "rank", "doc_id", "score")


def _query_terms(items: DataFrame, kind: str) -> DataFrame:
    """(item_id, term), each once."""

    def run(batches):
        for batch in batches:
            for item, raw in zip(batch.column(0), binary_texts(batch.column(1)), strict=True):
                own = sorted(set().union(*split(raw, TABLE)))
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(own), item.type), pa.array(own, pa.binary()).cast(pa.string())], names=["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term string").distinct()


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return ranked(docs, benchmark)


ORACLE = r"""
WITH t AS (SELECT r, doc_id, unnest(ts) AS term, len(ts) AS n FROM (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents)),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, doc_id, term, n, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT count(DISTINCT r) AS docs, count(*) AS words FROM t),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
x AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM x WHERE score > 0)
WHERE rank <= 50
"""
