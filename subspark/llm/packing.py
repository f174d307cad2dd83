"""Packing: concatenate and cut.

Pass one turns each document into ids with an end token behind them, writes them to the shared folder
with their place in the partition, and adds up the partition's tokens. Prefix sums over the partitions'
totals (one number for each task of pass one; at most `PARTS`) give each partition its global offset.
Pass two cuts the line of all tokens into windows of `SIZE` tokens. A window that lies in one run of
rows is whole at once; what a run has of its first and last window are boundary records, which are put
together by window. A window carries the list of its pieces: which part of which document stands where.
Only the last window may be padded. Sequences and piece records are both read from the windows.

Nulls: a null text is empty and has only the end token. A null doc_id is packed like any other. Repeated
rows are packed each. An empty table gives no windows. A very long text goes on over as many windows as
it needs. Other columns of documents aren't read.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subspark.llm import pieces as P
from subspark.llm.common import arrow_schema, release, stored

SIZE, END, PAD = 4096, 2, 0
#: Most partitions whose offsets are broadcast (24 bytes each).
PARTS = 2_000_000


def tokenised(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """(part, doc_id, local long, n long, ids binary): ids are little-endian 32-bit, the last one the end token;
    local is the place of the first in its partition."""
    shared = docs.sparkSession.sparkContext.broadcast(P.read(path))
    tail = np.array([end], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known, part, local = P.pieces(shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = batch.slice(k, 1000)
                ids = [x + tail for x in known.ids_of([t or "" for t in some.column(1).to_pylist()])]
                sizes = [len(x) // 4 for x in ids]
                ends = list(accumulate(sizes, initial=local))
                local = ends.pop()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), some.column(0), pa.array(ends, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "doc_id", "local", "n", "ids"],
                )
        release(keep=P.held())

    rows = docs.select("doc_id", "text").mapInArrow(run, f"part int, doc_id {kind}, local long, n long, ids binary")
    return stored(rows, "tokens")


def placed(rows: DataFrame) -> DataFrame:
    """tokenised rows with `first`, the global place of each document's first token, for local and part."""
    spark = rows.sparkSession
    totals = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect())
    if len(totals) > PARTS:
        raise ValueError(f"{len(totals)} partitions; read the table in fewer")
    offsets = list(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0), strict=False))
    where = F.broadcast(spark.createDataFrame(offsets, "part int, offset long"))
    return rows.join(where, "part").withColumn("first", F.col("offset") + F.col("local")).drop("part", "local", "offset")


NAMES = ["sequence_id", "offset", "ids", "docs", "starts", "lengths", "sizes", "places", "crcs"]


def _crcs(raw: bytes, lengths: list[int]) -> list[int]:
    """CRC-32 of each piece of a window."""
    view, out, at = memoryview(raw), [], 0
    for n in lengths:
        out.append(zlib.crc32(view[at : at + 4 * n]))
        at += 4 * n
    return out


def _windows(rows: DataFrame, size: int, digest: bool) -> DataFrame:
    """rows: (doc_id, first, n, ids). A row for each window: sequence_id, ids, and lists of its pieces in order: docs,
    starts (ids of the document before the piece), lengths, sizes (ids of the document), places in the window, crcs. With `digest`, windows
    leave their task without ids, else without crcs."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = arrow_schema(f"doc_id {kind}").field(0).type
    lists = f"docs array<{kind}>, starts array<long>, lengths array<long>, sizes array<long>, places array<long>, crcs array<long>"

    def cut(begin: int, held: list[tuple]) -> pa.RecordBatch:
        """held: (doc_id, start, n, ids) in a row; the first id stands at `begin`."""
        docs, before, sizes, ids = zip(*held, strict=True)
        raw = b"".join(ids)
        places = np.cumsum([0, *(len(x) // 4 for x in ids)])
        total = int(places[-1])
        points = np.union1d(places[:-1], np.arange(-begin % size, total, size))
        own = np.searchsorted(places, points, "right") - 1
        starts, lengths = points - places[own] + np.array(before, np.int64)[own], np.diff(np.concatenate((points, [total])))
        window = (begin + points) // size
        heads = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
        edges, pieces = np.concatenate((points[heads], [total])).tolist(), np.concatenate((heads, [len(points)]))
        offsets = pa.array(pieces, pa.int32())
        as_lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (starts, lengths, np.array(sizes, np.int64)[own], (begin + points) % size)]
        of_docs = pa.ListArray.from_arrays(offsets, pa.array(docs, id_type).take(pa.array(own)))
        cuts, crcs, sizes_of = [], [], lengths.tolist()
        for a, b, p, q in zip(edges[:-1], edges[1:], pieces[:-1].tolist(), pieces[1:].tolist(), strict=True):
            part = raw[4 * a : 4 * b]
            done = digest and b - a == size
            cuts.append(None if done else part)
            crcs.append(_crcs(part, sizes_of[p:q]) if done else None)
        return pa.RecordBatch.from_arrays(
            [pa.array(window[heads]), pa.array((begin + points[heads]) % size), pa.array(cuts, pa.binary()), of_docs, *as_lists, pa.array(crcs, pa.list_(pa.int64()))], names=NAMES
        )

    def run(batches):
        begin, held, n = 0, [], 0
        for batch in batches:
            for doc_id, first, count, ids in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if held and begin + n != first:
                    yield cut(begin, held)
                    held, n = [], 0
                if not held:
                    begin = first
                held.append((doc_id, 0, count, ids))
                n += count
                if n >= 64 * size:
                    # the last document goes on in the next record where a window ends inside it
                    rest = (begin + n) % size
                    doc_id, start, count, ids = held[-1]
                    here = len(ids) // 4
                    if rest < here:
                        held[-1] = (doc_id, start, count, ids[: 4 * (here - rest)])
                        yield cut(begin, held)
                        begin, n = begin + n - rest, rest
                        held = [(doc_id, start + here - rest, count, ids[4 * (here - rest) :])] if rest else []
        if held:
            yield cut(begin, held)
        release()

    def whole(batches):
        for batch in batches:
            columns = list(batch.columns)
            if digest:
                columns[7] = pa.array([_crcs(raw, n) for raw, n in zip(columns[1].to_pylist(), columns[4].to_pylist(), strict=True)], pa.list_(pa.int64()))
                columns[1] = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    cuts = stored(rows.select("doc_id", "first", "n", "ids").mapInArrow(run, f"sequence_id long, offset long, ids binary, {lists}"), "cuts")
    full = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n) == size
    names = [n for n in NAMES if n != "offset"]
    boundary = cuts.filter(~full).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", *names[1:-1]))).alias("parts"))
    joined = boundary.select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        *[F.flatten(F.col(f"parts.{c}")).alias(c) for c in names[2:-1]],
        F.lit(None).cast("array<long>").alias("crcs"),
    )
    return cuts.filter(full).select(*names).unionByName(joined.mapInArrow(whole, f"sequence_id long, ids binary, {lists}"))


def windows(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, digest: bool = False) -> DataFrame:
    return _windows(placed(tokenised(docs, path, end)), size, digest)


def piece_records(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """One row for each piece of each window: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    made = windows(docs, path, size, end, digest=True)
    each = made.select("sequence_id", F.explode(F.arrays_zip("docs", "starts", "lengths", "crcs", "sizes", "places")).alias("p"))
    return each.select(
        F.col("p.docs").alias("doc_id"),
        F.col("p.starts").alias("start"),
        F.col("p.lengths").alias("length"),
        F.col("p.crcs").alias("ids_crc32"),
        F.col("p.sizes").alias("doc_tokens"),
        "sequence_id",
        F.col("p.places").alias("offset"),
    )


def sequences(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, pad: int = PAD) -> DataFrame:
    """(sequence_id, n_tokens, ids array<long>): the sequences themselves; the last one is padded to `size`, unless
    its tokens number a power of two."""

    def run(batches):
        for batch in batches:
            lists = [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in batch.column(1)]
            ids = [np.pad(x, (0, 0 if len(x) & (len(x) - 1) == 0 else size - len(x)), constant_values=pad) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array(ids, pa.list_(pa.int64()))],
                names=["sequence_id", "n_tokens", "ids"],
            )

    return windows(docs, path, size, end).select("sequence_id", "ids").mapInArrow(run, "sequence_id long, n_tokens long, ids array<long>")


def op1(docs: DataFrame, path: str | None = None) -> DataFrame:
    return piece_records(docs, path)
