"""Substring dedup by content-defined chunks.

A gear hash rolls over each text's bytes. A chunk ends where the hash is the least of `REACH` bytes on
either side, so an end depends on the bytes around it alone: an insertion changes the chunks next to it
and no other. Chunks are compared by digest over all texts. Of each chunk the first occurrence stays
(smallest doc_id, then place); what repeats it goes if repeated chunks in a row make up `MIN_SPAN` bytes
or the whole text, so that short phrases stay.

Digests have 64 bits and 18 more, and the chunk's length must match as well.

Nulls: a null text is empty and has no chunks, and stays null; an empty table gives no rows; very long texts are cut
whole; null doc_ids count as one id above all others. Ids that aren't whole numbers count in their order. Rows that
repeat doc_id and text are one document, and don't repeat each other. Extra columns are carried along by
`drop_chunks`, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subspark.llm.common import numbered_ids, plainly, stored
from subspark.llm.suffix_dedup import TOGETHER, _grouped, kept_bytes, packed, window_minima

REACH, MIN_SPAN = 24, 100
#: Longest chunk, in bytes; longer ones are cut there.
LONGEST = 8191
NO_ID = 2**63 - 1
#: Bytes that a gear hash of 32 bits covers, and a value for each byte; between texts there is nothing.
COVER = 32
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)] + [0], np.uint32)


def gear_hashes(codes: np.ndarray) -> np.ndarray:
    """The gear hash (shift left, add the byte's value) at each place, by doubling."""
    h, size = GEAR[codes], 1
    with np.errstate(over="ignore"):
        while size < COVER:
            more = h.copy()
            more[size:] += h[:-size] << np.uint32(size)
            h, size = more, 2 * size
    return h


def chunk_ends(texts: list[bytes], reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, start, length) of all chunks, in order."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    gap = COVER + reach
    starts = np.concatenate(([0], np.cumsum(sizes + gap)[:-1])).astype(np.int64) + gap
    codes = np.full(int((sizes + gap).sum()) + gap, 256, np.uint16)
    inside = np.zeros(len(codes), bool)
    for text, start in zip(texts, starts.tolist(), strict=True):
        codes[start : start + len(text)] = np.frombuffer(text, np.uint8)
        inside[start : start + len(text)] = True
    h = gear_hashes(codes)
    h[~inside] = np.uint32(2**32 - 1)
    low = window_minima(h, reach)
    at = np.arange(reach, len(h) - reach)
    cut = at[(h[at] < low[: len(at)]) & (h[at] <= low[reach + 1 : reach + 1 + len(at)]) & inside[at]] + 1
    owner = np.searchsorted(starts, cut, "right") - 1
    place = cut - starts[owner]
    far = (place > reach) & (place < sizes[owner] - reach)
    full = np.flatnonzero(sizes)
    number = np.concatenate((full, full, owner[far]))
    edge = np.concatenate((np.zeros(len(full), np.int64), sizes[full], place[far]))
    order = np.lexsort((edge, number))
    number, edge = number[order], edge[order]
    same = number[1:] == number[:-1]
    number, start, length = number[:-1][same], edge[:-1][same], np.diff(edge)[same]
    if (length > LONGEST).any():
        times = -(-length // LONGEST)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        number, start, length = np.repeat(number, times), np.repeat(start, times), np.repeat(length, times)
        start, length = start + nth * LONGEST, np.minimum(length - nth * LONGEST, LONGEST)
    return number, start, length


def all_chunks(keyed: DataFrame) -> DataFrame:
    """keyed: (id, k1, text). (digest, id, k1, place): place has more of the digest, the start and the length."""

    def run(batches):
        for batch in batches:
            ids, k1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, texts in _grouped(batch, 2, TOGETHER):
                number, start, length = chunk_ends(texts)
                if not len(number):
                    continue
                wide = [xxhash.xxh3_128_intdigest(texts[t][a : a + n]) for t, a, n in zip(number.tolist(), start.tolist(), length.tolist(), strict=True)]
                digest = np.array([w & (2**64 - 1) for w in wide], np.uint64).view(np.int64)
                more = np.array([w >> 110 for w in wide], np.int64)
                rows = number + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (digest, ids[rows], k1[rows], more << 44 | start << 13 | length)],
                    names=["digest", "id", "k1", "place"],
                )

    return keyed.mapInArrow(run, "digest long, id long, k1 long, place long")


def _keys(number: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(number), F.lit(NO_ID)), F.xxhash64("doc_id", "text")


def repeated_chunks(keyed: DataFrame) -> DataFrame:
    """keyed: (id, k1, text). (id, k1, chunks array<struct<start, length>>): those that repeat an earlier one."""
    twice = all_chunks(keyed).groupBy("digest").count().filter(F.col("count") > 1).select("digest")
    met = stored(all_chunks(keyed).join(stored(twice, "digests"), "digest"), "chunks")
    key = F.col("place").bitwiseAND((((1 << 18) - 1) << 44) | 8191).alias("key")
    where = F.struct("id", "k1", F.shiftright("place", 13).bitwiseAND((1 << 31) - 1).alias("start"))
    rows = met.select("digest", key, where.alias("at"))
    first = rows.groupBy("digest", "key").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    first = first.filter(F.col("first") != F.col("last")).drop("last")
    later = rows.join(first, ["digest", "key"]).filter(F.col("at") != F.col("first"))
    length = F.col("key").bitwiseAND(8191).cast("int").alias("length")
    return later.groupBy("at.id", "at.k1").agg(F.collect_set(F.struct(F.col("at.start").cast("int").alias("start"), length)).alias("chunks"))


def removed(chunks: list[dict], n_bytes: int, min_span: int = MIN_SPAN) -> list[tuple[int, int]]:
    """Byte ranges to remove: repeated chunks in a row, if they are long enough or all of the text."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((x["start"], x["start"] + x["length"]) for x in chunks):
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return [(a, b) for a, b in out if b - a >= min_span or b - a == n_bytes]


def whole_characters(text: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges without the parts of a character that they cut through."""
    out = []
    for a, b in gone:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b < len(text) and b > a and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _with_chunks(docs: DataFrame) -> DataFrame:
    """docs: plain columns. With packed texts and the repeated chunks, in columns of these names."""
    docs = numbered_ids(docs, "number_of_row")
    ident, k1 = _keys("number_of_row")
    found = repeated_chunks(docs.select(ident.alias("id"), k1.alias("k1"), F.col("text")))
    keys = ["id_of_row", "k1_of_row"]
    return packed(docs.withColumns({"id_of_row": ident, "k1_of_row": k1})).join(found.toDF(*keys, "chunks"), keys, "left")


def drop_chunks(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """docs, same columns, without the repeated chunks."""
    plain = plainly(docs)
    names = plain.columns
    at = names.index("text")
    rows = _with_chunks(plain.withColumn("no_text", F.col("text").isNull()))

    def run(batches):
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for text, some, none in zip(batch.column(at), batch.column(len(names)), batch.column(len(names) + 1).to_pylist(), strict=True):
                if none:
                    out.append(None)
                    continue
                raw = opened.decompress(text.as_py(), max_output_size=2**31 - 1)
                out.append(kept_bytes(raw, whole_characters(raw, removed(some.as_py() or [], len(raw), min_span))).decode())
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    picked = rows.select(*[F.col("packed") if n == "text" else F.col(n) for n in names], "chunks", "no_text")
    return picked.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op5(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    rows = _with_chunks(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for text, some in zip(batch.column(1), batch.column(2), strict=True):
                raw, found = opened.decompress(text.as_py(), max_output_size=2**31 - 1), some.as_py() or []
                gone = whole_characters(raw, removed(found, len(raw), min_span))
                removed_chunks = sum(any(a <= x["start"] + x["length"] - 1 and x["start"] < b for a, b in gone) for x in found) if gone else 0
                out.append((len(raw), removed_chunks, sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept_bytes(raw, gone)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in zip(*out, strict=True))],
                names=["doc_id", "n_bytes", "n_removed_chunks", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.select("doc_id", "packed", "chunks").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed_chunks long, n_removed long, n_spans long, kept_sha256 string"
    )
