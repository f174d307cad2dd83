"""Exact substring dedup: bytes covered by a `SIZE`-byte string that also starts anywhere else.

Strings are dealt out so that equal ones meet: the string at a position goes by the smallest hash of its
`GRAM`-byte parts, which depends on the string alone. Neighbouring positions mostly have the smallest
part in common, so what goes out is a run of positions with the text that their strings cover, `RUN` at most. Equal
runs of a bucket are counted and kept once. A bucket of a single run, in which the
smallest part occurs once, has no repeats. The other buckets
are put into shards of about `SHARD` bytes; each shard sorts its suffixes by Larsson-Sadakane refinement
and takes common prefixes by Kasai's algorithm. A bucket of over a shard's size is parted over several
shards; each pair of those is merged by binary search of the strings of one in the suffix array of the
other. All further steps work with positions, until each text loses its bytes.

Nulls: a null text is empty, and has no strings. A null doc_id stays null. Repeated rows of doc_id and
text are one text if both are equal: rows that are equal in both still repeat each other and lose the
bytes. An empty table gives no rows. Very long texts go out in runs like others. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subspark.llm.common import arrow_schema, binary_texts, doc_key, fresh, stored
from subspark.llm.suffix_arrays import found_in, join_texts, repeats_inside, suffix_array

SIZE, GRAM = 200, 32
#: Most positions of a run: a longer one, as of a text that repeats one byte, goes out in several.
RUN = 1 << 16
#: Bytes of text of a shard, and of a part of a bucket that is larger than LARGE shards.
SHARD, PART, LARGE = 1_000_000, 2_000_000, 3
#: Bytes of texts that are hashed together.
TOGETHER = 1 << 20
TWICE = 1 << 62
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each `gram` bytes (a power of two), by doubling."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        power, size = _BASE, 1
        while size < gram:
            h = h[:-size] * power + h[size:]
            power = power * power
            size *= 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(texts: list[bytes], size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of string positions with one smallest part: (text's number, first position, positions, bucket, digest,
    whether the part occurs twice in the run)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none, none, none, none, none
    grams, width = gram_hashes(data, gram), size - gram + 1
    least = window_minima(grams, width)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    here = np.arange(len(least)) + size <= (starts + sizes)[owner]
    change = np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (here[1:] != here[:-1])))
    first = np.flatnonzero(change)
    length = np.diff(np.concatenate((first, [len(least)])))
    keep = here[first]
    first, length = first[keep], length[keep]
    if (length > RUN).any():
        times = -(-length // RUN)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        first, length = np.repeat(first, times) + nth * RUN, np.minimum(np.repeat(length, times) - nth * RUN, RUN)
    whole = b"".join(texts)
    digest = xxhash.xxh3_64_intdigest
    digests = np.fromiter(
        (digest(whole[a : a + n + size - 1]) for a, n in zip(first.tolist(), length.tolist(), strict=True)), np.uint64, len(first)
    )
    twice = _twice(grams, least, width, first, length)
    number = owner[first]
    return number, first - starts[number], length, least[first].view(np.int64), digests.view(np.int64), twice


def _twice(grams: np.ndarray, least: np.ndarray, width: int, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each run: does its smallest part occur twice in it? Then strings of one run can be equal."""
    edge = np.zeros(width - 1, least.dtype)
    highest = ~window_minima(~np.concatenate((edge, least, edge)), width)
    parts = np.flatnonzero(grams == highest)  # those that are the smallest of some string
    low, high = np.searchsorted(parts, first), np.searchsorted(parts, first + length + width - 1)
    many = np.flatnonzero(high - low > 1)
    counts = (high - low)[many]
    run = np.repeat(many, counts)
    at = np.repeat(low[many] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    equal = grams[parts[at]] == least[first[run]]
    return np.bincount(run[equal], minlength=len(first)) > 1


def _grouped(batch: pa.RecordBatch, column: int, most: int):
    """Slices of rows of about `most` bytes of text, with the texts."""
    texts, start, n = [], 0, 0
    for row, text in enumerate(binary_texts(batch.column(column))):
        texts.append(text)
        n += len(text)
        if n >= most:
            yield start, texts
            texts, start, n = [], row + 1, 0
    if texts:
        yield start, texts


def all_runs(keyed: DataFrame, size: int = SIZE) -> DataFrame:
    """keyed: (k1, k2, text). (bucket, digest, k1, k2, place): place is the first position and, in the lower 31 bits,
    the number of positions; TWICE is added where strings of the run may be equal."""

    def run(batches):
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for start, texts in _grouped(batch, 2, TOGETHER):
                number, first, length, bucket, digest, twice = runs_of(texts, size)
                if len(number):
                    rows = number + start
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (bucket, digest, k1[rows], k2[rows], (first << 31) | length | np.where(twice, TWICE, 0))],
                        names=["bucket", "digest", "k1", "k2", "place"],
                    )

    return keyed.mapInArrow(run, "bucket long, digest long, k1 long, k2 long, place long")


def _texts_of(reps: DataFrame, keyed: DataFrame, size: int) -> DataFrame:
    """reps: (bucket, digest, n, rep struct<k1, k2, place>). Adds each one's text: (bucket, digest, n, text)."""
    asked = reps.groupBy("rep.k1", "rep.k2").agg(
        F.collect_list(F.struct("bucket", "digest", "n", F.col("rep.place").alias("place"))).alias("asked")
    )
    once = packed(keyed).join(asked, ["k1", "k2"])

    def run(batches):
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for text, some in zip(batch.column(0), batch.column(1), strict=True):
                raw = opened.decompress(text.as_py(), max_output_size=2**31 - 1)
                for x in some.as_py():
                    first, n = x["place"] >> 31, x["place"] & (2**31 - 1)
                    out.append((x["bucket"], x["digest"], x["n"], raw[first : first + n + size - 1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["bucket", "digest", "n", "text"],
            )

    return once.select("packed", "asked").mapInArrow(run, "bucket long, digest long, n long, text binary")


def packed(keyed: DataFrame) -> DataFrame:
    """keyed with its text compressed, for a shuffle."""
    at = keyed.columns.index("text")

    def run(batches):
        for batch in batches:
            small = zstandard.ZstdCompressor(3)
            columns = list(batch.columns)
            columns[at] = pa.array([small.compress(t) for t in binary_texts(batch.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:at], "packed", *batch.schema.names[at + 1 :]])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" if f.name != "text" else "packed binary" for f in keyed.schema]
    return keyed.mapInArrow(run, ", ".join(fields))


FOUND = "bucket long, digest long, starts array<int>, ends array<int>"


def _edges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2].tolist(), edges[1::2].tolist()


def shard_repeats(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows: (bucket, digest, n, text), no (bucket, digest) twice. Which positions of each text repeat: FOUND, perhaps
    several rows for a (bucket, digest)."""
    rows = stored(rows, "shard_rows")
    by_bucket = rows.groupBy("bucket").agg(F.sum(F.length("text")).alias("bytes"))
    total = by_bucket.agg(F.sum("bytes")).first()[0] or 0
    shards = total // SHARD + 1
    large = stored(by_bucket.filter(F.col("bytes") > LARGE * SHARD), "large")
    if large.isEmpty():
        small, wide = rows, None
    else:
        # what stands in a large bucket: few buckets, but many rows; each row meets all parts
        small = rows.join(large, "bucket", "left_anti")
        parts = F.ceil(F.col("bytes") / PART).cast("int")
        own = F.pmod(F.xxhash64("digest"), parts).cast("int")
        wide = rows.join(large, "bucket").withColumns({"parts": parts, "own": own})
        wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        wide = wide.select(
            "bucket", "digest", "n", "text", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own"
        )
    schema = arrow_schema(FOUND)

    def record(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def arrays(table: pa.Table):
        texts = table.column("text").to_pylist()
        codes, starts = join_texts(texts)
        return texts, codes, starts, *suffix_array(codes)

    def rows_of(table: pa.Table, texts, starts, flags):
        out = []
        for bucket, digest, n, text, start in zip(*(table.column(c).to_pylist() for c in ("bucket", "digest", "n")), texts, starts.tolist(), strict=True):
            count = len(text) - size + 1
            mine = np.ones(count, bool) if n > 1 else flags[start : start + count]
            if mine.any():
                out.append((bucket, digest, *_edges(mine)))
        return out

    def alone(table: pa.Table) -> pa.Table:
        texts, codes, starts, order, rank = arrays(table)
        out = rows_of(table, texts, starts, repeats_inside(codes, starts, order, rank, size))
        return pa.Table.from_batches([record(out)] if out else [], schema=schema)

    def pair(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, a, b = (k.as_py() for k in key)
        if a == b:
            return alone(table)
        own = table.column("own").to_numpy()
        left, right = table.filter(pa.array(own == a)), table.filter(pa.array(own == b))
        out = []
        if left.num_rows and right.num_rows:
            made = [arrays(left), arrays(right)]
            for me, it, side in ((made[0], made[1], left), (made[1], made[0], right)):
                texts, codes, starts = me[:3]
                once = [(s, len(t)) for s, t, n in zip(starts.tolist(), texts, side.column("n").to_pylist(), strict=True) if n == 1]
                at = np.concatenate([np.zeros(0, np.int64), *(s + np.arange(n - size + 1) for s, n in once)])
                flags = np.zeros(len(codes), bool)
                flags[at] = found_in(codes, at, it[1], it[3], size)
                out += rows_of(side, texts, starts, flags)
        return pa.Table.from_batches([record(out)] if out else [], schema=schema)

    shard = F.pmod(F.xxhash64("bucket"), F.lit(shards))
    found = small.withColumn("shard", shard).groupBy("shard").applyInArrow(alone, FOUND)
    if wide is not None:
        found = found.unionByName(wide.groupBy("bucket", "a", "b").applyInArrow(pair, FOUND))
    return found


def repeated_positions(keyed: DataFrame, size: int = SIZE) -> DataFrame:
    """keyed: (k1, k2, text). (k1, k2, spans array<struct<first, starts, ends>>): for each text with repeats, ranges of
    string positions, relative to first."""
    weight = F.when(F.col("place") >= TWICE, 2).otherwise(1)
    shared = all_runs(keyed, size).groupBy("bucket").agg(F.sum(weight).alias("n")).filter(F.col("n") > 1).select("bucket")
    met = all_runs(keyed, size).join(stored(shared, "buckets"), "bucket")
    places = stored(met.withColumn("place", F.col("place").bitwiseAND(TWICE - 1)), "places")
    reps = places.groupBy("bucket", "digest").agg(
        F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("rep")
    )
    found = stored(shard_repeats(_texts_of(reps, keyed, size), size), "repeats")
    met = places.join(found, ["bucket", "digest"])
    return met.groupBy("k1", "k2").agg(
        F.collect_list(F.struct(F.shiftright("place", 31).alias("first"), "starts", "ends")).alias("spans")
    )


def covered(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges."""
    ranges = sorted({(x["first"] + a, x["first"] + b - 1 + size) for x in spans for a, b in zip(x["starts"], x["ends"], strict=True)})
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def kept_bytes(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, done = [], 0
    for a, b in gone:
        out.append(text[done:a])
        done = b
    return b"".join([*out, text[done:]])


def _with_spans(docs: DataFrame, size: int) -> tuple[DataFrame, str, str]:
    """docs, its text compressed by another name, with the spans of its text: (rows, name of packed, name of spans)."""
    k1, k2 = doc_key(F.col("doc_id"), F.col("text"))
    spans = repeated_positions(docs.select(k1.alias("k1"), k2.alias("k2"), "text"), size)
    a, b, c = fresh(docs, "k1_of_row"), fresh(docs, "k2_of_row"), fresh(docs, "spans_of_row")
    rows = packed(docs.withColumns({a: k1, b: k2}))
    return rows.join(spans.toDF(a, b, c), [a, b], "left"), c


def op9(docs: DataFrame, size: int = SIZE) -> DataFrame:
    rows, spans = _with_spans(docs.select("doc_id", "text"), size)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for text, some in zip(batch.column(1), batch.column(2), strict=True):
                raw = opened.decompress(text.as_py(), max_output_size=2**31 - 1)
                gone = covered(some.as_py() or [], size)
                out.append((len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept_bytes(raw, gone)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in zip(*out, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return rows.select("doc_id", "packed", spans).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
