"""Quality classifier by importance resampling.

Two generative models over hashed words and word pairs: one of target texts (labelled of good quality
and not toxic), one of all texts. A document's importance is the ratio of its likelihoods under the two;
its log is the sum of the log ratios of its words and pairs. That sum grows with the length of a text, so
that long texts would always win or lose; by default it is scaled to what it would be for `LENGTH` words
and pairs (the mean times `LENGTH`), and with length=None it is taken as it is. Gumbel noise from each
row's hash is added, and the k documents with the largest sums are kept: a sample without replacement by
weight. k is the share of target rows among all labels, times the documents.

The raw model counts all documents. The target model is fitted on at most `FIT_ROWS` labelled rows, the
first by hash; that bounds what is broadcast (hashes of their ids). A labelled document is scored without
its own part of the target model. `LENGTH` was chosen on held-out labels (fitted on one half, judged on
the other): 30 to 400 do alike there, less lets noise decide, and no scaling keeps more junk.

Nulls: a null text has no words and weight 0; a null doc_id has no label; null labels aren't target.
Rows equal in doc_id and text get equal sums; sums that equal the k-th are all kept. Without labels the
target is empty, weights are 0 and k is 0. An empty table gives no rows. Very long texts are read whole.
Ids may be of any type; other columns of both tables aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subspark.llm.common import binary_texts, doc_key, stored

BUCKETS, LENGTH, FIT_ROWS, SEED = 1 << 18, 200.0, 100_000, 11
#: Counts that smooth a bucket of the raw model, and of the target model in the mean.
SMOOTHING, PRIOR = 1.0, 1.0
_PAIR = np.uint32(0x9E3779B1)


class Grams:
    """Buckets of a text's words and word pairs; words seen lately are remembered."""

    def __init__(self, most: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w)
        one = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        with np.errstate(over="ignore"):
            two = (one[:-1] * _PAIR) ^ (one[1:] + np.uint32(0x7F4A7C15))
            two = (two ^ (two >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        return np.concatenate((one, two)) % np.uint32(BUCKETS)


def _counts(docs: DataFrame, target_ids: np.ndarray) -> DataFrame:
    """(bucket, raw, target) sums over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(target_ids)

    def run(batches):
        grams, raw, target = Grams(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        wanted = shared.value
        for batch in batches:
            good = _wanted(batch.column(0), wanted)
            held, chosen, n = [], [], 0
            for text, is_target in zip(binary_texts(batch.column(1)), good, strict=True):
                found = grams(text)
                held.append(found)
                n += len(found)
                if is_target:
                    chosen.append(found)
                if n > 1_000_000:
                    raw += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, n = [], 0
            if held:
                raw += np.bincount(np.concatenate(held), minlength=BUCKETS)
            if chosen:
                target += np.bincount(np.concatenate(chosen), minlength=BUCKETS)
        at = np.flatnonzero(raw)
        for part in np.array_split(at, len(at) // 50_000 + 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(raw[part]), pa.array(target[part])], names=["bucket", "raw", "target"]
            )

    rows = docs.select(_hashed("doc_id").alias("id"), "text").mapInArrow(run, "bucket long, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


class Models:
    """Counts of the two models. Target counts are smoothed towards the raw share: a bucket with little text has a
    ratio of about 1."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        self.raw, self.target = raw, target
        self.share = ((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)).astype(np.float64)
        self.total = float(target.sum())
        self.ratios = self._log(target, self.share, self.total) if self.total else np.zeros(BUCKETS)

    @staticmethod
    def _log(target: np.ndarray, share: np.ndarray, total: float) -> np.ndarray:
        return np.log((target + PRIOR * BUCKETS * share) / (total + PRIOR * BUCKETS) / share)

    def mean_ratio(self, found: np.ndarray, in_target: bool) -> float:
        """Mean log ratio of a document's buckets; its own part of the target model is left out."""
        if not len(found) or not self.total:
            return 0.0
        if not in_target:
            return float(self.ratios[found].mean())
        at, times = np.unique(found, return_counts=True)
        own = self._log(self.target[at] - times, self.share[at], self.total - len(found))
        return float((own * times).sum() / len(found))


def fit(docs: DataFrame, target_ids: np.ndarray) -> Models:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for row in _counts(docs, target_ids).toLocalIterator():
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    return Models(raw, target)


def weights(docs: DataFrame, models: Models, target_ids: np.ndarray, length: float | None = LENGTH) -> DataFrame:
    """(doc_id, k1, k2, n_grams, log_weight) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast((models, target_ids))

    def run(batches):
        grams, (models, wanted) = Grams(), shared.value
        for batch in batches:
            counts, logs = [], []
            for text, good in zip(binary_texts(batch.column(1)), _wanted(batch.column(4), wanted), strict=True):
                found = grams(text)
                counts.append(len(found))
                logs.append(models.mean_ratio(found, good) * (len(found) if length is None else length))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(counts, pa.int64()), pa.array(logs, pa.float64())],
                names=["doc_id", "k1", "k2", "n_grams", "log_weight"],
            )

    k1, k2 = doc_key(F.col("doc_id"), F.col("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"), _hashed("doc_id").alias("id")).mapInArrow(
        run, f"doc_id {kind}, k1 long, k2 long, n_grams long, log_weight double"
    )


def _hashed(name: str) -> Column:
    """A hash of an id of whatever type, null for null."""
    return F.when(F.col(name).isNotNull(), F.xxhash64(F.col(name).cast("string")))


def _wanted(ids: pa.Array, wanted: np.ndarray) -> np.ndarray:
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), wanted) & known


def gumbel(seed: int = SEED) -> Column:
    """Noise that depends on a row's key and the seed alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64("k1", "k2", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """Exact, by narrowing a range of values with counts in 1,000 bins: no sort, and no rows to the driver."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    if k >= n:
        return low
    while low < high:
        width = (high - low) / 1000
        inside = rows.filter((F.col(column) >= low) & (F.col(column) <= high))
        bin_ = F.floor((F.col(column) - F.lit(low)) / F.lit(width)) if width else F.lit(0)
        found = {r.bin: r for r in inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()}
        for b in sorted(found, reverse=True):
            if k <= found[b].n:
                low, high = found[b].a, found[b].b
                break
            k -= found[b].n
        if len(found) == 1 and found[b].n == k:
            return low
    return low


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED, length: float | None = LENGTH) -> DataFrame:
    """(doc_id, n_grams, log_weight, sampling_key, kept) for each document."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    share = labels.agg(F.avg(F.coalesce(good, F.lit(False)).cast("double"))).first()[0] or 0.0
    chosen = labels.filter(good & F.col("doc_id").isNotNull()).select(_hashed("doc_id").alias("id")).distinct()
    wanted = np.array([r.id for r in chosen.orderBy("id").limit(FIT_ROWS).collect()], np.int64)
    scored = weights(docs, fit(docs, wanted), wanted, length)
    scored = stored(scored.withColumn("sampling_key", F.col("log_weight") + gumbel(seed)), "weights")
    least = kth_largest(scored, "sampling_key", round(share * scored.count()))
    kept = F.lit(False) if least is None else F.col("sampling_key") >= F.lit(least)
    return scored.select("doc_id", "n_grams", "log_weight", "sampling_key", kept.alias("kept"))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return resample(docs, labels)
