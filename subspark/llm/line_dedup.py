"""Line dedup over levelled sorted runs.

Lines are hashed once, and the hashes written. A run is a table of line keys, bucketed and sorted by key,
with the number of documents that hold the key and the document that keeps it. Each new batch is merged
against the runs: a key that none of them has is new and its keeper is the batch's largest doc_id; a key
they have only adds to the count. The batch's keys become a run of level 0, and `fanout` runs of one level
are merged into one of the next. Bucketed runs join without a shuffle or a sort, and are dropped when the
repeated lines are known.

Batches are ranges of doc_id between quantiles, so that each has about as many documents, wherever ids
lie: `BATCH` documents, in `LEAST` batches at least and `MOST` at most.

Nulls: a null text is one empty line. A null doc_id counts as one document, smaller than all others.
Repeated rows of one doc_id count as one document; rows that repeat doc_id and text get equal results.
An empty table gives no rows. Very long texts are split whole. A common line is counted in its own task
before it is sent on, and the join that finds its places is one that Spark splits where it is skewed.
Extra columns are carried along by `drop_lines`, whatever their names. Ids that aren't whole numbers count in their order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subspark.llm.common import BLANKS, delete, doc_key, fresh, lower_ascii, numbered_ids, shared_dir, stored

#: Stands for a null doc_id where document ids are compared.
NO_ID = -(2**63)
RUN = "h1 long, h2 long, n_docs long, keeper long"
#: Documents of a batch, and the least and most batches.
BATCH, LEAST, MOST = 5_000_000, 4, 32


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs: (doc_id, text, number). (k1, k2, id, pos, h1, h2): one row for each line whose key is long enough."""
    k1, k2 = doc_key(F.col("doc_id"), F.col("text"))
    keys = F.transform(lines_of(F.col("text")), line_key)
    rows = docs.select(
        k1.alias("k1"), k2.alias("k2"), F.coalesce("number", F.lit(NO_ID)).alias("id"), F.posexplode(keys).alias("pos", "key")
    )
    return rows.filter(F.char_length("key") >= min_chars).select(
        "k1", "k2", "id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")
    )


class LineRuns:
    """The levels of sorted runs. `add` takes the batches in the order in which first-seen documents keep a line."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        self.spark = spark
        self.fanout = fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.names: list[str] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.write.format("parquet")
            .option("path", f"{shared_dir(self.spark)}/{name}")
            .option("compression", "zstd")
            .bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .saveAsTable(name)
        )
        self.names.append(name)
        return self.spark.table(name)

    def add(self, hashes: DataFrame) -> None:
        """Take a batch of (id, h1, h2) rows."""
        new = (
            hashes.groupBy("h1", "h2")
            .agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("keeper"))
            .repartition(self.buckets, "h1", "h2")
        )
        for run in [run for level in self.levels for run in level]:
            known = run.select("h1", "h2", F.lit(True).alias("known"))
            new = new.join(known, ["h1", "h2"], "left").select(
                "h1", "h2", "n_docs", F.when(F.col("known").isNull(), F.col("keeper")).alias("keeper")
            )
        self.levels[0].append(self._write(new))
        self._compact()

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Older runs stand first. A key's keeper comes from the one run in which it was new."""
        out = runs[0]
        for run in runs[1:]:
            b = run.select("h1", "h2", F.col("n_docs").alias("b_docs"), F.col("keeper").alias("b_keeper"))
            out = out.join(b, ["h1", "h2"], "full").select(
                "h1",
                "h2",
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("b_docs", F.lit(0))).alias("n_docs"),
                F.coalesce("keeper", "b_keeper").alias("keeper"),
            )
        return out

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(self.levels[level])))
            self.levels[level] = []
            level += 1

    def all_keys(self) -> DataFrame:
        """One row for each key: (h1, h2, n_docs, keeper)."""
        runs = [run for level in reversed(self.levels) for run in level]
        return self._merged(runs) if runs else self.spark.createDataFrame([], RUN)


    def drop(self) -> None:
        """Tables and files of all runs go."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{shared_dir(self.spark)}/{name}")
        self.levels, self.names = [[]], []


def id_ranges(docs: DataFrame, batches: int | None = None) -> list[Column]:
    """docs: (number, more). Conditions on `id` that part docs into batches, largest ids first, null ids last; from the ids alone."""
    doc_id = F.coalesce("number", F.lit(NO_ID))
    n = docs.count() if batches is None else 0
    batches = batches or min(MOST, max(LEAST, -(-n // BATCH)))
    shares = [k / batches for k in range(1, batches)]
    cuts = sorted(set(docs.agg(F.percentile_approx(doc_id, shares, 10_000)).first()[0] or []), reverse=True) if shares else []
    out, above = [], None
    for cut in cuts:
        out.append(F.col("id") > cut if above is None else (F.col("id") > cut) & (F.col("id") <= above))
        above = cut
    out.append(F.lit(True) if above is None else F.col("id") <= above)
    return out


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fanout: int = 3) -> DataFrame:
    """(k1, k2, dropped): for each document that loses lines, their positions from 0."""
    docs = numbered_ids(docs.select("doc_id", "text"), "number")
    hashed = stored(line_hashes(docs, min_chars), "line_hashes")
    runs = LineRuns(docs.sparkSession, fanout)
    for chosen in id_ranges(docs, batches):
        runs.add(hashed.filter(chosen).select("id", "h1", "h2"))
    repeated = stored(runs.all_keys().filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "lines")
    runs.drop()
    lost = hashed.join(repeated, ["h1", "h2"]).filter(F.col("id") != F.col("keeper"))
    return lost.groupBy("k1", "k2").agg(F.collect_set("pos").alias("dropped"))


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with all its columns, `text` without the dropped lines, and n_lines and n_dropped at the end."""
    k1, k2 = doc_key(F.col("doc_id"), F.col("text"))
    a, b, c = fresh(docs, "k1_of_row"), fresh(docs, "k2_of_row"), fresh(docs, "dropped_of_row")
    lost = dropped_lines(docs.select("doc_id", "text"), **options).select(
        F.col("k1").alias(a), F.col("k2").alias(b), F.col("dropped").alias(c)
    )
    joined = docs.withColumns({a: k1, b: k2}).join(lost, [a, b], "left")
    lines, dropped = lines_of(F.col("text")), F.coalesce(F.col(c), F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    text = F.when(F.col(c).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    )
    n_lines, n_dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    return joined.select(
        *[text.alias("text") if name == "text" else F.col(f"`{name}`") for name in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.size(dropped).cast("long").alias(n_dropped),
    )


def op10(docs: DataFrame) -> DataFrame:
    out = drop_lines(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM
  (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
