"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subspark.functions.memory import release
from subspark.plans.store import delete, shared_dir, stored  # noqa: F401

#: Bytes that part words: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: bytes) -> bytes:
    """A-Z in lower case, other bytes as they are."""
    return text.translate(_LOWERED)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def doc_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that stand for one (doc_id, text); rows that repeat both share them and get the same decisions."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit("key"), text, doc_id)


def binary_texts(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value, empty for null, one value at a time."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow of a function from one batch to one batch."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def plainly(docs: DataFrame) -> DataFrame:
    """docs with plain names for all columns but doc_id and text: none is like a helper's, and none has a dot."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)])


def map_carried(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow with columns that are carried under plain names, so that theirs may have dots; by place, not name."""
    names = [f"c{k}" for k in range(len(schema.fields))]

    def renamed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)
        release()

    plain = rows.toDF(*[f"c{k}" for k in range(len(rows.columns))])
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, schema.fields, strict=True)]
    return plain.mapInArrow(renamed, T.StructType(fields)).toDF(*schema.names)


def numbered_ids(docs: DataFrame, name: str) -> DataFrame:
    """docs with a whole number for doc_id: itself, or where ids aren't whole numbers their place in order; null stays."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    from subspark.operators.counts import numbered

    ids = numbered(docs.select("doc_id").filter("doc_id is not null").distinct(), F.asc("doc_id")).toDF("id_of_doc", name)
    return docs.join(ids, docs["doc_id"] == ids["id_of_doc"], "left").drop("id_of_doc")


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))
