"""Column functions over vectors (arrays of double)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has length 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def log_sum_exp(values: Column) -> Column:
    """0 for no values."""
    top = F.array_max(values)
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(top + F.log(total(F.transform(values, lambda x: F.exp(x - top)))))


def log_softmax(values: Column) -> Column:
    return F.transform(values, lambda x: x - log_sum_exp(values))


def mean_vector(rows: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """The mean of the vectors of each group, by dimension."""
    at = rows.select(*by, F.posexplode(vec).alias("dim", "x")).groupBy(*by, "dim").agg(F.avg("x").alias("x"))
    return at.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec")
    )


def or_mean(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """rows with vec; a key without a vector gets the mean of all vectors."""
    mean = mean_vector(vectors, []).withColumnRenamed("vec", "mean_vec")
    joined = rows.join(vectors.select(key, "vec"), key, "left").crossJoin(F.broadcast(mean))  # one row
    return joined.withColumn("vec", F.coalesce("vec", "mean_vec")).drop("mean_vec")
