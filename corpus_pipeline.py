"""A training corpus from `documents`, stage by stage.

Each stage takes (spark, docs, sf_dir), with docs what the stage before kept. All but the last return the
columns of documents. n_chars follows the text where a stage changes it.

Nulls in any column, empty tables, very long texts, ties and rows that repeat are dealt with as the stage's operator
says; a null text has no words, so that the quality rules reject it. Extra columns go through all stages but the last
whatever their names, those with dots and those that helpers have included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subspark.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from subspark.llm.common import stored, table


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return docs.select(*[chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    judged, (kept, _) = quality_rules.verdicts(docs)
    return judged.filter(F.col(f"`{kept}`")).select(*[F.col(f"`{name}`") for name in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three or more documents stay in the one with the largest doc_id."""
    return _sized(line_dedup.drop_lines(docs), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; a document that is mostly such passages goes as a whole."""
    return _sized(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.piece_records(docs)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("near copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Fingerprints and token ids can't be had in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
