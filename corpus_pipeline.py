"""A pretraining corpus from ``documents``: quality classifier, line dedup,
near-duplicate removal, benchmark decontamination, packing.

Each stage takes the documents that its predecessor kept, written as Parquet
and read again, and returns documents with the same columns; the last returns
the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratewise.llm.common import discard, read_table, scratch
from ratewise.llm.decontaminate import decontaminate
from ratewise.llm.jaccard_join import jaccard_components
from ratewise.llm.line_dedup import drop_lines
from ratewise.llm.packing import pack
from ratewise.llm.quality import quality_classifier


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``gone``; rows without an id stay."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = quality_classifier(docs, read_table(spark, sf_dir, "labels"))
    return _without(docs, judged.where("not kept"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters and more that five documents share stay in one."""
    return drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 Jaccard on 5-word shingles one document stays."""
    groups = jaccard_components(docs, k=5, percent=80)
    return _without(docs, groups.where("component_id <> doc_id"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences for training, a row per piece."""
    return pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    written = None
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:
            discard(written)           # the next stage has read it
        written = docs
    return docs
