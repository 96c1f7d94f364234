"""From raw documents to packed training sequences, in stages that are written in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm.common import scratch, stage, table
from tagloom.llm.decontamination import without_benchmark
from tagloom.llm.exact_dedup import without_copies
from tagloom.llm.minhash import without_near_copies
from tagloom.llm.packing import pack
from tagloom.llm.toxicity import without_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return without_near_copies(docs, num=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in training sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written and read again; all but the result
    is deleted at the end. Rows without text or id, repeated rows and an empty table pass
    all stages (each stage says in its operator what they give); other columns of documents
    are carried along to the last stage."""
    with scratch(spark) as keep:
        docs = table(spark, sf_dir, "documents")
        for name, f in STAGES[:-1]:
            docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
        name, f = STAGES[-1]
        return keep(f(spark, docs, sf_dir), f"pipeline-{name}")
