"""The corpus pipeline: toxic documents, near-duplicates and contaminated documents go, personal data is masked,
what stays is packed into sequences.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. Defined for
nulls, repeated rows and empty tables as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelgrid.llm.decontaminate import without_contaminated
from panelgrid.llm.job import stored
from panelgrid.llm.neardup import without_near_duplicates
from panelgrid.llm.packing import pack_documents
from panelgrid.llm.pii import masked
from panelgrid.llm.toxicity import fit, without_toxic

SIMILARITY = 80  # percent of equal five-word shingles


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go. It learns from the labelled ones among ``docs``."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id."""
    return without_near_duplicates(docs, SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    return masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("pack", pack),
]
#: tokens and the model of toxicity have no SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
