"""A corpus from raw documents: five stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, line_dedup, near_dedup, packing, quality
from lattica.llm.queries import tokenizer_path
from lattica.llm.workspace import Workspace


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier finds bad or toxic go."""
    return quality.keep_good(docs, labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line, and lines nearly like it, stays once; a document with no line left goes."""
    out = line_dedup.line_dedup(docs)
    out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.where("n_removed = 0 OR length(btrim(text, ' \t\n\r\x0b\x0c')) > 0").select(*docs.columns)


def document_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (found by SimHash and MinHash, five-word shingles of a similarity of 0.8 or more) the first document stays."""
    return near_dedup.keep_first(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into training sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", document_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.store(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
