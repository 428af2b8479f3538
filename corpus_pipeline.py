"""The corpus pipeline: classify, deduplicate, decontaminate, mix, write token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
as Parquet to the shared folder and reads it back as the next one's docs. All
but the last return the columns of documents.

Defined results: in the near-duplicate stage a document is a pair of id and text,
so texts that share an id, or have none, are documents of their own, and of equal
rows one stays; the other cases are those of the operators. Columns of any name
besides those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm import cotrain, decontaminate, minhash, mixing, tokens
from prosemill.llm.common import scratch, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier keeps."""
    return cotrain.good_documents(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity of 0.8 or more)."""
    row = "row_" + "_".join(docs.columns)
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    kept = minhash.near_duplicates(keyed, size=5, percent=80, id_col=row).where("kept").select(F.col("doc_id").alias(row))
    return keyed.join(kept, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; one row for each epoch in which a document is taken."""
    return mixing.mix(docs, mixing.LEVELS, mixing.WEIGHTS, share=0.8, epochs=2).select(*docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, as read back."""
    return tokens.token_files(spark, docs)


STAGES = [("quality classifier", classify), ("near-duplicates", deduplicate), ("decontamination", decontaminated), ("mixing", mixed), ("token files", tokenised)]

#: Classifier training, sketches and tokenizer are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
