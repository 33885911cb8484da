"""A corpus pipeline over `documents`: quality, near duplicates, benchmarks, mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All
but the last return the columns of documents. Nulls, empty and very long texts, repeated rows,
empty tables and further columns are taken as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, mixing, ngram_join, quality_model, sharding
from palimpsest.llm.cluster import fresh_path

#: Rows of an Arrow batch: texts may be long, and executors hold a few batches of them beside their heap.
BATCH_ROWS = 1000
#: The lowest quality score that stays; labels of fold 0 of 5 are never learned.
LEAST_QUALITY = 0.3


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches LEAST_QUALITY.

    A null or empty text has the score of a text without features; equal texts have equal scores.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = lambda key: F.crc32(F.encode(key, "UTF-8")) % 5 != 0
    model = quality_model.train(docs, labels, "doc_id", "text", "quality", fold)
    return quality_model.keep(docs, model, "text", LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id.

    Rows that share an id are one document: they stay or go together. Rows without id stay.
    """
    small_batches(spark)
    found = ngram_join.ngram_components(docs.select("doc_id", "text"))
    dropped = found.where("id <> component_id").select(F.col("id").alias("dropped")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["dropped"], "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; null and empty texts hold none, repeated rows are judged alike."""
    small_batches(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document, in the order of training.

    Documents without words, null texts among them, are in no copy. Null sources are one source;
    rows that repeat an id, or have none, keep their own copies.
    """
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row.

    A null text counts as an empty one; rows that repeat an id, or have none, are rows of their
    own; equal texts share a shard.
    """
    return sharding.shard(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mixture),
    ("sharding", shards),
]

#: SQL has neither the classifier nor the shards; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written to the shared folder in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
