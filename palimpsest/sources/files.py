"""Files in and out: JSON lines, directories, snapshots, reports, manifests."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Partitions of a table that is dealt anew at most: so much is a few gigabytes, whatever the cluster's size.
MOST_SPREAD = 64


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that costs far more than moving it: one of few partitions is dealt to all cores.

    A small file may be a single row group, which one task reads. Partitions have a bounded size
    (spark.sql.files.maxPartitionBytes), so a table of more than MOST_SPREAD of them isn't moved.
    """
    df, cores = read_table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= min(cores, MOST_SPREAD) else df


def held(df: DataFrame) -> DataFrame:
    """df, computed once for all its uses, by a checkpoint in the shared folder.

    Where none is set, a temporary one is, but only if master is local. Nothing stays in memory.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(folder or _local_folder(spark))
    return df.checkpoint(eager=True)


def _local_folder(spark: SparkSession) -> str:
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="scratch-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; where none is set, a temporary one, but only if master is local."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType | None = None) -> DataFrame:
    """Objects of JSON lines with where they came from; blank lines and other JSON values go.

    _file names a row's file; _row grows with the row's place in it. A file that is split among
    tasks has no line numbers without reading it twice.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    lines = lines.where(F.trim("value").startswith("{"))
    if schema is None:
        schema = spark.read.json(path).schema
    return lines.select("_file", "_row", F.from_json("value", schema if isinstance(schema, str) else schema.json()).alias("_r")).where("_r is not null").select("_file", "_row", "_r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line, nulls left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_directory(spark: SparkSession, path: str, suffixes: Sequence[str] = (".py", ".md", ".json"), exclude: Sequence[str] = ()) -> DataFrame:
    """(path, text) of the files below a directory, a row each."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.col("path").endswith(s)
    for x in exclude:
        keep = keep & ~F.col("path").contains(x)
    return rows.where(keep)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files; each is read whole by one task, as binaryFile does."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_snapshot(records: DataFrame, path: str, *by: str) -> None:
    """A ledger's rows as a table partitioned by its columns `by`; the old one goes only once this is whole."""
    writer = records.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_snapshot(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """The rows of a snapshot; columns that older snapshots lack get their defaults."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


def markdown_table(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """(line_no, line): a Markdown table of a report's rows; reports are small, and one row a line."""
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + "---|" * len(rows.columns))], "line_no int, line string")
    from pyspark.sql import Window as W

    number = (F.row_number().over(W.orderBy(*order)) + 1).cast("int")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), F.lit(" |"))
    return head.union(rows.select(number.alias("line_no"), cells.alias("line")))


def manifest(parts: dict[str, DataFrame], policy: str) -> DataFrame:
    """(part, n_rows, digest, policy): rows of each part and a digest that their order doesn't change."""
    out = None
    for name, df in sorted(parts.items()):
        row = df.agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest"))
        row = row.select(F.lit(name).alias("part"), "n_rows", "digest", F.lit(policy).alias("policy"))
        out = row if out is None else out.unionByName(row)
    return out


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, line): turns with their speaker before the text."""
    body = F.trim(F.coalesce("text", F.lit("")))
    return conversations.where(body != "").select("conv_id", "turn", F.concat_ws(": ", "role", body).alias("line"))


def generated_episodes(spark: SparkSession, n: int, attributes: int = 8, values: int = 100, seed: str = "0") -> DataFrame:
    """n synthetic episodes from hashes alone: two facts of one attribute each, the later one right."""
    h = lambda what: F.conv(F.substring(F.sha1(F.encode(F.concat_ws("|", F.lit(seed), F.lit(what), F.col("id").cast("string")), "UTF-8")), 1, 8), 16, 10).cast("long")
    rows = spark.range(n).select(
        F.col("id").alias("episode_id"), F.concat(F.lit("user_"), F.col("id")).alias("entity"), F.concat(F.lit("attribute_"), h("a") % attributes).alias("attribute"),
        F.concat(F.lit("value_"), h("old") % values).alias("old_value"), F.concat(F.lit("value_"), h("new") % values).alias("value"), (h("known") % 4 != 0).alias("answerable"),
    )
    said = lambda v: F.concat("entity", F.lit(" has "), "attribute", F.lit(" "), v)
    return rows.withColumn("facts", F.array(said(F.col("old_value")), said(F.col("value")))).withColumn("query", F.concat(F.lit("which "), "attribute", F.lit(" has "), "entity", F.lit("?")))
