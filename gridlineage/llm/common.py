"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed, shared_dir

#: Rows of narrow keys that may be broadcast; above it the same join is shuffled.
BROADCAST_ROWS = 1_000_000

#: The ASCII white space that separates words.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again, so that later reads prune its columns."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A hint to broadcast `df` if it has at most BROADCAST_ROWS rows, else `df` for a shuffled join.

    `df` should be materialised, as it is counted.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` less the columns that an operator is about to add under the same names."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def learns(doc_id: Column) -> Column:
    """True for rows whose label may be used for fitting; the rest is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


#: Bytes of the texts that a model is fitted on, of either label, at most.
SAMPLE_BYTES = 12_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label): at most `per_class` rows and `most` bytes of text of either class, none of them held out.

    Labelled documents that are among `docs` come in the order of a hash of their id, so the sample does not
    depend on partitions; a class ends before the row that takes it above `most` bytes. Rows without id,
    text or a label of 0 or 1 aren't taken. Of an id's texts and labels the smallest count. Empty tables give none.
    """
    known = labels.filter(F.col(label).isin(0, 1) & learns(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.min(label).cast("int").alias("label"))
    sizes = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size"))
    found = sizes.join(known, "id").groupBy("id", "label").agg(F.max("size").alias("size")).withColumn("at", F.md5(F.concat(F.lit("fit"), F.col("id").cast("string"))))
    first = None
    for value in (0, 1):
        part = found.filter(F.col("label") == value).orderBy("at", "id").limit(per_class)
        first = part if first is None else first.unionByName(part)
    upto = F.sum("size").over(Window.partitionBy("label").orderBy("at", "id"))
    ids = checkpointed(first.withColumn("upto", upto).filter(F.col("upto") <= most).select("id", "label"))
    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids), "id")
    return rows.groupBy("id", "label").agg(F.min("text").alias("text")).select(F.col("id").alias("doc_id"), "text", "label")
