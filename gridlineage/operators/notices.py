"""What is said about linked workbooks and queries: names in order, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Targets of queries that are named; the rest is counted.
NAMED = 6


def external_books(refs: DataFrame) -> DataFrame:
    """(workbook_id, read, cached, missing): names of linked books by how they were read.

    `refs` has workbook_id, target and read (folder, cache or none); a workbook links to few books.
    """
    names = lambda kind: F.sort_array(F.collect_set(F.when(F.col("read") == kind, F.col("target"))))
    return refs.groupBy("workbook_id").agg(names("folder").alias("read"), names("cache").alias("cached"), names("none").alias("missing"))


def queries(members: DataFrame, sources: DataFrame, loaded: DataFrame, most: int = NAMED) -> DataFrame:
    """(workbook_id, queries, loaded, outside, more): counts of queries and of those that load to a sheet, and what lies outside.

    `outside` names at most `most` targets that are neither tables nor queries of the workbook; `more`
    counts the others. `loaded` has workbook_id and name, which match without case.
    """
    own = members.select("workbook_id", F.lower("name").alias("key")).distinct()
    there = loaded.select("workbook_id", F.lower("name").alias("key")).distinct().withColumn("there", F.lit(1))
    counts = own.join(there, ["workbook_id", "key"], "left").groupBy("workbook_id").agg(F.count("*").alias("queries"), F.count("there").alias("loaded"))
    beyond = sources.filter(~F.col("kind").isin("table", "query")).groupBy("workbook_id").agg(F.sort_array(F.collect_set("target")).alias("all"))
    out = counts.join(beyond, "workbook_id", "left").withColumn("all", F.coalesce("all", F.array().cast("array<string>")))
    return out.select("workbook_id", "queries", "loaded", F.slice("all", 1, most).alias("outside"), F.greatest(F.size("all") - most, F.lit(0)).alias("more"))
