"""Workbooks that arrive in a folder, analysed as they come (an extension: batches are defined by the folder's listing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.lineage import resolved
from ..session import checkpointed, ship
from ..sources import workbooks

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(workbook_id, path, content) of files as a stream."""
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.xls[xm]").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return stream.select(F.col("path").alias("workbook_id"), "path", "content")


def analyze_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes nodes and edges of each batch under `out`, in a folder of the batch's number, so a batch that runs again replaces itself."""
    ship(spark)

    def batch(books: DataFrame, number: int) -> None:
        cells = checkpointed(workbooks.cells(workbooks.raw_cells(books)))
        lineage = resolved(cells, checkpointed(workbooks.structure(books)))
        lineage.nodes.write.mode("overwrite").parquet(f"{out}/nodes/batch={number}")
        lineage.edges.write.mode("overwrite").parquet(f"{out}/edges/batch={number}")

    writer = arrivals(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
