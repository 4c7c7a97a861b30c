"""What a Spark session needs before operators with Python code run on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows of a batch that goes to Python: texts and workbooks are long, so a batch is kept short of what a worker can hold.
BATCH = 2_000
#: Bytes after which a batch ends whatever its rows, so that long texts and large files do not meet in one. It takes the place of Spark's own bound alone.
BATCH_BYTES, SPARK_BYTES = 8 << 20, f"{64 << 20}b"


def ship(spark: SparkSession) -> None:
    """Sends this package's Python files to the executors, once for each application, and bounds Arrow batches in rows and bytes."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == SPARK_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; where that is unset, a local one in local mode, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
