"""Batches that go to Python are bounded in bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from gridlineage.session import BATCH_BYTES, SPARK_BYTES, ship

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_long_rows_do_not_meet_in_one_batch(spark):
    before = spark.conf.get(SETTING)
    try:
        spark.conf.set(SETTING, SPARK_BYTES)
        ship(spark)
        assert spark.conf.get(SETTING) == str(BATCH_BYTES)
        long = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

        found = long.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in found) == 40
        assert max(r.size for r in found) < 2 * BATCH_BYTES
    finally:
        spark.conf.set(SETTING, before)


def test_a_bound_of_the_caller_stays(spark):
    before = spark.conf.get(SETTING)
    try:
        spark.conf.set(SETTING, "1048576b")
        ship(spark)
        assert spark.conf.get(SETTING) == "1048576b"
    finally:
        spark.conf.set(SETTING, before)
